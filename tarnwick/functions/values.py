"""Scalar functions over text, dates, JSON properties and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def decoded_base64(c: Column) -> Column:
    """Bytes; null for text that is no base64."""
    return F.try_to_binary(c, F.lit("base64"))


def parsed_date(c: Column) -> Column:
    """Timestamp of an RFC 3339 string; null for anything else."""
    return F.when(c.rlike(RFC3339), c.try_cast("timestamp"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def json_path(name: str) -> str:
    return "$['" + name + "']"


def json_kind(value: Column) -> Column:
    """Kind of a VARIANT value: boolean, number, string, strings (an array of strings only, or empty), null, other."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(kind == "BOOLEAN", "boolean").when(number, "number").when(kind == "STRING", "string").when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.when(F.forall(value.try_cast("array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), "strings").otherwise("other")).when(kind == "VOID", "null").otherwise("other")


def with_property(json: Column, name: str, value: Column | None) -> Column:
    """A JSON object with one property set to a VARIANT value, or without it (None). All others keep their types."""
    kept = F.map_filter(F.parse_json(json).cast("map<string,variant>"), lambda k, v: k != name)
    changed = F.to_json(kept if value is None else F.map_concat(kept, F.create_map(F.lit(name), value)))
    return F.to_json(F.parse_json(changed))  # with the names in order


def properties_size(json: Column) -> Column:
    """Bytes of a flat object of strings in the row store's binary JSON: 8, and per pair 8, its key and its value."""
    pairs = F.from_json(json, "map<string,string>")
    sizes = F.transform(F.map_entries(pairs), lambda e: F.octet_length(e["key"]) + F.octet_length(e["value"]) + 8)
    return F.aggregate(sizes, F.lit(8), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, within [-1, 1]."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(-1.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(v: Column) -> Column:
    """Unit vector; the zero vector stays, a norm that is no number is an error."""

    def scaled(x: Column) -> Column:
        v, n = x["v"], x["n"]
        bad = F.isnan(n) | (n == float("inf"))
        unit = F.transform(v, lambda c: c.cast("double") / n)
        return F.when(bad, F.raise_error(F.lit("vector has no finite norm"))).when(n == 0, v.cast("array<double>")).otherwise(unit)

    return bound(v, lambda v: bound(F.struct(v.alias("v"), norm(v).alias("n")), scaled))


def moved(point: Column, towards: Column, shift: float) -> Column:
    """The normalised point after a step of size shift."""
    return normalized(F.zip_with(point, towards, lambda p, e: p * (1 - shift) + e * shift))


def average_pooled(matrix: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps; zeros if it keeps none."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zero = F.transform(F.element_at(matrix, 1), lambda x: F.lit(0.0))
    weighted = F.zip_with(matrix, mask, lambda row, m: F.transform(row, lambda x: x * m))
    total = F.aggregate(weighted, zero, lambda s, row: F.zip_with(s, row, lambda a, b: a + b))
    return F.transform(total, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def weighted_number(weight: Column, n) -> Column:
    return F.ceil(weight * n)


def interest_match(category: Column, sub_category: Column, interests: Column) -> tuple[Column, Column]:
    """(interesting, semi-interesting) of an item for interests written as "category/sub": interesting if either part
    agrees with one of them; semi-interesting if the category agrees or the sub-category differs."""
    cat = lambda i: F.split_part(i, F.lit("/"), F.lit(1))
    sub = lambda i: F.split_part(i, F.lit("/"), F.lit(2))
    return (
        F.exists(interests, lambda i: (cat(i) == category) | (sub(i) == sub_category)),
        F.exists(interests, lambda i: (cat(i) == category) | (sub(i) != sub_category)),
    )
