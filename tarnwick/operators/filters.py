"""Property filters: JSON to a checked tree, merged ranges, and one boolean column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.config import MAX_FILTER_CHILDREN, MAX_INDEXED_PROPERTIES, MAX_LIST_ITEMS, IncompatibleType, IncompatibleUpdate, InvalidFilter, UnindexedId
from tarnwick.functions.ids import DOCUMENT_ID, PROPERTY_ID
from tarnwick.functions.values import RFC3339

TYPES = ("boolean", "number", "keyword", "keyword[]", "date")
RANGES = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}
PUBLISHED = "publication_date"


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: object


@dataclass(frozen=True)
class Ids:
    ids: tuple[str, ...]


@dataclass(frozen=True)
class Combine:
    op: str
    children: tuple


def is_date(v) -> bool:
    if not (isinstance(v, str) and re.match(RFC3339, v)):
        return False
    try:
        instant(v)
    except ValueError:
        return False
    return True


def instant(v: str) -> datetime:
    return datetime.fromisoformat(v.upper().replace("Z", "+00:00"))


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def _compare(name: str, body) -> Compare:
    if not (isinstance(name, str) and re.match(PROPERTY_ID, name) and len(name.encode()) <= 256):
        raise InvalidFilter(reason="invalid property id", value=name)
    if not isinstance(body, dict) or len(body) != 1:
        raise InvalidFilter(reason="a comparison has exactly one operator", value=body)
    op, v = next(iter(body.items()))
    fine = {
        "$eq": lambda: isinstance(v, bool | str),
        "$in": lambda: isinstance(v, list) and len(v) <= MAX_LIST_ITEMS and all(isinstance(x, str) for x in v),
    }.get(op, lambda: op in RANGES and (_number(v) or is_date(v)))
    if not fine():
        raise InvalidFilter(reason="invalid comparison", value=body)
    return Compare(name, op, tuple(v) if isinstance(v, list) else v)


def parse(filter_json: dict | None, depth: int = 0):
    """Checked tree of a filter; a root combination may hold one more level of combinations."""
    if filter_json is None:
        return None
    if not isinstance(filter_json, dict) or len(filter_json) != 1:
        raise InvalidFilter(reason="a filter has exactly one key: a property, $and, $or or $ids", value=filter_json)
    key, body = next(iter(filter_json.items()))
    if key in ("$and", "$or"):
        if depth > 1:
            raise InvalidFilter(reason="nested too deeply", value=key)
        if not isinstance(body, list) or len(body) > MAX_FILTER_CHILDREN:
            raise InvalidFilter(reason=f"at most {MAX_FILTER_CHILDREN} filters can be combined", value=key)
        return Combine(key, tuple(parse(x, depth + 1) for x in body))
    if key == "$ids":
        if not isinstance(body, list) or len(body) > MAX_LIST_ITEMS or not all(isinstance(x, str) and re.match(DOCUMENT_ID, x) and len(x.encode()) <= 256 for x in body):
            raise InvalidFilter(reason="invalid document ids", value=key)
        return Ids(tuple(body))
    return _compare(key, body)


def published_after(tree, when: str | None):
    """tree AND publication_date >= when."""
    if when is None:
        return tree
    if not is_date(when):
        raise InvalidFilter(reason="published_after is no date", value=when)
    since = Compare(PUBLISHED, "$gte", when)
    if tree is None:
        return since
    if isinstance(tree, Combine) and tree.op == "$and":
        return Combine("$and", (*tree.children, since))
    return Combine("$and", (tree, since))


def validate(tree, schema: dict[str, str]) -> None:
    """Raises unless each property is declared and its value fits; ids are exempt."""
    if isinstance(tree, Combine):
        for child in tree.children:
            validate(child, schema)
    elif isinstance(tree, Compare):
        kind = schema.get(tree.name)
        if kind is None:
            raise UnindexedId(name=tree.name)
        v = tree.value
        fits = {"boolean": isinstance(v, bool), "number": _number(v), "keyword": isinstance(v, str | tuple), "keyword[]": isinstance(v, tuple), "date": is_date(v)}
        if not fits[kind]:
            raise IncompatibleType(name=tree.name, expected=kind, got=v)


def validate_property(name: str, value, schema: dict[str, str]) -> None:
    """Raises unless a value to be stored fits; undeclared properties are stored but can't be filtered by."""
    kind = schema.get(name)
    fits = {None: True, "boolean": isinstance(value, bool), "number": _number(value), "keyword": isinstance(value, str), "keyword[]": isinstance(value, list), "date": is_date(value)}
    if not fits[kind]:
        raise IncompatibleType(name=name, expected=kind, got=value)


def extend_schema(schema: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Declared properties only grow: no name twice, MAX_INDEXED_PROPERTIES in all."""
    again = sorted(set(schema) & set(new))
    if again:
        raise IncompatibleUpdate(names=again)
    if any(kind not in TYPES for kind in new.values()) or any(not re.match(PROPERTY_ID, n) for n in new):
        raise IncompatibleUpdate(invalid=new)
    if len(schema) + len(new) > MAX_INDEXED_PROPERTIES:
        raise IncompatibleUpdate(most=MAX_INDEXED_PROPERTIES)
    return schema | new


def _bound(op: str, value) -> tuple:
    return (instant(value) if isinstance(value, str) else float(value), op)


def merge_ranges(tree):
    """Ranges of one property under one combination become one per direction: under $and the tightest bound (exclusive
    before inclusive at equal values), under $or the loosest."""
    if not isinstance(tree, Combine):
        return tree
    kept, bounds = [], {}
    for child in map(merge_ranges, tree.children):
        if isinstance(child, Compare) and child.op in RANGES:
            bounds.setdefault((child.name, child.op[:3], isinstance(child.value, str)), []).append(child)
        else:
            kept.append(child)
    for (_, side, _), group in bounds.items():
        values = [_bound(c.op, c.value)[0] for c in group]
        best = max(values) if (side == "$gt") == (tree.op == "$and") else min(values)
        same = [c for c, v in zip(group, values, strict=True) if v == best]
        exclusive = [c for c in same if c.op == side]
        inclusive = [c for c in same if c.op != side]
        kept.append(((exclusive or inclusive) if tree.op == "$and" else (inclusive or exclusive))[0])
    return Combine(tree.op, tuple(kept))


#: How a property is read: (name, type) to a typed column.
Resolver = Callable[[str, str], Column]


def from_json_column(properties: Column) -> Resolver:
    """Properties in a VARIANT column. A value that doesn't fit its declared type is null and matches nothing, but
    keywords take any value as text."""

    def resolve(name: str, kind: str) -> Column:
        get = lambda t: F.try_variant_get(properties, f"$['{name}']", t)
        if kind == "date":
            text = get("string")
            return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))
        return get({"boolean": "boolean", "number": "double", "keyword": "string", "keyword[]": "array<string>"}[kind])

    return resolve


def from_columns(columns: dict[str, Column], otherwise: Resolver | None = None) -> Resolver:
    """Properties kept in columns of their own, so that comparisons reach the scan."""

    def resolve(name: str, kind: str) -> Column:
        return columns[name] if name in columns else otherwise(name, kind)

    return resolve


def _compiled(c: Compare, schema: dict[str, str], resolve: Resolver) -> Column:
    kind = schema[c.name]
    field = resolve(c.name, kind)
    if c.op == "$in":
        if not c.value:
            return F.lit(False)
        if kind == "keyword[]":
            return F.arrays_overlap(field, F.array(*[F.lit(v) for v in c.value]))
        return field.isin(*c.value)
    value = F.lit(instant(c.value)) if kind == "date" else F.lit(c.value)
    if c.op == "$eq":
        return F.array_contains(field, value) if kind == "keyword[]" else field == value
    return {"$gt": field > value, "$gte": field >= value, "$lt": field < value, "$lte": field <= value}[c.op]


def compile_filter(tree, schema: dict[str, str], resolve: Resolver, document_id: Column | None = None) -> Column:
    """One boolean column; missing values match nothing. An empty combination at the root is no filter; inside, an
    empty $and holds for all and an empty $or for none."""
    if tree is None or (isinstance(tree, Combine) and not tree.children):
        return F.lit(True)
    validate(tree, schema)

    def build(t) -> Column:
        if isinstance(t, Ids):
            ids = F.col("document_id") if document_id is None else document_id
            return ids.isin(*t.ids) if t.ids else F.lit(False)
        if isinstance(t, Compare):
            return _compiled(t, schema, resolve)
        if not t.children:
            return F.lit(t.op == "$and")
        return reduce((lambda a, b: a & b) if t.op == "$and" else (lambda a, b: a | b), map(build, t.children))

    return build(merge_ranges(tree))
