"""Checks and codecs of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier syntax.
DOCUMENT_ID = r"^[a-zA-Z0-9\-:@.][a-zA-Z0-9\-:@._]*$"
PROPERTY_ID = r"^[a-zA-Z0-9\-:@][a-zA-Z0-9\-:@_]*$"
TENANT_ID = r"^[a-zA-Z0-9_:@.-]{1,50}$"
# The characters of Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def _valid(c: Column, pattern: str | None, most: int | None) -> Column:
    """Of 1 to ``most`` bytes after trimming, and matching; without a pattern, free of NUL."""
    size = F.octet_length(trimmed(c))
    fits = size >= 1 if most is None else size.between(1, most)
    return F.coalesce(fits & (~F.contains(c, F.lit("\0")) if pattern is None else trimmed(c).rlike(pattern)), F.lit(False))


def valid_document_id(c: Column) -> Column:
    return _valid(c, DOCUMENT_ID, 256)


def valid_property_id(c: Column) -> Column:
    return _valid(c, PROPERTY_ID, 256)


def valid_tag(c: Column) -> Column:
    return _valid(c, None, 256)


def valid_query(c: Column) -> Column:
    return _valid(c, None, 512)


def valid_snippet(c: Column, split: Column) -> Column:
    """At most 2048 bytes, unless the snippet will be split."""
    return F.when(split, _valid(c, None, None)).otherwise(_valid(c, None, 2048))


def encode_snippet_id(document_id: Column, sub_id: Column) -> Column:
    return F.when(sub_id == 0, document_id).otherwise(F.concat(F.lit("_s."), sub_id.cast("string"), F.lit("."), document_id))


def decode_snippet_id(c: Column) -> tuple[Column, Column]:
    """(document_id, sub_id); an id that is no snippet id is a document's, with sub_id 0."""
    form = r"^_s\.([0-9]+)\.(.*)$"
    is_snippet = c.rlike(form)
    return (
        F.when(is_snippet, F.regexp_extract(c, form, 2)).otherwise(c),
        F.when(is_snippet, F.regexp_extract(c, form, 1).try_cast("long")).otherwise(F.lit(0).cast("long")),
    )
