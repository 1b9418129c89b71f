"""Files in ingestion: what they are by their content, and their text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.sources.readers import html_text

# First bytes of file formats.
SIGNATURES = {
    "application/pdf": "25504446",
    "application/zip": "504B0304",
    "application/gzip": "1F8B",
    "application/x-ole-storage": "D0CF11E0A1B11AE1",
    "application/rtf": "7B5C727466",
    "image/png": "89504E470D0A1A0A",
    "image/gif": "47494638",
    "image/jpeg": "FFD8FF",
    "image/tiff": "49492A00",
    "video/mp4": "00000018667479706D703432",
}
UNKNOWN = "application/octet-stream"
#: Characters at the beginning that tell whether a text is a page.
HEAD = 1024


def decoded(data: Column) -> Column:
    """Bytes as text, without a byte order mark; what is no UTF-8 is replaced."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "^﻿", "")


def media_type(data: Column) -> Column:
    """By signature, else text/html or text/plain for UTF-8 without control characters; null for no or empty data."""
    first = F.hex(F.substring(data, 1, 16))
    out = F.lit(None).cast("string")
    head = F.lower(F.ltrim(F.substring(decoded(data), 1, HEAD), F.lit(" \t\r\n")))
    page = head.rlike(r"^(<\?xml[^>]*>\s*)?(<!--[^>]*-->\s*)?(<!doctype html|<html|<head|<body)")
    text = F.is_valid_utf8(data.cast("string")) & ~F.substring(decoded(data), 1, HEAD).rlike(r"[\x00-\x08\x0E-\x1F]")
    out = F.when(text, F.when(page, "text/html").otherwise("text/plain")).otherwise(UNKNOWN)
    for name, signature in SIGNATURES.items():
        out = F.when(first.startswith(signature), name).otherwise(out)
    return F.when(F.octet_length(data) > 0, out)


def by_function(extract: Callable[[bytes], str | None]) -> Callable[[Column], Column]:
    """An extractor from a function of a file's bytes; None means that the file can't be read."""

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([extract(bytes(b)) if b is not None else None for b in files])

    return run


@dataclass(frozen=True)
class Files:
    """Extractors by media type (bytes to text, as columns), and the types that are allowed: all that have one where none are named."""

    extractors: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"text/plain": decoded, "text/html": lambda data: html_text(decoded(data))})
    allowed: tuple[str, ...] = ()

    def accepted(self, data: Column) -> Column:
        return F.coalesce(media_type(data).isin([t for t in self.extractors if not self.allowed or t in self.allowed]), F.lit(False))

    def text(self, data: Column) -> Column:
        """The text by the extractor of the file's type; null where there is none. A file that isn't of a type reaches its extractor as null."""
        kind = media_type(data)
        return F.coalesce(*[F.when(kind == name, extract(F.when(kind == name, data))) for name, extract in self.extractors.items()])
