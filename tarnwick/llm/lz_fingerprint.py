"""Lempel-Ziv phrase fingerprints and their likeness."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import table

#: Bins of a signature; each keeps 16 bits of its least phrase hash.
BINS = 128
EMPTY = np.uint64(2**64 - 1)
#: Documents of one range, which a task reads in order; from GROW ranges on, ranges and their length grow alike, with
#: the square root of the documents: 195,000 ranges of 51,000 for 10 billion.
RANGE_DOCS, GROW = 1024, 4096
#: Ranges of doc_id whose ends are found exactly; inside each, ends are interpolated.
COARSE = 64


def parse(data: bytes, phrases: set[bytes]) -> tuple[list[bytes], bytes]:
    """The new phrases of data, in order, and its unfinished end: each is the longest known phrase and one byte more; all go to ``phrases``.

    Every prefix of a phrase is a phrase too, so the search for the longest may start at any length; it starts at
    the length of the phrase before. A known phrase that the data ends with is unfinished.
    """
    new, i, n, size = [], 0, len(data), 1
    while i < n:
        size = min(size, n - i)
        if data[i : i + size] in phrases:
            while i + size < n and data[i : i + size + 1] in phrases:
                size += 1
            if i + size == n:
                return new, data[i:]
            size += 1
        else:
            while size > 1 and data[i : i + size - 1] not in phrases:
                size -= 1
        phrase = data[i : i + size]
        phrases.add(phrase)
        new.append(phrase)
        i += size
    return new, b""


def signature(phrases: list[bytes]) -> np.ndarray:
    """Per bin (the hash's top 7 bits) the least hash, or EMPTY."""
    least = np.full(BINS, EMPTY)
    if phrases:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(p) for p in phrases], np.uint64)
        np.minimum.at(least, (h >> np.uint64(57)).astype(np.int64), h)
    return least


def short(least: np.ndarray) -> np.ndarray:
    """16 bits a bin; 0xffff stands for an empty bin only."""
    return np.where(least == EMPTY, 0xFFFF, np.minimum((least >> np.uint64(20)) & np.uint64(0xFFFF), 0xFFFE)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that are filled in either signature; 1 for two empty ones."""
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


class Edited:
    """A document's text split where its edit begins, its fingerprint, and what its edit needs."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.n = len(self.text)
        self.half = self.n // 2
        self.phrases: set[bytes] = set()
        head = self.text[: self.n - self.half]
        new, self.open = parse(head.encode("utf-8"), self.phrases)
        self.head = signature(new)
        tail = self.text[self.n - self.half :].encode("utf-8")
        self.tail = signature(self._after(tail))
        self.print = short(np.minimum(self.head, self.tail))

    def _after(self, tail: bytes) -> list[bytes]:
        """The phrases that the head's parse finds when it goes on with tail."""
        new, _ = parse(self.open + tail, self.phrases)
        self.phrases.difference_update(new)
        return new

    def edit(self, other: "Edited") -> tuple[str, np.ndarray]:
        """The edited text, and its fingerprint: the parse of the head is shared."""
        put = other.text[: self.half]
        return self.text[: self.n - self.half] + put, short(np.minimum(self.head, signature(self._after(put.encode("utf-8")))))


def _part(ids: DataFrame) -> Column:
    """Number of the range of (doc_id, tie): falls as doc_id grows; null ids come last, dealt by tie."""
    n, n_null = ids.agg(F.count("doc_id"), F.count(F.lit(1)) - F.count("doc_id")).first()
    long = RANGE_DOCS * max(1.0, ((n + n_null) / (RANGE_DOCS * GROW)) ** 0.5)
    n_coarse = max(1, min(COARSE, int(n / long)))
    fine = max(1, math.ceil(n / long / n_coarse))
    ends = ids.stat.approxQuantile("doc_id", [i / n_coarse for i in range(n_coarse + 1)], 1 / (4 * n_coarse)) if n else [0.0, 0.0]
    ends = sorted({int(e) for e in ends})
    d = F.col("doc_id")
    lows, highs = ends[:-1] or ends, ends[1:] or ends
    part = F.lit(0)
    for k, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
        inside = F.floor((d - lo).cast("double") / max(1, hi - lo) * fine).cast("long")
        at = k * fine + F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))
        part = at if k == 0 else F.when(d >= lo, at).otherwise(part)
    last = len(lows) * fine
    null_parts = max(1, math.ceil(n_null / long))
    of_null = last + 1 + F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * null_parts).cast("long")
    return F.when(d.isNull(), of_null).otherwise(last - part)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as rows (part, ahead, doc_id, tie, text) such that, within a part, in the order of
    ``ahead`` and then of doc_id descending, the row after each row is its next document; a part's row ``ahead`` is
    the first of the next part or, after the last part, of the first.

    Parts are ranges of doc_id, found by two aggregations over the ids; a part's first row is all that another part has
    to know. Texts are shuffled once. Null ids come last, in the order of a hash of their text, so they may be dealt too.
    """
    ids = table(docs.select("doc_id", F.xxhash64("text").alias("tie")), "lz-ids")
    part = _part(ids)
    tops = ids.groupBy(part.alias("part")).agg(F.max(F.struct("doc_id", F.negative("tie").alias("tie"))).alias("top"))
    tops = tops.select("part", F.col("top.doc_id").alias("id"), F.negative("top.tie").alias("t"), F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("to"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    ahead = rows.join(F.broadcast(table(tops, "lz-tops")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))  # a row for each range
    rows = rows.select(part.alias("part"), F.lit(False).alias("ahead"), "*")
    return rows.unionByName(ahead.select(F.col("to").alias("part"), F.lit(True).alias("ahead"), "doc_id", "tie", "text"))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, row, doc = None, None, None
    for pdf in batches:
        out = []
        for p, ahead, doc_id, text in zip(pdf["part"], pdf["ahead"], pdf["doc_id"], pdf["text"], strict=True):
            if p == part and row is None:  # a second row ahead: equal rows
                continue
            here = Edited(text)
            if p == part:
                text_edited, print_edited = doc.edit(here)
                digest = hashlib.sha256(text_edited.encode("utf-8")).hexdigest()
                out.append((row, doc.n, digest, doc.print.tobytes().hex(), print_edited.tobytes().hex(), likeness(doc.print, print_edited), likeness(doc.print, here.print)))
            part, row, doc = p, (None if ahead else (doc_id,)), here
        yield pd.DataFrame([(r[0], *rest) for r, *rest in out], columns=COLUMNS)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_and_edit(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last half replaced by the beginning of the next
    document, by doc_id descending and around), the edited text's SHA-256, and the likeness of the fingerprint to the
    edited one and to the next document's.

    docs: doc_id (whole numbers), text; other columns are ignored. Null text counts as empty; an empty text has the
    fingerprint of no phrase. Rows that share an id are ordered by a hash of their text; null ids come last. The only
    row of a table is its own next document. An empty table gives an empty result.
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    kinds = ["string", "long", "string", "string", "string", "double", "double"]
    out = rows.drop("tie").mapInPandas(_compare, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds, strict=True)))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
