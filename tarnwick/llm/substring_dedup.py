"""Repeated passages across documents, found with compressed FM-indexes over shards of candidate segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import table
from tarnwick.llm.fm_index import matched

#: Words of an anchor gram.
GRAM = 8
#: Symbols of one FM-index, about.
SHARD_WORDS = 400_000
#: Different segments at one anchor, beyond which its windows are matched by grouping instead of by index: so many
#: fill an index of SHARD_WORDS alone.
MOST_AT_ANCHOR = 4096

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((ODD, ODD_INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base, np.uint64)]), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.encode("utf-8", "replace").split()], np.uint64)


class Hashes:
    """Hashes of any stretch of a word sequence, from running sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power(len(words) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def segments(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, cls, start, end: windows that choose the same gram (the least hash in them, leftmost of equals) form
    one segment; cls is a hash of its words. Equal windows choose the same gram in any document."""
    n = len(words)
    hashes = Hashes(words)
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    width = window - GRAM + 1
    chosen = np.concatenate([i + np.lib.stride_tricks.sliding_window_view(grams[i : i + BLOCK + width - 1], width).argmin(axis=1) + np.arange(min(BLOCK, n - window + 1 - i)) for i in range(0, n - window + 1, BLOCK)])
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    start, end = first, last + window
    return grams[chosen[first]].view(np.int64), hashes.of(start, end).view(np.int64), start, end


BLOCK = 1 << 14


def _find(docs: DataFrame, window: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols, ids, keys = [[], [], [], []], [], []
            for doc_id, key, text in zip(pdf["doc_id"], pdf["row_key"], pdf["text"], strict=True):
                words = word_hashes(text)
                if len(words) >= window:
                    found = segments(words, window)
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                    ids.append(np.full(len(found[0]), doc_id))
                    keys.append(np.full(len(found[0]), key))
            if ids:
                anchor, cls, start, end = (np.concatenate(c) for c in cols)
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "row_key": np.concatenate(keys), "anchor": anchor, "cls": cls, "start": start.astype(np.int32), "end": end.astype(np.int32)})

    return docs.mapInPandas(run, f"doc_id {kind}, row_key long, anchor long, cls long, start int, end int")


def _words_of(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, cls, again, doc_id, words, windows) for each wanted (row_key, anchor, cls, again, start, end, hot): the
    segment's word hashes, or, where hot, the hashes of its windows."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    per_doc = wanted.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "cls", "again", "start", "end", "hot")).alias("take"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, take in zip(pdf["doc_id"], pdf["text"], pdf["take"], strict=True):
                words = word_hashes(text)
                hashes = Hashes(words)
                for t in take:
                    a, b = t["start"], t["end"]
                    s = np.arange(a, b - window + 1)
                    out.append((t["anchor"], t["cls"], t["again"], doc_id, None if t["hot"] else words[a:b].tobytes(), hashes.of(s, s + window).view(np.int64) if t["hot"] else None))
            if out:
                yield pd.DataFrame(out, columns=["anchor", "cls", "again", "doc_id", "words", "windows"])

    rows = keyed.join(per_doc, "row_key").select("doc_id", "text", "take")
    return rows.mapInPandas(run, f"anchor long, cls long, again boolean, doc_id {kind}, words binary, windows array<long>")


def _search(cold: DataFrame, n_shards: int, window: int) -> DataFrame:
    """(anchor, cls, later, a, b): the stretches of each segment that segments of smaller doc_ids hold too; later: as
    seen from the other documents that have the segment, else from its first. Anchors are dealt to shards by hash,
    so all segments that can share a window meet in one index."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        owners = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        again = np.flatnonzero(pdf["again"].to_numpy(bool))
        asked = np.concatenate([np.arange(len(parts)), again])
        later = np.arange(len(asked)) >= len(parts)
        found = matched(parts, owners, window, asked, owners[asked] + later)
        anchor, cls = pdf["anchor"].to_numpy()[asked], pdf["cls"].to_numpy()[asked]
        return pd.DataFrame([(n, c, is_later, a, b) for n, c, is_later, x in zip(anchor, cls, later, found, strict=True) for a, b in x], columns=["anchor", "cls", "later", "a", "b"])

    return cold.groupBy(F.pmod("anchor", F.lit(n_shards)).alias("shard")).applyInPandas(shard, "anchor long, cls long, later boolean, a int, b int")


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(row_key, cuts): per document the word intervals [a, b) covered by windows that a smaller doc_id has too.
    docs: doc_id, row_key, text without nulls.

    Each window goes with the anchor it chooses, so equal windows share an anchor. Segments with equal words are one
    class, indexed once and asked for twice: what do documents before its first one have of it, and what do documents
    before the others? Both answers come from the FM-index of the anchor's shard, or, where an anchor has more than
    MOST_AT_ANCHOR classes, from grouping its windows by hash. A class of one document alone at its anchor has no one
    to match, so neither is its text read again.
    """
    segs = table(_find(docs, window), "segments")
    first = F.min(F.struct("doc_id", "row_key", "start", "end")).alias("first")
    classes = segs.groupBy("anchor", "cls").agg(first, F.max("doc_id").alias("most"))
    classes = table(classes.select("anchor", "cls", "first", (F.col("most") > F.col("first.doc_id")).alias("again")), "segment-classes")
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("any")).where("n > 1 or any")
    wanted = classes.join(shared.select("anchor", (F.col("n") > MOST_AT_ANCHOR).alias("hot")), "anchor")
    found = table(_words_of(docs, wanted.select("first.row_key", "anchor", "cls", "again", "first.start", "first.end", "hot"), window), "segment-words")

    cold = found.where("words is not null").drop("windows")
    total = cold.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    by_index = _search(cold, max(1, -(-total // (8 * SHARD_WORDS))), window)
    hot = found.where("windows is not null").select("anchor", "cls", "again", "doc_id", F.posexplode("windows").alias("a", "w"))
    least = hot.groupBy("w").agg(F.min("doc_id").alias("least"))
    sides = F.when(F.col("doc_id") > F.col("least"), F.array(F.lit(False), F.col("again"))).otherwise(F.array("again"))
    by_group = hot.join(least, "w").withColumn("later", F.explode(F.array_distinct(sides))).where("later or doc_id > least")
    by_group = by_group.select("anchor", "cls", "later", "a", (F.col("a") + window).alias("b"))
    parts = by_index.unionByName(by_group).groupBy("anchor", "cls")
    part = lambda side: F.collect_list(F.when(side, F.struct("a", "b")))
    rules = parts.agg(part(~F.col("later")).alias("own"), part(F.col("later")).alias("later"))
    owners = classes.select("anchor", "cls", F.col("first.doc_id").alias("owner"))
    rules = table(rules.join(owners, ["anchor", "cls"]), "segment-rules")  # written, so that the next join is of two shuffles and hot classes are split in it
    hit = segs.join(rules, ["anchor", "cls"])
    its = F.when(F.col("doc_id") > F.col("owner"), F.col("later")).otherwise(F.col("own"))
    hit = hit.select("row_key", F.transform(its, lambda p: F.struct((F.col("start") + p["a"]).alias("a"), (F.col("start") + p["b"]).alias("b"))).alias("cuts"))
    return hit.where(F.size("cuts") > 0).groupBy("row_key").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_removed, kept_text: each document's words, joined by one space,
    without those covered by a window of ``window`` words that a document with a smaller doc_id has too.

    docs: doc_id, text; other columns are ignored. Windows are judged on the input. Null text has no words and
    becomes empty. A document with null doc_id loses nothing and is no one's source; documents with the same doc_id
    don't count as each other's source. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("row_key"), text.alias("text"), F.xxhash64("text").alias("tie"))
    cuts = repeats(keyed.where("doc_id is not null").select("doc_id", "row_key", "text"), window)
    kind = keyed.schema["doc_id"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, cuts in zip(pdf["text"], pdf["cuts"], strict=True):
                words = text.encode("utf-8", "replace").split()
                keep = np.ones(len(words), bool)
                for c in cuts if cuts is not None else ():
                    keep[c["a"] : c["b"]] = False
                rows.append((len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode("utf-8")))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])
            yield pd.concat([pdf[["doc_id", "tie"]].reset_index(drop=True), out], axis=1)

    joined = keyed.join(cuts, "row_key", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "tie", "text", "cuts")
    out = joined.mapInPandas(run, "doc_id string, tie long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
