"""Benchmark decontamination with suffix arrays over shards of the training texts, in which all test suffixes are looked up."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import packed, table, unpacked

#: Words of one suffix array. Word numbers of a block of the benchmark stay below 2 ** BITS, so three of them make one 64-bit key.
SHARD_WORDS, BITS = 1 << 20, 21
#: Words of benchmark text that a task holds at once; a larger benchmark is looked up in several blocks. A chunk of an item.
BLOCK_WORDS, CHUNK_WORDS = 1 << 20, 1 << 16
#: Bytes of a text that are split into words at once.
SLICE = 1 << 22
#: A byte of a word is a digit, a letter (A-Z in lower case then), or part of a character beyond ASCII; all others divide.
WORD_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lower case, a slice of it at a time."""
    raw = (text or "").encode("utf-8", "replace").translate(WORD_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


class Tests(NamedTuple):
    """Distinct windows of a block of the benchmark: ``words`` of the block, numbered from 1, in one row; a window's ``start`` and
    ``size``; windows in which it stands (``at``: place in the item) by ``first`` and the next one's first."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    heads: np.ndarray
    head_size: int


def _key(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n (up to three) word numbers from each start on, in one number."""
    key = np.zeros(len(starts), np.int64)
    for j in range(n):
        key = key << BITS | words[starts + j]
    return key


def tests_of(chunks: list[tuple[int, int, int, list[bytes]]], window: int) -> Tests:
    """chunks: (number of the item, place of the first word in it, words of the whole item, words). A window is ``window``
    words, or a shorter item whole. Windows of equal words are one."""
    vocabulary: dict[bytes, int] = {}
    words = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for *_, ws in chunks for w in ws] + [0] * window, np.int64)
    starts, sizes, items, ats, base = [], [], [], [], 0
    for item, place, whole, ws in chunks:
        size = min(window, whole)
        k = np.arange(max(0, len(ws) - size + 1))
        starts.append(base + k)
        sizes.append(np.full(len(k), size))
        items.append(np.full(len(k), item))
        ats.append(place + k)
        base += len(ws)
    start, size, item, at = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, sizes, items, ats))
    full = np.where(np.arange(window) < size[:, None], words[start[:, None] + np.arange(window)], 0)
    _, one, of = np.unique(full, axis=0, return_index=True, return_inverse=True) if len(full) else (0, start, start)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(one) + 1))
    head = int(min(3, size.min())) if len(size) else 1
    return Tests(vocabulary, words, start[one], size[one], first, item[order], at[order], np.unique(_key(words, start[one], head)), head)


def suffix_array(words: np.ndarray, upto: int, depth: int, tests: Tests) -> np.ndarray:
    """Places below upto, sorted by the depth words from each on. words end in depth zeros or more; zero is a word that no
    test has, and stands between documents. Places whose first words no window begins with are left out, no search can end there."""
    places = np.flatnonzero(words[:upto])
    if not len(tests.heads):
        return places[:0]
    head = _key(words, places, tests.head_size)
    near = np.searchsorted(tests.heads, head)
    near[near == len(tests.heads)] = 0
    places = places[tests.heads[near] == head]
    return places[np.lexsort([_key(words, places + j, min(3, depth - j)) for j in range(0, depth, 3)][::-1])]


def _bound(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each test, where wanted begins (after: ends) among the sorted numbers words[lo:hi], all tests at once."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        got = words[mid]
        right = got <= wanted[open_] if after else got < wanted[open_]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


def occurrences(words: np.ndarray, tests: Tests, window: int, shard: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(places, windows): where in words the tests' windows stand, from a suffix array of each ``shard`` places; a shard
    sees the words that follow it, so nothing is lost between two."""
    places, windows = [], []
    padded = np.concatenate([words, np.zeros(window, words.dtype)]).astype(np.int64)
    for base in range(0, len(words), shard):
        piece = padded[base : base + shard + window]
        order = suffix_array(piece, min(shard, len(words) - base), window, tests)
        live = np.arange(len(tests.start))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(order), np.int64)
        for j in range(window):
            going = live[(tests.size[live] > j) & (hi[live] > lo[live])]
            wanted, column = tests.words[tests.start[going] + j], piece[order + j]
            below = _bound(column, lo[going], hi[going], wanted, False)
            hi[going] = _bound(column, below, hi[going], wanted, True)
            lo[going] = below
            live = going
        n = hi - lo
        found = np.flatnonzero(n > 0)
        at = np.repeat(lo[found] - np.cumsum(n[found]) + n[found], n[found]) + np.arange(n[found].sum())
        places.append(order[at] + base)
        windows.append(np.repeat(found, n[found]))
    return (np.concatenate(places), np.concatenate(windows)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spread(tests: Tests, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of windows, row of tests.item): each window with all items that have it."""
    n = tests.first[windows + 1] - tests.first[windows]
    row = np.repeat(np.arange(len(windows)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(tests.first[windows], n)


def _lists(doc: np.ndarray, values: list, n: int) -> list[list]:
    """values as a list for each of n documents; doc ascends."""
    cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
    return [values[a:b] for a, b in zip(cut, cut[1:])]


def look_up(sizes: list[int], words: np.ndarray, tests: Tests, items: list[str], window: int, longest: bool, shard: int = SHARD_WORDS) -> dict[str, list]:
    """Columns n_hit, spans, items, matches for documents that stand in words one after another, each followed by a zero."""
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    begins = ends - np.array(sizes, np.int64) - 1
    places, windows = occurrences(words, tests, window, shard)
    doc = np.searchsorted(ends, places, side="right")
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + tests.size[windows], -1)
    hit = np.concatenate([[0], np.cumsum(step[:-1]) > 0])
    sums = np.concatenate([[0], np.cumsum(hit[1:])])
    edge = np.flatnonzero(np.diff(np.concatenate([hit, [0]])))
    a, b = edge[::2], edge[1::2]
    of = np.searchsorted(ends, a, side="right")
    spans = [{"a": x, "b": y} for x, y in zip((a - begins[of]).tolist(), (b - begins[of]).tolist())]
    once = np.unique(doc * max(1, len(tests.start)) + windows)
    row, at = _spread(tests, once % max(1, len(tests.start)))
    pair = np.unique(once[row] // max(1, len(tests.start)) * max(1, len(items)) + tests.item[at])
    names = [items[i] for i in (pair % max(1, len(items))).tolist()]
    out = {"n_hit": sums[ends] - sums[begins], "spans": _lists(of, spans, len(sizes)), "items": _lists(pair // max(1, len(items)), names, len(sizes))}
    if longest:
        row, at = _spread(tests, windows)
        cols = doc[row], tests.item[at], places[row] - tests.at[at], places[row], tests.size[windows[row]]
        order = np.lexsort(cols[3::-1])
        d, i, way, place, size = (c[order] for c in cols)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(i) != 0) | (np.diff(way) != 0) | (np.diff(place) != 1)])[: len(d)])
        last = np.concatenate([new[1:], [len(d)]])[: len(new)] - 1
        columns = (i[new], (place - way)[new], (place - begins[d])[new], (place[last] - place[new] + size[new]))
        out["matches"] = _lists(d[new], [{"item_id": items[x[0]], "item_start": x[1], "doc_start": x[2], "n_words": x[3]} for x in zip(*(c.tolist() for c in columns))], len(sizes))
    return out


def _chunks(benchmark: DataFrame, window: int, size: int) -> DataFrame:
    """(item, place, whole, words): the words of the items, joined by blanks, in chunks that overlap by window - 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = list(chain.from_iterable(slices(text)))
                for place in range(0, max(1, len(words) - window + 1) if words else 0, size):
                    out.append((item, place, len(words), b" ".join(words[place : place + size + window - 1]).decode()))
            yield pd.DataFrame(out, columns=["item", "place", "whole", "words"])

    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return slim.mapInPandas(run, "item string, place long, whole long, words string").distinct()


def _blocks(chunks: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """chunks with the number of their block, and the number of blocks; each has at most limit words."""
    size = F.size(F.split("words", " "))
    n = 1
    while True:
        out = chunks.withColumn("block", F.pmod(F.xxhash64("item", "place", "words"), F.lit(n)))
        most = out.groupBy("block").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= limit:
            return out, n if most else 0
        n *= 2


def _pass(docs: DataFrame, block: list, window: int, longest: bool, hits_only: bool, shard_words: int) -> DataFrame:
    items = sorted({r["item"] for r in block})
    number = {item: i for i, item in enumerate(items)}
    tests = tests_of([(number[r["item"]], r["place"], r["whole"], r["words"].encode().split()) for r in block], window)
    columns = ["n_hit", "spans", "items"] + ["matches"] * longest

    def shard(rows: list[tuple], words: list[np.ndarray]) -> pd.DataFrame:
        sizes = [len(w) for w in words]
        flat = np.concatenate([x for w in words for x in (w, np.zeros(1, np.int32))])
        out = pd.DataFrame({"doc_id": [r[0] for r in rows], "tie": [r[1] for r in rows], "n_words": sizes} | look_up(sizes, flat, tests, items, window, longest, shard_words))
        return out[out["n_hit"] > 0] if hits_only else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = tests.vocabulary.get
        rows, words, held = [], [], 0
        for pdf in batches:
            for doc_id, tie, text in zip(pdf["doc_id"], pdf["tie"], pdf["text"], strict=True):
                parts = [np.array([get(w, 0) for w in ws], np.int32) for ws in slices(text)]
                rows.append((doc_id, tie))
                words.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
                held += len(words[-1]) + 1
                if held >= shard_words:
                    yield shard(rows, words)
                    rows, words, held = [], [], 0
        if rows:
            yield shard(rows, words)

    kinds = {"n_hit": "long", "spans": "array<struct<a:long,b:long>>", "items": "array<string>", "matches": "array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>"}
    return docs.mapInPandas(run, "doc_id string, tie long, n_words long, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: bool = False, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_hit, spans (word intervals hit, merged), items (ids, as strings, of items
    that have a window in the document), contaminated; with longest also ``matches``: the longest verbatim matches, each as
    the item, its first word there and in the document, and its number of words, ``window`` at least or a shorter item whole.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A word is a run of letters, digits and
    characters beyond ASCII, A-Z in lower case. A window is ``window`` words in a row of an item, or a shorter item whole;
    words in an occurrence of a window are hit. Null text has no words, nor has an item without words windows. Items are told
    apart by item_id; a null one is the empty string. Repeated rows get the same; empty tables give no row, or no hit.

    Each task sorts its own documents' words into suffix arrays of about ``shard_words`` places, in which all windows of the
    benchmark are looked up together by binary search, so no text is shuffled. What a task gets of the benchmark is at most
    ``block_words`` words. A larger benchmark is cut into blocks of whole chunks of ``chunk_words`` words of an item (far fewer), one pass over the documents each; passes after the first return the documents hit
    only. Windows that overlap on one way through document and item are one longer match.
    """
    kind = docs.schema["doc_id"].dataType
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    chunks, n = _blocks(table(_chunks(benchmark, window, chunk_words), "tests"), block_words)
    out = _pass(slim, chunks.where("block = 0").collect(), window, longest, False, shard_words)
    if n > 1:
        lists = ["spans", "items"] + ["matches"] * longest
        base = table(out, "tests-first")
        rest = [table(_pass(slim, chunks.where(F.col("block") == b).collect(), window, longest, True, shard_words), "tests-more") for b in range(1, n)]
        found = base.where("n_hit > 0")
        for r in rest:
            found = found.unionByName(r)
        found = found.dropDuplicates(["doc_id", "tie", *lists]).groupBy("doc_id", "tie").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])
        found = found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), *[F.col(c).alias(f"_{c}") for c in lists])
        both = base.select("doc_id", "tie", "n_words").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
        out = both.select("doc_id", "tie", "n_words", *[F.coalesce(f"_{c}", F.array().cast(base.schema[c].dataType)).alias(c) for c in lists])
        spans = F.aggregate(F.array_sort("spans"), F.array().cast("array<struct<a:long,b:long>>"), lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= x["a"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(done, F.lit(-1))["b"], x["b"]).alias("b"))))).otherwise(F.concat(done, F.array(x))))
        out = out.withColumn("spans", spans).withColumn("items", F.array_distinct("items"))
        out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]))
    columns = ["tie", "n_words", "n_hit", "spans", "items"] + ["matches"] * longest
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), *columns, (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that no window of the benchmark stands in, unchanged; rows of equal id and text go or stay together."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("tie").alias("_bad_tie")).distinct()
    rows = packed(docs, _id=F.col("doc_id"), _tie=F.xxhash64("text"))
    return unpacked(rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_tie") == F.col("_bad_tie")), "left_anti"), docs)
