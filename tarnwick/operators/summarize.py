"""Extractive summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import segment

# Lengths in bytes of the sentences that count, sentences of a summary, sizes of the long-text path.
SHORTEST, LONGEST, SENTENCES = 50, 1500, 4
MOST_AT_ONCE, CHUNK, FROM_CHUNK = 2000, 500, 100

WORD = re.compile(r"\S+", re.ASCII)


def _overlaps(words: list[set[str]]) -> np.ndarray:
    """For each set of words, the sum over later ones of |common words|^3, from the places of each word."""
    places: dict[str, list[int]] = {}
    for n, ws in enumerate(words):
        for w in ws:
            places.setdefault(w, []).append(n)
    where = {w: np.array(at) for w, at in places.items() if len(at) > 1}
    out = np.zeros(len(words), np.int64)
    for n, ws in enumerate(words):
        at = [where[w] for w in ws if w in where]
        if at:
            out[n] = (np.bincount(np.concatenate(at), minlength=len(words))[n + 1 :].astype(np.int64) ** 3).sum()
    return out


def _kept(sentences: list[str]) -> dict[int, int]:
    """Sizes in bytes of the sentences between SHORTEST and LONGEST, by position; of them only those at positions below
    the number of such sentences."""
    sizes = {i: n for i, s in enumerate(sentences) if SHORTEST < (n := len(s.encode("utf-8", "replace"))) < LONGEST}
    return {i: n for i, n in sizes.items() if i < len(sizes)}


def sentence_scores(sentences: list[str]) -> dict[int, float]:
    """By position in the text: the sum over later kept sentences of |common words|^3, over length^5."""
    kept = _kept(sentences)
    shared = _overlaps([set(sentences[i].lower().split()) for i in kept])
    return {i: int(n) / size**5 * 1e10 for (i, size), n in zip(kept.items(), shared, strict=True)}


def _best(scores: dict[int, float], n: int) -> list[int]:
    order = sorted((i for i, s in scores.items() if s > 0), key=lambda i: (-scores[i], i))
    return sorted(order[:n])


def summarize_one(text: str | None) -> str:
    """The best SENTENCES sentences in their order; the whole text if there are none. Very long texts are first
    reduced chunk by chunk, in order."""
    text = text or ""
    sentences = [s.strip() for s in text.split(".")]
    while len(sentences) > MOST_AT_ONCE:
        reduced = [s for i in range(0, len(sentences), CHUNK) for s in _picked(sentences[i : i + CHUNK], FROM_CHUNK)]
        if len(reduced) >= len(sentences):
            break
        sentences = reduced
    picked = _picked(sentences, SENTENCES)
    return ".\n".join(picked) if picked else text


def _picked(sentences: list[str], n: int) -> list[str]:
    return [sentences[i] for i in _best(sentence_scores(sentences), n)]


def summarized(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([summarize_one(t) for t in texts])

    return run(text)


def sentence_overlap(docs: DataFrame) -> DataFrame:
    """(document_id, i, shared, size) of the kept sentences of each document: the sum over later sentences of
    |common words|^3, and the length in bytes; shared / size^5 is the sentence's score. No shuffle: a text is one row."""
    schema = docs.select("document_id").withColumns({n: F.lit(0).cast("long") for n in ("i", "shared", "size")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for document_id, text in zip(pdf["document_id"], pdf["text"], strict=True):
                sentences = [s.strip(" ") for s in (text or "").split(".")]
                kept = _kept(sentences)
                shared = _overlaps([set(WORD.findall(sentences[i].lower())) for i in kept])
                rows += [(document_id, i, n, size) for (i, size), n in zip(kept.items(), shared, strict=True)]
            yield pd.DataFrame(rows, columns=schema.names)

    return docs.select("document_id", "text").mapInPandas(run, schema)


class Likeness:
    """The graph of sentences whose weights are 1 - cosine of their word counts, none from a sentence to itself, without its
    matrix: with U the unit vectors as rows, it is all ones less U times its transpose, and a product takes the words of the
    sentences only. A sentence without words has a weight of 1 to all others."""

    def __init__(self, sentences: list[list[str]]):
        self.n = len(sentences)
        vocabulary: dict[str, int] = {}
        rows = np.repeat(np.arange(self.n), [len(s) for s in sentences])
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for s in sentences for w in s], np.int64)
        pairs, counts = np.unique(rows * max(1, len(vocabulary)) + words, return_counts=True)
        self.rows, self.words = pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary))
        norms = np.sqrt(np.bincount(self.rows, weights=counts.astype(np.float64) ** 2, minlength=self.n))
        self.values = counts / norms[self.rows]
        self.wordless = (norms == 0).astype(np.float64)
        self.n_words = len(vocabulary)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.words, weights=self.values * x[self.rows], minlength=self.n_words)
        return x.sum() - np.bincount(self.rows, weights=self.values * by_word[self.words], minlength=self.n) - self.wordless * x


def pagerank(weights: Likeness, damping: float = 0.85, tolerance: float = 1e-3) -> np.ndarray:
    """Ranks by the power method; columns are divided by their sums, one that sums to nothing flows evenly. Weights are symmetric."""
    n = weights.n
    sums = weights @ np.ones(n)
    flows = sums > 1e-9 * n
    rank = np.full(n, 1 / n)
    for _ in range(1000):
        new = (1 - damping) / n + damping * (weights @ np.divide(rank, sums, out=np.zeros(n), where=flows) + rank[~flows].sum() / n)
        if np.abs(new - rank).sum() < tolerance:
            return new
        rank = new
    return rank


def summarize_ranked_one(text: str | None, n: int = 4) -> str:
    """The first n sentences whose rank is at least the (n + 2)-th largest. Memory grows with the words of the text."""
    found = segment.sentences(text or "")
    if len(found) <= n:
        return text or ""
    rank = pagerank(Likeness([[w.lower() for w in segment.words(s)] for s in found]))
    least = np.sort(rank)[::-1][min(n + 1, len(rank) - 1)] - 1e-12  # equal sentences have equal ranks, but for rounding
    return "".join([s for s, r in zip(found, rank, strict=True) if r >= least][:n])


def summarized_by_rank(text: Column, n: int = 4) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([summarize_ranked_one(t, n) for t in texts])

    return run(text)
