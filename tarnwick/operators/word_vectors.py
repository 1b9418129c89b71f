"""Word vectors learnt from a corpus: co-occurrence counts, positive pointwise mutual information, truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.values import tokens
from tarnwick.operators.embed import Embedder
from tarnwick.session import table

#: Words that get a vector, the most frequent ones; bounds the matrices that the driver and tasks hold (words * columns numbers).
MOST_WORDS = 50_000
#: Words to either side that count as context; documents that a word must be in; how much rarer than by chance a pair may be and still count.
WINDOW, LEAST_COUNT, SHIFT = 4, 5, 1.0
#: Columns beside those wanted, and passes over the matrix, of the randomised decomposition.
EXTRA, PASSES = 16, 2
#: Rows of the matrix that are multiplied together.
BLOCK = 1024
#: Words as frequent as this count half in a text.
HALF = 1e-3


def vocabulary(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n (its occurrences), i (its place by frequency, ties by word), for the ``most`` most frequent words."""
    counts = docs.select(F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    return docs.sparkSession.createDataFrame([(r["word"], r["n"], i) for i, r in enumerate(top)], "word string, n long, i int")


def co_occurrences(docs: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """i, j, n: how often words i and j stand within ``window`` words of each other, both ways; i may equal j. Tokens that have no
    vector are counted as places. Only pairs of words with vectors are counted, by number, in each task before they are shuffled."""
    known = F.broadcast(words.select("word", "i"))  # MOST_WORDS rows at most
    t = docs.select(F.monotonically_increasing_id().alias("doc"), tokens(F.coalesce("text", F.lit(""))).alias("t"))
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda o: F.transform(F.slice("t", 1, F.greatest(F.size("t") - o, F.lit(0))), lambda w, k: F.struct(w.alias("a"), F.get("t", k + o).alias("b")))))
    pairs = t.select(F.explode(near).alias("p")).select("p.a", "p.b")
    pairs = pairs.join(known.select(F.col("word").alias("a"), F.col("i").alias("x")), "a").join(known.select(F.col("word").alias("b"), F.col("i").alias("y")), "b")
    pairs = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.col("y").alias("i"), F.col("x").alias("j")))
    return pairs.select(F.explode(ways).alias("w"), "n").groupBy("w.i", "w.j").agg(F.sum("n").alias("n"))


def information(pairs: DataFrame, shift: float = SHIFT) -> DataFrame:
    """i, j, v: log of how much more often i and j meet than by chance, less log(shift), where that is positive."""
    rows = pairs.groupBy("i").agg(F.sum("n").alias("ni"))
    total = pairs.agg(F.sum("n").cast("double").alias("all"))
    both = pairs.join(F.broadcast(rows), "i").join(F.broadcast(rows.withColumnsRenamed({"i": "j", "ni": "nj"})), "j")  # MOST_WORDS rows at most
    value = F.log(F.col("n") * F.col("all") / (F.col("ni").cast("double") * F.col("nj"))) - F.log(F.lit(shift))
    return both.crossJoin(F.broadcast(total)).select("i", "j", value.alias("v")).where("v > 0")  # total: one row


def _product(matrix: DataFrame, n: int, x: np.ndarray) -> np.ndarray:
    """The matrix (block, rows, columns, values: BLOCK rows each) times x, block by block; n * columns of x numbers come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, i, j, v in pdf.itertuples(index=False):
                part = np.zeros((BLOCK, x.shape[1]))
                np.add.at(part, np.asarray(i), np.asarray(v)[:, None] * x[np.asarray(j)])
                out.append((block, part.tobytes()))
            yield pd.DataFrame(out, columns=["block", "part"])

    out = np.zeros((-(-n // BLOCK) * BLOCK, x.shape[1]))
    for r in matrix.select("block", "rows", "columns", "values").mapInPandas(run, "block int, part binary").toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["part"]).reshape(BLOCK, -1)
    return out[:n]


def decompose(matrix: DataFrame, n: int, dim: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Leading left singular vectors and values of a symmetric matrix (i, j, v) of n rows, by a random range finder with PASSES
    power steps. A row's entries are dealt over parts, so a word that meets all others is not one group."""
    part = F.pmod(F.xxhash64("j"), F.lit(16))
    packed = matrix.select((F.col("i") / BLOCK).cast("int").alias("block"), (F.col("i") % BLOCK).alias("row"), "j", "v", part.alias("part"))
    lists = [F.collect_list(F.struct("row", "j", "v")).alias("e")]
    packed = packed.groupBy("block", "part").agg(*lists).select("block", F.col("e.row").alias("rows"), F.col("e.j").alias("columns"), F.col("e.v").alias("values"))
    packed = table(packed, "word-matrix")
    k = min(n, dim + EXTRA)
    x = np.random.default_rng(seed).standard_normal((n, k))
    for _ in range(PASSES + 1):
        x, _r = np.linalg.qr(_product(packed, n, x))
    small, values, _ = np.linalg.svd(x.T @ _product(packed, n, x))
    d = min(dim, k)
    u = x @ small[:, :d]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(d)])
    return u * np.where(sign == 0, 1, sign), values[:d]


@dataclass(frozen=True)
class WordVectors:
    """Vectors of words, and the weight with which each counts in a text: frequent words count less."""

    words: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray

    def encode(self, texts: list[str]) -> np.ndarray:
        """The weighted mean of the vectors of all words of each text; zeros where none is known."""
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for row, text in enumerate(texts):
            at = np.array([i for w in _tokens(text) if (i := self.words.get(w)) is not None], np.int64)
            if len(at):
                out[row] = self.weights[at] @ self.vectors[at] / self.weights[at].sum()
        return out

    def embedder(self, prefix: str = "") -> Embedder:
        return Embedder(self.vectors.shape[1], prefix, encode=self.encode)


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def train(docs: DataFrame, dim: int = 64, most: int = MOST_WORDS, least: int = LEAST_COUNT, seed: int = 42) -> WordVectors:
    """Vectors of dim numbers for the most frequent words of docs (text). Texts are read twice, and only counts of words and pairs leave the
    tasks. Null texts have no words; a corpus without words that are frequent enough has no vectors. Reruns agree."""
    words = vocabulary(docs, most, least)
    known = [(r["word"], r["n"]) for r in words.orderBy("i").collect()]
    if not known:
        return WordVectors({}, np.zeros((0, dim)), np.zeros(0))
    matrix = table(information(co_occurrences(docs, words)), "word-information")
    u, values = decompose(matrix, len(known), dim, seed)
    vectors = np.zeros((len(known), dim))
    vectors[:, : u.shape[1]] = u * np.sqrt(values)
    share = np.array([n for _, n in known], np.float64)
    return WordVectors({w: i for i, (w, _) in enumerate(known)}, vectors, HALF / (HALF + share / share.sum()))
