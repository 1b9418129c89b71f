"""Approximate and exact vector search over an inverted file: every vector in the list of its nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.search import QUERY_BLOCK, RESULT, best_of_cells, knn_of, ranked, slim_queries
from tarnwick.session import delete, new_path, table

#: Vectors that centroids are fitted on, those of least hash; lists at most. Both bound what the driver holds.
FIT_ROWS, MOST_LISTS = 50_000, 16_384
#: Rounds of the fit.
ROUNDS = 12
#: Vectors that meet the centroids at once, and rows of a list in one cell.
SNIPPET_BLOCK, ROWS_A_CELL = 8192, 65_536
#: A query that is to look into more than this share of the lists scans them all.
SCANNED = 0.25
#: Lists that a query looks into by default are as many as find this share of the nearest CALIBRATED neighbours of
#: CALIBRATING vectors of the sample, and hold so many rows for each result.
RECALL, CALIBRATED, CALIBRATING, ROWS_A_RESULT = 0.95, 10, 256, 10


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the first of equally near ones, and how far it is."""
    half = (centroids * centroids).sum(axis=1) / 2
    at = np.empty(len(vectors), np.int64)
    for i in range(0, len(vectors), SNIPPET_BLOCK):
        at[i : i + SNIPPET_BLOCK] = (vectors[i : i + SNIPPET_BLOCK] @ centroids.T - half).argmax(axis=1)
    return at, np.sqrt(((vectors - centroids[at]) ** 2).sum(axis=1))


def probes_for(vectors: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """How many of the lists nearest to a vector hold that share of its nearest neighbours, measured inside the sample, in which
    neighbours are farther apart than among all rows."""
    asked = np.linspace(0, len(vectors) - 1, min(CALIBRATING, len(vectors))).astype(np.int64)
    at, _ = _nearest(vectors, centroids)
    order = np.argsort((centroids * centroids).sum(axis=1) / 2 - vectors[asked] @ centroids.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    k = min(CALIBRATED, len(vectors) - 1)
    if not k:
        return 1
    found = []
    for i, q in enumerate(asked.tolist()):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        found.append(place[i, at[np.argpartition(-scores, k - 1)[:k]]])
    ranks = np.sort(np.concatenate(found))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def fit(snippets: DataFrame, n_lists: int | None = None, seed: int = 42) -> tuple[np.ndarray, int]:
    """Centroids by k-means on the FIT_ROWS vectors of least hash, or all where there are fewer, and how many lists a query
    looks into by default (probes_for()). n_lists: by default the root of the number of rows. Rows without a vector are left
    out. The same rows give the same centroids."""
    rows = snippets.where("embedding is not null")
    n = rows.count()
    wanted = min(MOST_LISTS, n_lists or max(1, int(n**0.5)))
    sample = rows.select(F.xxhash64("document_id", "sub_id").alias("h"), "document_id", "sub_id", F.col("embedding").cast("array<double>").alias("e"))
    got = sample.orderBy("h", "document_id", "sub_id").limit(FIT_ROWS).select("e").collect()
    if not got:
        return np.zeros((0, 0)), 0
    vectors = np.unique(np.array([r["e"] for r in got]), axis=0)
    rng = np.random.default_rng(seed)
    centroids = vectors[np.sort(rng.choice(len(vectors), min(wanted, len(vectors)), replace=False))].copy()
    for _ in range(ROUNDS):
        at, far = _nearest(vectors, centroids)
        sizes = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, vectors)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        empty = np.flatnonzero(sizes == 0)
        moved[empty] = vectors[np.argsort(-far, kind="stable")[: len(empty)]]  # an empty list begins anew at a far vector
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids, probes_for(vectors, centroids)


def assigned(snippets: DataFrame, centroids: np.ndarray) -> DataFrame:
    """snippets plus ``list``, the number of the nearest centroid, and ``far``, the distance to it."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snippets.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at, far = _nearest(np.array(pdf["embedding"].tolist(), np.float64), centroids)
                yield pdf.assign(list=at, far=far)

    return snippets.where("embedding is not null").mapInPandas(run, f"{kinds}, list int, far double")


@dataclass
class VectorIndex:
    """``path`` holds ``lists``, the rows in a partition for each list, and ``centroids``: list, centroid, probes."""

    spark: SparkSession
    path: str

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def centroids(self) -> np.ndarray:
        """At most MOST_LISTS rows."""
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()])

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/centroids").first()["probes"]

    def sizes(self) -> pd.DataFrame:
        """For each list that has rows their number and the greatest distance from the centroid; reads no vector."""
        return self.lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas()


def build(snippets: DataFrame, path: str | None = None, n_lists: int | None = None) -> VectorIndex:
    """Index of all rows of snippets (document_id, sub_id, embedding, further columns) that have a vector.

    Lists are written each to its own partition; what is rebalanced before is split where a list has many rows, so a
    list with a third of all rows is written by many tasks."""
    spark = snippets.sparkSession
    index = VectorIndex(spark, path or new_path(spark, "vector-index"))
    centroids, probes = fit(snippets, n_lists)
    if not len(centroids):
        raise ValueError("no vectors to index")
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/centroids")
    assigned(snippets, centroids).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/lists")
    return index


def refresh(index: VectorIndex, changed: DataFrame, snippets: DataFrame) -> None:
    """Brings the rows of changed documents (document_id) up to date: what the index has of them goes, snippets (with the
    index's columns) come to the lists of their nearest centroids. Only the lists touched are rewritten; their numbers,
    MOST_LISTS at most, go through the driver. Centroids stay; build() fits them anew."""
    changed = table(changed.select("document_id").distinct(), "index-changed")
    old = index.lists.join(changed, "document_id", "left_semi").select("list").distinct()
    new = table(assigned(snippets, index.centroids()), "index-new")
    touched = [r["list"] for r in old.union(new.select("list").distinct()).distinct().collect()]
    rows = index.lists.where(F.col("list").isin(touched)).join(changed, "document_id", "left_anti").unionByName(new)
    rows = table(rows, "index-next")
    rows.hint("rebalance", "list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{index.path}/lists")
    for empty in set(touched) - {r["list"] for r in rows.select("list").distinct().collect()}:
        delete(index.spark, f"{index.path}/lists/list={empty}")


def _probed(queries: DataFrame, centroids: np.ndarray, sizes: pd.DataFrame, candidates: int | None, probes: int | None, least: int, second: bool, exact: bool) -> DataFrame:
    """(q, list): the lists that each query looks into; list -1 stands for all, where it would be more than SCANNED of them.

    At first the nearest ones, ``probes`` of them, or as many as hold its candidates, or by default ``least`` at least. Then (second) the others: all if it has
    found too little (found < k), or if exact those in which some vector could be better than its last result (least).
    """
    have = np.zeros(len(centroids), np.int64)
    have[sizes["list"]] = sizes["n"]
    far = np.zeros(len(centroids))
    far[sizes["list"]] = sizes["far"]
    half = (centroids * centroids).sum(axis=1) / 2

    def lists_of(v: np.ndarray, k: int) -> np.ndarray:
        near = np.argsort(half - centroids @ v, kind="stable")
        near = near[have[near] > 0]
        if probes is not None:
            return near[:probes]
        enough = int(np.searchsorted(np.cumsum(have[near]), candidates if candidates is not None else ROWS_A_RESULT * k)) + 1
        return near[: max(enough, least if candidates is None else 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                v = np.array(r.vec, np.float64)
                lists = lists_of(v, r.k)
                if second:
                    rest = np.setdiff1d(np.flatnonzero(have), lists)
                    if r.found >= r.k:
                        most = np.minimum(centroids[rest] @ v + np.sqrt(v @ v) * far[rest], 1.0)  # by Cauchy and Schwarz
                        rest = rest[(1 + most) / 2 + 1e-9 >= r.least] if exact else rest[:0]
                    lists = rest if len(rest) <= SCANNED * len(sizes) else [-1]
                out += [(r.q, int(i)) for i in lists]
            yield pd.DataFrame(out, columns=["q", "list"])

    names = [n for n in ("q", "vec", "k", "found", "least") if n in queries.columns]
    return queries.select(*names).mapInPandas(run, "q string, list int")


def _looked_up(rows: DataFrame, slim: DataFrame, asked: DataFrame, sizes: pd.DataFrame) -> DataFrame:
    """The best rows of the lists asked for (q, list), k for each query and cell, with k. Only those lists are read: their
    numbers, MOST_LISTS at most, prune the partitions. A list's rows and queries are dealt over as many parts as they need."""
    counts = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asked")).toPandas().merge(sizes[["list", "n"]], on="list")
    parts = [(int(r.list), int(-(-r.n // ROWS_A_CELL)), int(-(-r.asked // QUERY_BLOCK))) for r in counts.itertuples()]
    dealt = F.broadcast(asked.sparkSession.createDataFrame(parts, "list int, row_parts int, query_parts int"))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = (F.col("list").cast("long") * (1 << 24) + F.col("row_part")) * (1 << 24) + F.col("query_part")
    rows = rows.where(F.col("list").isin([p[0] for p in parts])).join(dealt, "list")
    rows = rows.withColumn("row_part", deal("row_parts", "document_id", "sub_id")).withColumn("query_part", every("query_parts"))
    queries = asked.join(slim, "q").join(dealt, "list").withColumn("query_part", deal("query_parts", "q")).withColumn("row_part", every("row_parts"))
    return best_of_cells(queries.withColumn("cell", cell), rows.withColumn("cell", cell))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, candidates: int | None = None, probes: int | None = None, condition: Column | None = None, shown: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(q, document_id, sub_id, score) as knn() gives it, of the vectors in the lists nearest to each query.

    queries: q, vec, and optionally k and exclude, as for knn(). Lists are probed in order of nearness: ``probes`` of them, or until
    they hold ``candidates`` rows, or by default as many as the index has found to give a recall of 0.95 in its sample. condition filters rows before the
    top k, on any column of the index, and shown (document_id, sub_id) by their ids. A query that finds fewer than k rows, because of the condition or what it excludes, looks
    into all other lists, so results are as many as exist. With exact, each query also looks into every list that may hold
    something better than its last result, by the distances of queries and vectors to the centroids: the result is
    that of knn(). Rows stream past the queries of their list, part by part; a list is never gathered into one task. A query
    that is to look into many lists scans all rows, as all do where all lists are probed.
    """
    slim = slim_queries(queries, k)
    centroids, sizes, usual = index.centroids(), index.sizes(), index.probes()
    rows = index.lists if condition is None else index.lists.where(condition)
    rows = rows if shown is None else rows.join(shown.select("document_id", "sub_id"), ["document_id", "sub_id"], "left_semi")
    if (probes is not None and probes >= len(sizes)) or (probes is None and candidates is not None and candidates >= sizes["n"].sum()):
        return knn_of(rows, slim)
    first = table(_probed(slim, centroids, sizes, candidates, probes, usual, False, exact), "knn-probes")
    found = table(ranked(_looked_up(rows, slim, first, sizes)).where("rank <= k").drop("rank", "k"), "knn-found")
    have = found.groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    lacking = slim.join(have, "q", "left").na.fill({"found": 0, "least": -1.0})
    more = table(_probed(lacking, centroids, sizes, candidates, probes, usual, True, exact), "knn-more")
    if more.isEmpty():
        return found
    all_lists = more.where("list = -1").select("q")
    scanned = knn_of(rows, table(slim.join(all_lists, "q", "left_semi").select(*slim.columns), "knn-scanning"))
    second = _looked_up(rows, slim, more.where("list >= 0"), sizes).drop("k").unionByName(found.join(all_lists, "q", "left_anti"))
    second = ranked(second.join(slim.select("q", "k"), "q")).where("rank <= k")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return second.select(*names).unionByName(scanned.select(*names))
