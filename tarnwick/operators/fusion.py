"""Normalising and merging score lists. Lists have the columns document_id, sub_id, score, and q where there are
several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import RRF_K
from tarnwick.operators.search import ranked, top

ID = ["document_id", "sub_id"]


def _keys(scores: DataFrame) -> list[str]:
    return (["q"] if "q" in scores.columns else []) + ID


def _with_most(scores: DataFrame) -> DataFrame:
    """scores plus ``most``, the largest score of its query, or of all; an aggregate, so a long list is not one task."""
    if "q" in scores.columns:
        return scores.join(scores.groupBy("q").agg(F.max("score").alias("most")), "q")
    return scores.crossJoin(F.broadcast(scores.agg(F.max("score").alias("most"))))  # one row


def identity(scores: DataFrame) -> DataFrame:
    return scores


def normalize(scores: DataFrame) -> DataFrame:
    """Scores over their maximum; unchanged if that is 0."""
    most = F.col("most")
    return _with_most(scores).withColumn("score", F.when(most != 0, F.col("score") / most).otherwise(F.col("score"))).drop("most")


def normalize_if_max_gt1(scores: DataFrame) -> DataFrame:
    return _with_most(scores).withColumn("score", F.col("score") / F.greatest("most", F.lit(1.0))).drop("most")


NORMALIZERS = {"identity": identity, "normalize": normalize, "normalize_if_max_gt1": normalize_if_max_gt1}


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("score", "a").join(b.withColumnRenamed("score", "b"), _keys(a), "full")


def weighted_sum(a: DataFrame, b: DataFrame, weight_a: float = 0.5, weight_b: float = 0.5) -> DataFrame:
    score = F.coalesce("a", F.lit(0.0)) * weight_a + F.coalesce("b", F.lit(0.0)) * weight_b
    return _both(a, b).select(*_keys(a), score.alias("score"))


def average_duplicates_only(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).select(*_keys(a), F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b").alias("score"))


def reciprocal(scores: DataFrame, weight: float = 1.0, k: float = RRF_K) -> DataFrame:
    """weight / (k + position) with positions from 1."""
    by = ("q",) if "q" in scores.columns else ()
    r = ranked(scores, by) if by else scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc())))
    return r.select(*_keys(scores), (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("score"))


def rrf(a: DataFrame, b: DataFrame, weight_a: float = 1.0, weight_b: float = 1.0, k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two short lists; a list of weight 0 still brings its ids in."""
    score = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return _both(reciprocal(a, weight_a, k), reciprocal(b, weight_b, k)).select(*_keys(a), score.alias("score"))


MERGES = {"sum": weighted_sum, "average_duplicates_only": average_duplicates_only, "rrf": rrf}


def hybrid(vector: DataFrame, lexical: DataFrame, count: int, normalize_knn: str = "identity", normalize_bm25: str = "identity", merge_fn: str = "rrf", **options) -> DataFrame:
    """The best ``count`` of two lists, each cut to its own best ``count`` first."""
    a, b = NORMALIZERS[normalize_knn](top(vector, count)), NORMALIZERS[normalize_bm25](top(lexical, count))
    return top(MERGES[merge_fn](a, b, **options), count)


def with_raw_scores(merged: DataFrame, vector: DataFrame, lexical: DataFrame) -> DataFrame:
    raw = lambda s, name: s.select(*ID, F.col("score").alias(name))
    return merged.join(raw(vector, "knn_score"), ID, "left").join(raw(lexical, "bm25_score"), ID, "left")
