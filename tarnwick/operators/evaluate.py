"""Offline quality: nDCG, click replay, interest matches, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranking: DataFrame, ks: tuple = (5, 10), group: str = "q") -> DataFrame:
    """(group, ndcg_at_k...) of ranking (group, rank, relevance): gain 2^rel - 1, discount log2(rank + 1), 1e-5 added to
    the ideal; a k beyond the list's length takes the whole list."""
    ideal = Window.partitionBy(group).orderBy(F.col("relevance").desc(), F.col("rank"))
    r = ranking.withColumn("ideal", F.row_number().over(ideal))
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    got = lambda at, k: F.sum(F.when(F.col(at) <= k, gain / F.log2(F.col(at) + F.lit(1.0))).otherwise(0.0))
    return r.groupBy(group).agg(*[(got("rank", k) / (got("ideal", k) + 1e-5)).alias(f"ndcg_at_{k}") for k in ks])


def parse_clicks(impressions: DataFrame) -> DataFrame:
    """impressions (impression_id, log) with logs of "document-label" items -> (impression_id, document_id, clicked)."""
    each = impressions.select("impression_id", F.explode(F.split("log", " ")).alias("item")).where("item <> ''")
    return each.select("impression_id", F.split_part("item", F.lit("-"), F.lit(1)).alias("document_id"), (F.split_part("item", F.lit("-"), F.lit(2)) == "1").cast("int").alias("clicked"))


def replay(ranked: DataFrame, clicks: DataFrame, ks: tuple = (5, 10)) -> DataFrame:
    """nDCG per impression of ranked (impression_id, document_id, rank) against the recorded clicks."""
    joined = ranked.join(clicks, ["impression_id", "document_id"]).select("impression_id", "rank", F.col("clicked").alias("relevance"))
    return ndcg(joined, ks, "impression_id")


def choose(rows: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """n rows chosen by the hash of a key and a seed: the same ones in every run."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def happens(probability: float, key: Column, seed: int = 42) -> Column:
    """A reproducible coin flip per key, by a digest that every engine has."""
    digest = F.md5(F.concat_ws("#", key, F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % 1_000_000 < int(probability * 1_000_000)


def saturation(recommended: DataFrame, categories: DataFrame) -> DataFrame:
    """(iteration, saturation): the share of recommended documents in each iteration's most frequent category."""
    per = recommended.join(categories, "document_id").groupBy("iteration", "category").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("iteration").agg((F.max("n") / F.sum("n")).alias("saturation"))
