"""Exclusions, histories, search by interests and reranking; all for many users at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.config import MAX_HISTORY, MAX_HISTORY_FOR_INTERESTS, RECOMMENDATION_WEIGHTS, RRF_K
from tarnwick.operators import interests as ci
from tarnwick.operators.search import knn
from tarnwick.session import table


def seen_documents(interactions: DataFrame) -> DataFrame:
    return interactions.select("user_id", "document_id").distinct()


def exclude_documents(rows: DataFrame, documents: DataFrame, on: tuple = ("document_id",)) -> DataFrame:
    """rows without the documents (or, on document_id and sub_id, snippets) listed."""
    return rows.join(documents.select(*on).distinct(), list(on), "left_anti")


def last_seen(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.max("time_stamp").alias("last_seen"))


def tag_weights(interactions: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag, weight): how often documents with the tag were interacted with; a tag that a document has twice
    counts twice. tags: document_id, tags."""
    each = interactions.join(tags.select("document_id", "tags"), "document_id").select("user_id", F.explode("tags").alias("tag"))
    return each.groupBy("user_id", "tag").agg(F.count(F.lit(1)).alias("weight"))


def tag_scores(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_id, document_id, sub_id, score): the share of the user's tag weight that the document's tags have. Users
    whose weights sum to 0 have no scores. pairs: user_id, document_id, sub_id, tags."""
    held = weights.groupBy("user_id").agg(F.sum("weight").alias("total"), F.map_from_entries(F.collect_list(F.struct("tag", "weight"))).alias("w")).where("total > 0")
    got = F.aggregate(F.transform("tags", lambda t: F.coalesce(F.element_at("w", t), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.join(held, "user_id").select("user_id", "document_id", "sub_id", (got / F.col("total")).alias("score"))


def backfill_history(history: DataFrame, now: Column) -> DataFrame:
    """history (user_id, pos, document_id, sub_id, time_stamp), oldest first by pos: a missing time becomes that of the
    next newer entry, or now. ``warned`` marks entries that are later than their successor."""
    after = Window.partitionBy("user_id").orderBy("pos")
    later = after.rowsBetween(0, Window.unboundedFollowing)
    filled = history.withColumn("time_stamp", F.coalesce(F.first("time_stamp", ignorenulls=True).over(later), now))
    return filled.withColumn("warned", F.coalesce(F.col("time_stamp") > F.lead("time_stamp").over(after), F.lit(False)))


def trim_history(history: DataFrame, most: int = MAX_HISTORY, for_interests: int = MAX_HISTORY_FOR_INTERESTS) -> DataFrame:
    """The newest entries of each user; ``used`` marks the newest ones, from which interests are derived."""
    newest = Window.partitionBy("user_id").orderBy(F.col("pos").desc())
    return history.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most).withColumn("used", F.col("age") <= for_interests).drop("age")


def load_history(history: DataFrame, snippets: DataFrame) -> DataFrame:
    """history ⋈ snippets: unknown ids are dropped; of a repeated snippet the newest entry stays."""
    newest = Window.partitionBy("user_id", "document_id", "sub_id").orderBy(F.col("time_stamp").desc(), F.col("pos").desc())
    once = history.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    return once.join(snippets, ["document_id", "sub_id"])


def gate(users: DataFrame, interests: DataFrame, least: int) -> DataFrame:
    """users with enough centres of interest."""
    counts = interests.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return users.join(counts.select("user_id"), "user_id", "left_semi")


def search_by_interests(snippets: DataFrame, top: DataFrame, seen: DataFrame | None, count: int, candidates: int, nearest: Callable[[DataFrame, DataFrame], DataFrame] = knn) -> DataFrame:
    """(user_id, document_id, sub_id, score): one list per centre, as long as its share of the count, each fused by
    1 / (60 + position) and summed. top: user_id, coi_id, point, weight (of the top centres, summing to 1).

    The search fetches max(ceil(weight * candidates), that share) rows and keeps the share, which is the head of it,
    so only the share is asked for. seen documents never come back. nearest: knn(), or a search of an index.
    """
    k = F.ceil(F.col("weight") * count)
    q = top.select(F.to_json(F.struct("user_id", "coi_id")).alias("q"), F.col("point").alias("vec"), F.greatest(F.least(k, F.lit(count)), F.lit(1)).cast("int").alias("k"), "user_id")
    if seen is not None:
        lists = seen.groupBy("user_id").agg(F.collect_set("document_id").alias("exclude"))
        q = q.join(lists, "user_id", "left")
    hits = nearest(snippets, q.drop("user_id"))
    at = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc())
    hits = hits.withColumn("rrf", 1 / (F.lit(RRF_K) + F.row_number().over(at))).withColumn("user_id", F.get_json_object("q", "$.user_id"))
    return hits.groupBy("user_id", "document_id", "sub_id").agg(F.sum("rrf").alias("score"))


def rerank(rows: DataFrame, interest: DataFrame, tags: DataFrame, weights: tuple = RECOMMENDATION_WEIGHTS) -> DataFrame:
    """rows (user_id, document_id, sub_id, score) with new scores: the weighted reciprocal ranks by interest, tag weight
    and search score, summed in this order. A row without a score in one list gets nothing from it."""
    key = ["user_id", "document_id", "sub_id"]
    out = rows.join(interest.select(*key, F.col("score").alias("s_interest")), key, "left").join(tags.select(*key, F.col("score").alias("s_tag")), key, "left")

    def part(score: str, weight: float) -> Column:
        w = Window.partitionBy("user_id").orderBy(F.col(score).desc_nulls_last(), F.col("document_id").desc(), F.col("sub_id").desc())
        return F.when(F.col(score).isNull(), F.lit(0.0)).otherwise(F.lit(weight) / (F.lit(RRF_K) + F.row_number().over(w)))

    return out.select(*key, (part("s_interest", weights[0]) + part("s_tag", weights[1]) + part("score", weights[2])).alias("score"))


def best_per_user(rows: DataFrame, count: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("document_id").desc(), F.col("sub_id").desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def recommend(snippets: DataFrame, interests: DataFrame, weights: DataFrame, seen: DataFrame | None, now: Column, count: int, candidates: int, horizon_days: int = 30, least: int = 1, nearest: Callable[[DataFrame, DataFrame], DataFrame] = knn) -> DataFrame:
    """(user_id, document_id, sub_id, score, rank) for all users with at least ``least`` centres. snippets: document_id,
    sub_id, embedding, tags; interests as fold_interactions() gives them."""
    users = gate(interests.select("user_id").distinct(), interests, least)
    relevant = table(ci.relevance(interests.join(users, "user_id", "left_semi"), now, horizon_days), "interests")
    top = ci.top_interests(ci.weights(relevant))
    found = table(search_by_interests(snippets, top, seen, count, candidates, nearest), "found")
    pairs = found.join(snippets.select("document_id", "sub_id", "embedding", "tags"), ["document_id", "sub_id"])
    scored = rerank(found, ci.interest_scores(pairs, relevant), tag_scores(pairs, weights))
    return best_per_user(scored, count)
