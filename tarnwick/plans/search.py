"""Queries of vector and lexical search, fusion and filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import filters, fusion, personalize
from tarnwick.operators.search import bm25, knn, ranked, top
from tarnwick.plans.common import with_corpus
from tarnwick.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TEXT = "the attion thanedble"
#: The one-query examples search with this document's vector.
QUERY_ID = "1"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _vector(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.snippets(spark, sf).where(F.col("document_id") == QUERY_ID).select(F.lit("q").alias("q"), F.col("embedding").cast("array<double>").alias("vec"))


def _scored(df: DataFrame) -> DataFrame:
    return df.select("document_id", F.round("score", 6).alias("score"))


def _condition(filter_json: dict | None, after: str | None = None, columns: bool = False) -> Column:
    tree = filters.published_after(filters.parse(filter_json), after)
    return filters.compile_filter(tree, corpus.SCHEMA, corpus.by_columns() if columns else corpus.by_variant())


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.snippets_of_documents(spark, sf).where("is_candidate")


KNN_SQL = """
SELECT document_id, round((1 + greatest(least(list_dot_product(e, (SELECT e FROM snip WHERE document_id = '1')), 1), -1)) / 2, 6) AS score
FROM snip s WHERE is_candidate AND document_id <> '1'{where} ORDER BY list_dot_product(e, (SELECT e FROM snip WHERE document_id = '1')) DESC, document_id DESC LIMIT 10"""


@query(with_corpus(KNN_SQL.format(where="")))
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf).where(F.col("document_id") != QUERY_ID)
    return _scored(knn(rows, _vector(spark, sf), 10))


@query(with_corpus(KNN_SQL.format(where=" AND lang = 'en' AND n_chars >= 500")))
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    condition = _condition({"$and": [{"lang": {"$eq": "en"}}, {"n_chars": {"$gte": 500}}]}, columns=True)
    rows = _candidates(spark, sf).where(condition & (F.col("document_id") != QUERY_ID))
    return _scored(knn(rows, _vector(spark, sf), 10))


@query(with_corpus(KNN_SQL.format(where="")))
def knn_by_snippet_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """A search by snippet leaves out that snippet only."""
    own = _vector(spark, sf).select(F.lit(QUERY_ID).alias("document_id"), F.lit(0).cast("long").alias("sub_id"))
    rows = personalize.exclude_documents(_candidates(spark, sf), own, ("document_id", "sub_id"))
    return _scored(knn(rows, _vector(spark, sf), 10))


@query(with_corpus("""
SELECT q, document_id, round(score, 6) AS score, rank FROM (
  SELECT q.document_id AS q, s.document_id, (1 + greatest(least(list_dot_product(s.e, q.e), 1), -1)) / 2 AS score,
         row_number() OVER (PARTITION BY q.document_id ORDER BY (1 + greatest(least(list_dot_product(s.e, q.e), 1), -1)) / 2 DESC, s.document_id DESC) AS rank
  FROM snip s, snip q WHERE q.document_id::BIGINT % 20 = 0 AND s.is_candidate AND s.document_id <> q.document_id
) WHERE rank <= 10"""))  # fmt: skip
def knn_many(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, each without itself, against all candidates."""
    s = corpus.snippets_of_documents(spark, sf)
    q = s.where(F.col("document_id").cast("long") % 20 == 0)
    q = q.select(F.col("document_id").alias("q"), F.col("embedding").cast("array<double>").alias("vec"), F.array("document_id").alias("exclude"))
    out = ranked(knn(s.where("is_candidate"), q, 10))
    return out.select("q", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(with_corpus("""
SELECT q AS user_id, document_id, round(score, 6) AS score FROM (
  SELECT u.user_id AS q, s.document_id, (1 + greatest(least(list_dot_product(s.e, v.e), 1), -1)) / 2 AS score,
         row_number() OVER (PARTITION BY u.user_id ORDER BY (1 + greatest(least(list_dot_product(s.e, v.e), 1), -1)) / 2 DESC, s.document_id DESC) AS rank
  FROM (SELECT DISTINCT user_id FROM inter) u, snip s, (SELECT e FROM snip WHERE document_id = '1') v
  WHERE s.is_candidate AND NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = u.user_id AND i.document_id = s.document_id)
) WHERE rank <= 5"""))  # fmt: skip
def knn_exclude_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The same search for every user, without what each has seen."""
    seen = corpus.interactions(spark, sf).groupBy(F.col("user_id").alias("q")).agg(F.collect_set("document_id").alias("exclude"))
    q = seen.crossJoin(F.broadcast(_vector(spark, sf).select("vec")))  # one row
    out = knn(_candidates(spark, sf), q, 5)
    return out.select(F.col("q").alias("user_id"), "document_id", F.round("score", 6).alias("score"))


BM25_SQL = """, tok AS (
  SELECT document_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t, lang, n_chars, e FROM snip WHERE is_candidate
), tf AS (
  SELECT document_id, lang, n_chars, e, len(t)::DOUBLE AS dl, len(list_filter(t, lambda x: x = 'the'))::DOUBLE AS a, len(list_filter(t, lambda x: x = 'attion'))::DOUBLE AS b,
         len(list_filter(t, lambda x: x = 'thanedble'))::DOUBLE AS c FROM tok
), st AS (
  SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM tf
), lex AS (
  SELECT * FROM (SELECT document_id, lang,
    ln(1 + (n - da + .5) / (da + .5)) * a * 2.2 / (a + 1.2 * (.25 + .75 * dl / avgdl)) + ln(1 + (n - db + .5) / (db + .5)) * b * 2.2 / (b + 1.2 * (.25 + .75 * dl / avgdl))
    + ln(1 + (n - dc + .5) / (dc + .5)) * c * 2.2 / (c + 1.2 * (.25 + .75 * dl / avgdl)) AS score FROM tf, st) WHERE score > 0
), l AS (
  SELECT document_id, score FROM lex ORDER BY score DESC, document_id DESC LIMIT 20
), v AS (
  SELECT document_id, (1 + greatest(least(list_dot_product(e, (SELECT e FROM snip WHERE document_id = '1')), 1), -1)) / 2 AS score FROM snip WHERE is_candidate
  ORDER BY score DESC, document_id DESC LIMIT 20
)"""


def _with_lists(body: str) -> str:
    return with_corpus(BM25_SQL + body)


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _candidates(spark, sf)
    return knn(rows, _vector(spark, sf), 20).drop("q"), bm25(rows, TEXT)


@query(_with_lists(" SELECT document_id, round(score, 6) AS score FROM l"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(top(bm25(_candidates(spark, sf), TEXT), 20))


@query(_with_lists(" SELECT document_id, round(score, 6) AS score FROM lex WHERE lang = 'fr' ORDER BY lex.score DESC, document_id DESC LIMIT 20"))
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A filter never changes scores."""
    return _scored(top(bm25(_candidates(spark, sf), TEXT, F.col("lang") == "fr"), 20))


RANKED = "(SELECT *, row_number() OVER (ORDER BY score DESC, document_id DESC) AS r FROM {})"
FUSED = " SELECT document_id, round(score, 6) AS score FROM (SELECT document_id, {} AS score FROM v FULL JOIN l USING (document_id)) t ORDER BY t.score DESC, document_id DESC LIMIT 20"
RRF = "coalesce(1 / (60.0::DOUBLE + x.r), 0) + coalesce(1 / (60.0::DOUBLE + y.r), 0)"
RRF_SQL = f" SELECT document_id, round(score, 6) AS score FROM (SELECT document_id, {RRF} AS score FROM {RANKED.format('v')} x FULL JOIN {RANKED.format('l')} y USING (document_id)) t ORDER BY t.score DESC, document_id DESC LIMIT 20"


@query(_with_lists(RRF_SQL))
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(fusion.hybrid(*_lists(spark, sf), 20))


@query(_with_lists(FUSED.format("coalesce(v.score, 0) * .5 + coalesce(l.score, 0) * .5")))
def hybrid_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(fusion.hybrid(*_lists(spark, sf), 20, merge_fn="sum"))


@query(_with_lists(FUSED.format("coalesce((v.score / (SELECT max(score) FROM v) + l.score / (SELECT max(score) FROM l)) / 2, v.score / (SELECT max(score) FROM v), l.score / (SELECT max(score) FROM l))")))
def hybrid_avg_dup(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(fusion.hybrid(*_lists(spark, sf), 20, "normalize", "normalize", "average_duplicates_only"))


@query(_with_lists(FUSED.format("coalesce(v.score / greatest((SELECT max(score) FROM v), 1), 0) * .5 + coalesce(l.score / greatest((SELECT max(score) FROM l), 1), 0) * .5")))
def hybrid_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(fusion.hybrid(*_lists(spark, sf), 20, "normalize_if_max_gt1", "normalize_if_max_gt1", "sum"))


@query(_with_lists(f" SELECT t.document_id, round(t.score, 6) AS score, round(v.score, 6) AS knn_score, round(lex.score, 6) AS bm25_score FROM (SELECT document_id, {RRF} AS score FROM {RANKED.format('v')} x FULL JOIN {RANKED.format('l')} y USING (document_id) ORDER BY score DESC, document_id DESC LIMIT 20) t LEFT JOIN v USING (document_id) LEFT JOIN lex USING (document_id)"))
def hybrid_raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    vector, lexical = _lists(spark, sf)
    out = fusion.with_raw_scores(fusion.hybrid(vector, lexical, 20), vector, lexical)
    return out.select("document_id", *[F.round(c, 6).alias(c) for c in ("score", "knn_score", "bm25_score")])


def _filter_query(name: str, filter_json: dict | None, sql: str, after: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = corpus.with_properties(corpus.documents(spark, sf))
        return docs.where(_condition(filter_json, after)).select("document_id", "lang", "n_chars", "publication_date")

    QUERIES[name] = run
    ORACLE_SQL[name] = with_corpus(f" SELECT document_id, lang, n_chars, publication_date FROM doc WHERE {sql}")


_filter_query("filter_eq", {"lang": {"$eq": "fr"}}, "lang = 'fr'")
_filter_query("filter_in", {"lang": {"$in": ["fr", "de"]}}, "lang IN ('fr', 'de')")
_filter_query("filter_in_array", {"topics": {"$in": ["en", "src3"]}}, "list_has_any(topics, ['en', 'src3'])")
_filter_query("filter_in_empty", {"lang": {"$in": []}}, "false")
_filter_query("filter_range_number", {"$and": [{"n_chars": {"$gt": 300}}, {"n_chars": {"$lte": 900.5}}, {"n_chars": {"$lt": 900.5}}]}, "n_chars > 300 AND n_chars < 900.5")
_filter_query("filter_range_date", {"$and": [{"publication_date": {"$gte": "2024-01-05T00:00:00Z"}}, {"publication_date": {"$lt": "2024-01-20T12:00:00+02:00"}}]}, "publication_date >= TIMESTAMP '2024-01-05' AND publication_date < TIMESTAMP '2024-01-20 10:00:00'")
_filter_query("filter_and_or", {"$and": [{"$or": [{"lang": {"$eq": "es"}}, {"n_chars": {"$lt": 200}}]}, {"quality": {"$eq": True}}]}, "(lang = 'es' OR n_chars < 200) AND quality")
_filter_query("filter_ids", {"$or": [{"$ids": ["1", "17", "23", "unknown"]}, {"n_chars": {"$gt": 5000}}]}, "document_id IN ('1', '17', '23') OR n_chars > 5000")
_filter_query("filter_missing_values", {"$or": [{"quality": {"$eq": True}}, {"quality": {"$eq": False}}]}, "quality IS NOT NULL")
_filter_query("filter_published_after", {"$and": [{"lang": {"$eq": "de"}}]}, "lang = 'de' AND publication_date >= TIMESTAMP '2024-01-10'", "2024-01-10T00:00:00Z")
