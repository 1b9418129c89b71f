"""Queries of the vector index, of the inverted index, and of a tenant's tables as a stream of interactions changes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.values import tokens
from tarnwick.operators import postings, vector_index
from tarnwick.operators.search import ranked
from tarnwick.plans import search, service
from tarnwick.plans.common import with_corpus
from tarnwick.session import new_path, table
from tarnwick.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _index(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    rows = corpus.snippets_of_documents(spark, sf).where("is_candidate").select("document_id", "sub_id", "embedding", "lang", "n_chars")
    return vector_index.build(rows)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose id is divisible by 20, without itself."""
    s = corpus.snippets(spark, sf).where(F.col("document_id").cast("long") % 20 == 0)
    return s.select(F.col("document_id").alias("q"), F.col("embedding").cast("array<double>").alias("vec"), F.array("document_id").alias("exclude"))


def _told(hits: DataFrame) -> DataFrame:
    return ranked(hits).select("q", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(search.ORACLE_SQL["knn_many"])
def knn_ivf_all(spark: SparkSession, sf: str) -> DataFrame:
    """All lists probed."""
    return _told(vector_index.search(_index(spark, sf), _asked(spark, sf), 10, probes=vector_index.MOST_LISTS))


@query(search.ORACLE_SQL["knn_many"])
def knn_ivf_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest lists, then those that may hold something better."""
    return _told(vector_index.search(_index(spark, sf), _asked(spark, sf), 10, exact=True))


@query()
def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest lists alone: approximate, so tests measure its recall."""
    return _told(vector_index.search(_index(spark, sf), _asked(spark, sf), 10))


@query(search.ORACLE_SQL["knn_many"].replace("AND s.is_candidate", "AND s.is_candidate AND s.lang = 'fr' AND s.n_chars >= 500"))
def knn_ivf_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same exactly, under a filter on columns of the index."""
    condition = (F.col("lang") == "fr") & (F.col("n_chars") >= 500)
    return _told(vector_index.search(_index(spark, sf), _asked(spark, sf), 10, condition=condition, exact=True))


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.snippets_of_documents(spark, sf).where("is_candidate")
    return table(postings.build(rows.select("document_id", "sub_id", "text"), postings.blocks_for(rows.count())), "postings")


def _text(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q", search.TEXT)], "q string, text string")


@query(search.ORACLE_SQL["bm25_topk"])
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search over the inverted index."""
    return postings.search(_postings(spark, sf), _text(spark), 20).select("document_id", F.round("score", 6).alias("score"))


@query(search.ORACLE_SQL["bm25_filtered"])
def bm25_postings_filtered(spark: SparkSession, sf: str) -> DataFrame:
    shown = corpus.snippets_of_documents(spark, sf).where("is_candidate and lang = 'fr'").select("document_id", "sub_id")
    return postings.search(_postings(spark, sf), _text(spark), 20, shown).select("document_id", F.round("score", 6).alias("score"))


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(with_corpus(f""", d AS (
  SELECT document_id, {TOKENS} AS t FROM snip WHERE is_candidate
), stats AS (
  SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM d
), tf AS (
  SELECT document_id, term, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl FROM (SELECT document_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY document_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
  SELECT q, term, min(pos) AS pos FROM (SELECT document_id AS q, unnest({TOKENS}[1:6]) AS term, unnest(range(6)) AS pos FROM snip WHERE document_id::BIGINT % 20 = 0) WHERE term IS NOT NULL GROUP BY q, term
), s AS (
  SELECT q, document_id, list_sum(list(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / avgdl)) ORDER BY pos)) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY q, document_id
)
SELECT q, document_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, document_id DESC) AS r FROM s) WHERE r <= 10"""))  # fmt: skip
def bm25_many(spark: SparkSession, sf: str) -> DataFrame:
    """The first six tokens of every document whose id is divisible by 20, looked up in all candidates."""
    s = corpus.snippets_of_documents(spark, sf).where(F.col("document_id").cast("long") % 20 == 0)
    asked = s.select(F.col("document_id").alias("q"), F.array_join(F.slice(tokens(F.col("text")), 1, 6), " ").alias("text"))
    return postings.search(_postings(spark, sf), asked, 10).select("q", "document_id", F.round("score", 6).alias("score"))


@query(with_corpus(" SELECT user_id, max(time_stamp) AS last_seen FROM inter GROUP BY user_id"))
def service_stream_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The last-seen times of a tenant's users after a stream of their interactions."""
    return _streamed(spark, sf, "users").select("user_id", "last_seen")


@query(with_corpus(" SELECT user_id, tag, count(*) AS weight FROM (SELECT user_id, unnest(tags) AS tag FROM inter JOIN snip USING (document_id)) GROUP BY user_id, tag"))
def service_stream_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tag weights that the same stream leaves."""
    return _streamed(spark, sf, "weighted_tag")


@query(with_corpus(" SELECT DISTINCT user_id, document_id, time_stamp FROM inter WHERE document_id IN (SELECT document_id FROM snip)"))
def service_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """The interactions that the same stream logs."""
    return _streamed(spark, sf, "interaction").select("user_id", "document_id", "time_stamp")


def _streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of a tenant without users after all interactions have come as a stream."""
    engine = service.engine_of(spark, sf, users=False)
    path = new_path(spark, "interactions")
    corpus.interactions(spark, sf).select("user_id", "document_id", "sub_id", "event_id", "time_stamp").write.parquet(path)
    events = spark.readStream.schema("user_id string, document_id string, sub_id long, event_id long, time_stamp timestamp").parquet(path)
    engine.interact_stream(events, new_path(spark, "checkpoint")).awaitTermination()
    return engine.store.table("corpus", name)


@query(service.ORACLE_SQL["service_recommend_all"])
def service_recommend_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations for all users through the vector index, all rows being candidates: the same as by the scan."""
    engine = service.engine_of(spark, sf)
    engine.index_vectors()
    out = engine.recommend_all(count=10, now=service.NOW, num_candidates=1 << 31)
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
