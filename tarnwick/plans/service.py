"""Queries through the service's API, over the corpus stored as a tenant, and through the readers and writers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.engine import Engine
from tarnwick.functions.values import average_pooled
from tarnwick.operators import personalize
from tarnwick.plans.common import CENTRES, with_corpus
from tarnwick.plans.search import BM25_SQL, KNN_SQL, RRF_SQL, TEXT
from tarnwick.plans.users import RECOMMEND, TAGS, centres
from tarnwick.session import new_path
from tarnwick.sources import corpus, npy, readers
from tarnwick.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = datetime(2024, 2, 1, tzinfo=UTC)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def engine_of(spark: SparkSession, sf: str, users: bool = True, embedder: Callable | None = None) -> Engine:
    """The corpus as a tenant: documents, snippets, and with users their histories, tag weights, and one centre for each
    document of a user."""
    root = new_path(spark, "tenants")
    store = Store(spark, root)
    store.create("corpus")
    docs, seen = corpus.documents(spark, sf), corpus.interactions(spark, sf)
    store.commit("corpus", {
        "document": corpus.with_properties(docs).withColumn("properties", F.to_json("properties")).withColumns({n: F.lit(None).cast("string") for n in ("original_sha256", "preprocessing_step")}),
        "snippet": corpus.snippets_of_documents(spark, sf).withColumnRenamed("text", "snippet"),
        "indexed_property": spark.createDataFrame(list(corpus.SCHEMA.items()), "name string, type string"),
    })
    if users:
        store.commit("corpus", {
            "interaction": seen.select("document_id", "sub_id", "user_id", "time_stamp").distinct(),
            "center_of_interest": centres(spark, sf),
            "weighted_tag": personalize.tag_weights(seen, docs),
            "users": personalize.last_seen(seen),
        })
    return Engine(spark, root, "corpus", embedder=embedder)


def _found(hits: DataFrame) -> DataFrame:
    return hits.select("document_id", F.round("score", 6).alias("score"), F.get_json_object("properties_json", "$.lang").alias("lang"))


FOUND = "SELECT k.document_id, score, lang FROM ({knn}) k JOIN doc USING (document_id)"


@query(with_corpus(" " + FOUND.format(knn=KNN_SQL.format(where=""))))
def service_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents similar to a document, with their properties."""
    return _found(engine_of(spark, sf).search(document_id="1", count=10))


@query(with_corpus(" " + FOUND.format(knn=KNN_SQL.format(where=" AND (lang = 'en' OR n_chars > 900) AND publication_date >= TIMESTAMP '2024-01-10'"))))
def service_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same under a filter on declared properties and a date."""
    either = {"$or": [{"lang": {"$eq": "en"}}, {"n_chars": {"$gt": 900}}]}
    return _found(engine_of(spark, sf).search(document_id="1", count=10, filter=either, published_after="2024-01-10T00:00:00Z"))


def _recommended(out: DataFrame) -> DataFrame:
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(with_corpus(RECOMMEND, CENTRES))
def service_recommend_all(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations for all users of a tenant."""
    return _recommended(engine_of(spark, sf).recommend_all(count=10, now=NOW))


@query("SELECT * FROM (" + with_corpus(RECOMMEND, CENTRES) + ") WHERE user_id = '7'")
def service_recommend_user(spark: SparkSession, sf: str) -> DataFrame:
    return _recommended(engine_of(spark, sf).recommend_user("7", count=10, now=NOW))


INTERACT = """SELECT 'newcomer' AS user_id, tag, count(*) AS weight FROM (SELECT unnest(tags) AS tag FROM snip WHERE document_id IN ('1', '2', '3')) GROUP BY tag"""


@query(with_corpus(TAGS + f" SELECT * FROM tw UNION ALL {INTERACT}"))
def service_interact(spark: SparkSession, sf: str) -> DataFrame:
    """The tag weights of all users after one more user's interactions."""
    engine = engine_of(spark, sf)
    engine.interact("newcomer", [("1", 0), ("2", 0), ("3", 0)], NOW)
    return engine.store.tables("corpus")["weighted_tag"]


@query(with_corpus(" SELECT user_id, document_id, time_stamp FROM inter UNION SELECT 'newcomer', document_id, TIMESTAMP '2024-02-01' FROM snip WHERE document_id IN ('1', '2', '3')"))
def service_history(spark: SparkSession, sf: str) -> DataFrame:
    """The logged interactions of all users after one more user's."""
    engine = engine_of(spark, sf)
    engine.interact("newcomer", [("1", 0), ("2", 0), ("3", 0)], NOW)
    return engine.store.tables("corpus")["interaction"].select("user_id", "document_id", "time_stamp")


@query(with_corpus(" SELECT document_id FROM doc WHERE is_candidate AND document_id <> '1'"))
def service_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates left after one is taken out."""
    engine = engine_of(spark, sf)
    engine.add_candidates(["1"], False)
    return engine.candidates()


@query("""SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS text_sha256,
CASE WHEN doc_id % 7 <> 0 THEN lang END AS tag, count(*) AS n FROM documents GROUP BY ALL""")  # fmt: skip
def ingest_json(spark: SparkSession, sf: str) -> DataFrame:
    """Ingestion requests from JSON lines; every seventh has an unknown field and is rejected."""
    path = new_path(spark, "requests")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    request = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("snippet"), F.array("lang").alias("tags"), F.when(F.col("doc_id") % 7 == 0, F.lit(1)).alias("unheard_of"))
    d.select(F.to_json(request)).write.text(path)
    got = readers.requests(spark, path)
    return got.groupBy("id", F.sha2("snippet", 256).alias("text_sha256"), F.element_at("tags", 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id::VARCHAR AS impression_id, user_id::VARCHAR AS user_id, event_type || '-' || (event_type = 'click')::INTEGER AS log FROM events")
def click_log_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """A click log as tab-separated text without a header."""
    path = new_path(spark, "clicks")
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = lambda c: F.col(c).cast("string")
    item = F.concat_ws("-", "event_type", (F.col("event_type") == "click").cast("int").cast("string"))
    e.select(text("event_id"), text("user_id"), text("ts"), F.lit("seen"), item.alias("log")).write.csv(path, sep="\t")
    return readers.click_log(spark, path).select("impression_id", "user_id", "log")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en'")
def results_json(spark: SparkSession, sf: str) -> DataFrame:
    """Results written as JSON lines and read again."""
    path = new_path(spark, "results")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    readers.write_results(d.where("lang = 'en'").select("doc_id", "n_chars"), path, "json")
    return spark.read.schema("doc_id long, n_chars long").json(path)


@query("""SELECT vec_id, round(list_sum(list_transform(range(0, n), lambda t: embedding[(t * 16 + 1)::INTEGER]::DOUBLE)) / n, 6) AS first, round(list_sum(list_transform(range(0, n), lambda t: embedding[(t * 16 + 16)::INTEGER]::DOUBLE)) / n, 6) AS last
FROM (SELECT *, vec_id % 4 + 1 AS n FROM embeddings)""")  # fmt: skip
def average_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Four token vectors of 16 numbers, of which a mask keeps the first one to four."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("e", F.col("embedding").cast("array<double>"))
    tokens = F.array(*[F.slice("e", 16 * t + 1, 16) for t in range(4)])
    mask = F.array(*[(F.col("vec_id") % 4 >= t).cast("double") for t in range(4)])
    pooled = average_pooled(tokens, mask)
    return e.select("vec_id", pooled.alias("p")).select("vec_id", F.round(F.element_at("p", 1), 6).alias("first"), F.round(F.element_at("p", 16), 6).alias("last"))


@query(with_corpus(BM25_SQL + RRF_SQL).replace("LIMIT 20", "LIMIT 10"))
def service_search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """A text looked up by vector and by words through the API, with an embedder that has document 1's vector for it."""
    vector = corpus.snippets(spark, sf).where("document_id = '1'").first()["embedding"]
    engine = engine_of(spark, sf, embedder=lambda texts: [vector for _ in texts])
    engine.index_texts()
    return engine.search(text=TEXT, count=10, hybrid=True).select("document_id", F.round("score", 6).alias("score"))


@query("""SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, CASE WHEN vec_id % 9 = 4 THEN 'length' END AS reason
FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN NULL ELSE embedding END AS embedding FROM embeddings)""")  # fmt: skip
def vectors_npy(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as NPY files and read again; every ninth is too short, and told as a failure."""
    path = new_path(spark, "npy")
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    dim = F.size("embedding")
    vector = F.when(F.col("vec_id") % 9 == 4, F.slice("embedding", 1, dim - 1)).otherwise(F.col("embedding"))
    failed = npy.write(e.select(F.col("vec_id").alias("id"), vector.alias("vector")), path, e.select(dim).first()[0])
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    good = npy.read(spark, path).select(F.col("id").alias("vec_id"), F.round(total, 4).alias("total"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(failed.select(F.col("id").alias("vec_id"), F.lit(None).cast("double").alias("total"), "reason"))
