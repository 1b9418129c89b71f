"""Queries of ingestion, mutations and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import ids, values
from tarnwick.operators import ingest
from tarnwick.operators.embed import REGISTRY
from tarnwick.plans.common import with_corpus
from tarnwick.session import new_path
from tarnwick.sources import corpus, readers
from tarnwick.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every document requested twice; the second request holds. French texts change, German ones get other properties,
    Spanish ones default to being no candidates, and source src1 is set to be one."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    each = d.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("turn") == 0, F.concat("text", F.lit(" old"))).when(F.col("lang") == "fr", F.concat("text", F.lit(" new"))).otherwise(F.col("text"))
    properties = F.when(F.col("lang") == "de", F.to_json(F.struct("lang", "source"))).otherwise(F.to_json(F.struct("lang")))
    none = F.lit(None)
    return each.select(
        F.col("doc_id").cast("string").alias("id"),
        text.alias("snippet"),
        none.cast("string").alias("file"),
        properties.alias("properties"),
        F.array("lang").alias("tags"),
        F.when(F.col("source") == "src1", True).alias("is_candidate"),
        F.when((F.col("lang") == "es") & (F.col("source") != "src1"), False).alias("default_is_candidate"),
        none.cast("boolean").alias("summarize"),
        F.lit(True).alias("split"),
        (F.col("doc_id") * 2 + F.col("turn")).alias("pos"),
    )


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a label, as an earlier ingestion left them."""
    d = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), values.sha256_of(ids.trimmed(F.col("text"))).alias("original_sha256"), F.lit("nltk_split_v1").alias("preprocessing_step"), F.to_json(F.struct("lang")).alias("properties"), F.array("lang").alias("tags"), (F.col("quality") == 1).alias("is_candidate"))


EXISTING = """, ex AS (
  SELECT doc_id, quality = 1 AS was, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS sha FROM documents JOIN labels USING (doc_id)
), req AS (
  SELECT doc_id, lang, source, sha256(regexp_replace(CASE WHEN lang = 'fr' THEN text || ' new' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS sha,
         CASE WHEN source = 'src1' THEN true END AS set_to, CASE WHEN lang = 'es' AND source <> 'src1' THEN false END AS default_to FROM documents
), cls AS (
  SELECT r.*, was, coalesce(set_to, CASE WHEN default_to IS NOT NULL THEN coalesce(was, default_to) END, true) AS is_candidate, ex.sha IS NULL OR ex.sha <> r.sha AS is_new
  FROM req r LEFT JOIN ex USING (doc_id)
), st AS (
  SELECT *, CASE WHEN is_new THEN 'new' WHEN lang = 'de' OR is_candidate <> was THEN 'changed' ELSE 'unchanged' END AS status FROM cls
)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.last_wins(ingest.prepared_with_pos(ingest.validated(_batch(spark, sf)).where(F.size("errors") == 0)), "document_id")


@query(with_corpus(EXISTING + " SELECT doc_id::VARCHAR AS document_id, sha AS original_sha256 FROM req"))
def ingest_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("document_id", "original_sha256")


@query(with_corpus(EXISTING + " SELECT doc_id::VARCHAR AS document_id, status, is_candidate FROM st"))
def ingest_classify(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.classified(_rows(spark, sf), _existing(spark, sf)).select("document_id", "status", "is_candidate")


@query(with_corpus(EXISTING + " SELECT doc_id::VARCHAR AS document_id, sha AS original_sha256, is_candidate, CASE WHEN lang = 'de' THEN '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' ELSE '{\"lang\":\"' || lang || '\"}' END AS properties FROM st"))
def ingest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The documents after the upsert."""
    none = spark.createDataFrame([], "document_id string, sub_id long, snippet string, embedding array<float>")
    out = ingest.upsert(_batch(spark, sf), _existing(spark, sf), none, REGISTRY["hashing-64"])
    return out.documents.select("document_id", "original_sha256", "is_candidate", "properties")


@query()
def ingest_upsert_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The snippets after the upsert: split, embedded."""
    none = spark.createDataFrame([], "document_id string, sub_id long, snippet string, embedding array<float>")
    out = ingest.upsert(_batch(spark, sf), _existing(spark, sf), none, REGISTRY["hashing-64"])
    return out.snippets.select("document_id", "sub_id", "snippet", F.size("embedding").alias("dim"), F.round(values.norm(F.col("embedding")), 3).alias("norm"))


CANDIDATES = "CASE WHEN n_chars % 3 = 0 THEN lang = 'en' END AS set_to, CASE WHEN n_chars % 3 = 1 THEN source < 'src5' END AS default_to, CASE WHEN doc_id % 2 = 0 THEN n_chars > 500 END AS existing"


@query(f"SELECT doc_id, set_to, default_to, existing, coalesce(set_to, CASE WHEN default_to IS NOT NULL THEN coalesce(existing, default_to) END, true) AS is_candidate FROM (SELECT doc_id, {CANDIDATES} FROM documents)")
def candidate_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that set a flag, give a default or neither, for documents that had one or not."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    turn = F.col("n_chars") % 3
    t = d.select(
        "doc_id",
        F.when(turn == 0, F.col("lang") == "en").alias("set_to"),
        F.when(turn == 1, F.col("source") < "src5").alias("default_to"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") > 500).alias("existing"),
    )
    return t.withColumn("is_candidate", ingest.resolve_candidate(F.col("set_to"), F.col("default_to"), F.col("existing")))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    """Page ids asked for as documents, half of them under an id that no document has."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select(F.when(F.col("url").startswith("https"), F.col("page_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("page_id").cast("string"))).alias("document_id"))


WANTED = ", want AS (SELECT CASE WHEN url LIKE 'https%' THEN page_id::VARCHAR ELSE 'x' || page_id END AS document_id FROM pages)"


@query(with_corpus(WANTED + " SELECT document_id, document_id IN (SELECT document_id FROM want) AS is_candidate FROM doc"))
def candidates_set(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.set_candidates(corpus.documents(spark, sf), _wanted(spark, sf))[0].select("document_id", "is_candidate")


@query(with_corpus(WANTED + " SELECT document_id, is_candidate OR document_id IN (SELECT document_id FROM want) AS is_candidate FROM doc"))
def candidates_add(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.add_candidates(corpus.documents(spark, sf), _wanted(spark, sf))[0].select("document_id", "is_candidate")


@query(with_corpus(WANTED + " SELECT document_id, is_candidate AND document_id NOT IN (SELECT document_id FROM want) AS is_candidate FROM doc"))
def candidates_remove(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.add_candidates(corpus.documents(spark, sf), _wanted(spark, sf), to=False)[0].select("document_id", "is_candidate")


@query(with_corpus(WANTED + " SELECT DISTINCT document_id FROM want WHERE document_id NOT IN (SELECT document_id FROM doc)"))
def candidates_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.set_candidates(corpus.documents(spark, sf), _wanted(spark, sf))[1]


@query(with_corpus(WANTED + """ SELECT 'document' AS name, document_id, NULL::BIGINT AS event_id FROM doc WHERE document_id NOT IN (SELECT document_id FROM want)
UNION ALL SELECT 'snippet', document_id, NULL FROM snip WHERE document_id NOT IN (SELECT document_id FROM want)
UNION ALL SELECT 'interaction', document_id, event_id FROM inter WHERE document_id NOT IN (SELECT document_id FROM want)"""))  # fmt: skip
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of documents, snippets and interactions."""
    tables = {"document": corpus.documents(spark, sf), "snippet": corpus.snippets(spark, sf), "interaction": corpus.interactions(spark, sf)}
    left = ingest.delete_documents(tables, _wanted(spark, sf))[0]
    event = {"interaction": F.col("event_id")}
    parts = [df.select(F.lit(n).alias("name"), "document_id", event.get(n, F.lit(None)).cast("long").alias("event_id")) for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.to_json(F.struct("lang", "source")).alias("properties"), F.array("lang").alias("tags"))


STORED = "SELECT doc_id::VARCHAR AS document_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS p, lang, source FROM documents"


@query(f"SELECT s.document_id, CASE WHEN l.doc_id IS NULL THEN p WHEN l.quality = 1 THEN '{{\"quality\":1}}' ELSE '{{}}' END AS properties FROM ({STORED}) s LEFT JOIN labels l ON l.doc_id::VARCHAR = s.document_id")
def properties_put(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents get their quality as the only property, or lose all properties."""
    changes = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("quality") == 1, F.to_json(F.struct("quality"))).alias("properties"))
    return ingest.put_properties(_stored(spark, sf), changes).select("document_id", "properties")


@query("""SELECT doc_id::VARCHAR AS document_id, CASE
  WHEN doc_id = 7 THEN '{"lang":"' || lang || '","long":' || (n_chars > 500)::VARCHAR || ',"n":' || n_chars || ',"some":["x","' || source || '"],"topic":' || '[1.5,"a"]' || '}'
  WHEN doc_id = 8 THEN '{"lang":"' || lang || '","long":' || (n_chars > 500)::VARCHAR || ',"n":' || n_chars || ',"some":["x","' || source || '"]}'
  WHEN doc_id = 9 THEN '{"lang":"' || lang || '","long":' || (n_chars > 500)::VARCHAR || ',"n":12,"some":["x","' || source || '"],"source":"' || source || '"}'
  ELSE '{"lang":"' || lang || '","long":' || (n_chars > 500)::VARCHAR || ',"n":' || n_chars || ',"some":["x","' || source || '"],"source":"' || source || '"}' END AS properties FROM documents""")
def property_put_and_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Single properties of all kinds: the others of the document keep their types."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = F.struct("lang", (F.col("n_chars") > 500).alias("long"), F.col("n_chars").alias("n"), F.array(F.lit("x"), F.col("source")).alias("some"), "source")
    d = d.select(F.col("doc_id").cast("string").alias("document_id"), F.to_json(mixed).alias("properties"))
    d = ingest.put_property(ingest.put_property(d, "7", "topic", [1.5, "a"]), "9", "n", 12)
    d = ingest.delete_property(ingest.delete_property(d, "7", "source"), "8", "source")
    return d.select("document_id", "properties")


@query("SELECT doc_id::VARCHAR AS document_id, CASE WHEN doc_id = 5 THEN 'a,b,a' ELSE lang END AS tags FROM documents")
def tags_put(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.put_tags(_stored(spark, sf), "5", ["a", "b", "a"]).select("document_id", F.array_join("tags", ",").alias("tags"))


ID = r"'^[a-zA-Z0-9\-:@.][a-zA-Z0-9\-:@._]*$'"


@query(f"""WITH c AS (SELECT doc_id, string_split(text, ' ')[1] AS a, source || '_' || lang AS b, '_' || source AS c FROM documents)
SELECT doc_id, coalesce(strlen(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 256 AND regexp_matches(regexp_replace(a, '^\\s+|\\s+$', '', 'g'), {ID}), false) AS first_word, regexp_matches(b, {ID}) AS source_lang, regexp_matches(c, {ID}) AS underscore FROM c""")  # fmt: skip
def validate_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    first = F.element_at(F.split("text", " "), 1)
    return d.select("doc_id", ids.valid_document_id(first).alias("first_word"), ids.valid_document_id(F.concat_ws("_", "source", "lang")).alias("source_lang"), ids.valid_document_id(F.concat(F.lit("_"), "source")).alias("underscore"))


@query("SELECT doc_id, sha256(text) AS sha, sha256(text) <> sha256(lower(text)) AS differs FROM documents")
def sha256_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sha = values.sha256_of(F.col("text"))
    return d.select("doc_id", sha.alias("sha"), (sha != values.sha256_of(F.lower("text"))).alias("differs"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN doc_id::VARCHAR ELSE '_s.' || (n_chars % 3)::VARCHAR || '.' || doc_id END AS code, doc_id::VARCHAR AS document_id, (n_chars % 3)::BIGINT AS sub_id FROM documents")
def snippet_id_codec(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    code = ids.encode_snippet_id(F.col("doc_id").cast("string"), (F.col("n_chars") % 3).cast("long"))
    d = d.select("doc_id", code.alias("code"))
    document_id, sub_id = ids.decode_snippet_id(F.col("code"))
    return d.select("doc_id", "code", document_id.alias("document_id"), sub_id.alias("sub_id"))


@query("SELECT doc_id, 8 + 8 + 4 + strlen(lang) + 8 + 6 + strlen(source) AS size FROM documents")
def properties_size(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", values.properties_size(F.to_json(F.struct("lang", "source"))).cast("long").alias("size"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3 * x::DOUBLE * 3)), 4) AS before, round(1.0, 6) AS after FROM embeddings")
def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    n = lambda v: values.norm(v)
    return e.select("vec_id", F.round(n(scaled) * n(scaled), 4).alias("before"), F.round(n(values.normalized(scaled)), 6).alias("after"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def file_text(spark: SparkSession, sf: str) -> DataFrame:
    """Files that come as base64, read by a pluggable extractor."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.select("doc_id", readers.extracted_text(F.base64(F.col("text").cast("binary")), lambda b: b.decode("utf-8")).alias("text"))
    return d.select("doc_id", values.sha256_of(F.col("text")).alias("sha"))


@query("SELECT lang AS tenant, CASE WHEN lang < 'f' THEN 'hashing-64' ELSE 'hashing-128' END AS embedder, count(*) AS documents, count(*) FILTER (doc_id % 10 <> 0) AS candidates, 2 AS versions FROM documents GROUP BY lang")
def tenants(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant for each language, with its documents; one more is created and dropped."""
    store = Store(spark, new_path(spark, "tenants"))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = [F.col("doc_id").cast("string").alias("document_id"), *[F.lit(None).cast("string").alias(c) for c in ("original_sha256", "preprocessing_step")], F.lit("{}").alias("properties"), F.array("source").alias("tags"), (F.col("doc_id") % 10 != 0).alias("is_candidate")]
    for lang in [r["lang"] for r in d.select("lang").distinct().collect()]:
        store.create(lang, "hashing-64" if lang < "f" else "hashing-128")
        store.commit(lang, {"document": d.where(F.col("lang") == lang).select(*columns)})
    store.create("gone")
    store.drop("gone")
    out = None
    for t in store.tenants():
        told = [F.lit(t).alias("tenant"), F.lit(store.options(t)["embedder"]).alias("embedder"), F.count(F.lit(1)).alias("documents"), F.count_if("is_candidate").alias("candidates"), F.lit(len(store.versions(t))).alias("versions")]
        row = store.table(t, "document").agg(*told)
        out = row if out is None else out.unionByName(row)
    return out
