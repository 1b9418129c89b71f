"""The engine's relations over the star-schema tables: documents, snippets, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.filters import Resolver, from_columns, from_json_column

#: Declared properties of the corpus.
SCHEMA = {"lang": "keyword", "n_chars": "number", "topics": "keyword[]", "quality": "boolean", "publication_date": "date"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, tags, is_candidate, the declared properties as columns of their own, and text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    d = d.join(labels, "doc_id", "left")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return d.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.array("lang", "source").alias("tags"),
        (F.col("doc_id") % 10 != 0).alias("is_candidate"),
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.array("lang", "source").alias("topics"),
        (F.col("quality") == 1).alias("quality"),
        F.timestamp_seconds(F.unix_seconds(start) + F.col("doc_id") * 3600).alias("publication_date"),
        "text",
    )


def with_properties(docs: DataFrame) -> DataFrame:
    """docs with the properties also as one VARIANT column, as they are stored; missing ones are absent."""
    date = F.date_format("publication_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publication_date")
    return docs.withColumn("properties", F.parse_json(F.to_json(F.struct("lang", "n_chars", "topics", "quality", date))))


def by_variant() -> Resolver:
    return from_json_column(F.col("properties"))


def by_columns() -> Resolver:
    return from_columns({name: F.col(name) for name in SCHEMA})


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, sub_id, embedding; one snippet for each document that has an embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("vec_id").cast("string").alias("document_id"), F.lit(0).cast("long").alias("sub_id"), "embedding")


def snippets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() with sub_id and embedding, those without an embedding left out."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("document_id"), "embedding")
    return documents(spark, sf_dir).join(e, "document_id").withColumn("sub_id", F.lit(0).cast("long"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, document_id, sub_id, time_stamp, value of views, clicks and purchases."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("view", "click", "purchase"))
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("document_id"),
        F.lit(0).cast("long").alias("sub_id"),
        F.col("ts").cast("timestamp").alias("time_stamp"),
        "value",
    )
