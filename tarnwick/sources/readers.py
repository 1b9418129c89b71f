"""Readers and writers of the formats that the service takes and gives."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.schema import INGEST

#: Columns of a click log and of its news table: tab-separated, without a header.
CLICKS = "impression_id string, user_id string, time string, clicks string, log string"
NEWS = "document_id string, category string, sub_category string, title string, snippet string, url string"


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Ingestion requests from JSON lines, with their order: by file name, then by place in the file. A line that is no
    object, or has unknown fields, becomes a row without id, which validation rejects."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    fields = F.map_keys(F.try_parse_json("value").try_cast("map<string,variant>"))
    fine = F.coalesce(F.size(F.array_except(fields, F.array(*[F.lit(f.name) for f in INGEST.fields]))) == 0, F.lit(False))
    # rows of one block have ascending numbers; blocks are counted up inside their file, and of each file one row inside the whole
    blocks = lines.groupBy("path", "block").agg(F.min("nth").alias("from"), F.count(F.lit(1)).alias("n"))
    files = blocks.groupBy("path").agg(F.sum("n").alias("of_file"))
    up_to = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("path", up_to(Window.orderBy("path"), "of_file").alias("file_offset"))
    blocks = blocks.withColumn("offset", up_to(Window.partitionBy("path").orderBy("block"), "n")).join(files, "path")
    blocks = blocks.select("path", "block", "from", (F.col("offset") + F.col("file_offset")).alias("offset"))
    rows = lines.join(blocks, ["path", "block"]).where("trim(value) <> ''")
    return rows.select(F.when(fine, F.from_json("value", INGEST)).alias("row"), (F.col("offset") + F.col("nth") - F.col("from")).alias("pos")).select("row.*", "pos")


def requests_of(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """The same from the body of one request."""
    known = {f.name for f in INGEST.fields}
    for d in documents:
        if set(d) - known:
            raise ValueError(f"unknown fields {sorted(set(d) - known)}")
    rows = [tuple(d.get(f.name) for f in INGEST.fields) + (i,) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, T.StructType([*INGEST.fields, T.StructField("pos", T.LongType())]))


def click_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLICKS).csv(path, sep="\t")


def news(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NEWS).csv(path, sep="\t")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON value over many lines: personas, topics."""
    return spark.read.json(path, multiLine=True)


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def extracted_text(file: Column, extract: Callable[[bytes], str | None]) -> Column:
    """Text of base64 files by a pluggable extractor; null for what is no base64 or can't be read."""

    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series([extract(bytes(b)) if b is not None else None for b in files])

    return run(F.try_to_binary(file, F.lit("base64")))


#: Named characters that html_text() resolves; others, and numbers, become a blank.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}


MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->|<[^>]*>"


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags, blanks as one space."""
    out = F.regexp_replace(html, MARKUP, " ")
    for name, char in reversed(ENTITIES.items()):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
