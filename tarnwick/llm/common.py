"""Small helpers that the training-data operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.session import table

__all__ = ["BLANKS", "WORD", "documents", "join_skewed", "join_spread", "key60", "let", "n_words", "packed", "same_row", "table", "unpacked"]

#: A word: a run of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words, as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key60(text: Column) -> Column:
    """A 60-bit key of a string, the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for expressions that use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column ``_row`` beside the computed keys, so that no column of docs can clash with an inner one."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in keys.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of ``_row``, then the new ones; a column of docs named like a new one gives way to it."""
    made = rows.withColumns({f"_new_{name}": c for name, c in new.items()}) if new else rows  # apart from docs' names, which new may use inside
    return made.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *[F.col(f"_new_{name}").alias(name) for name in new])


def same_row(names: dict[str, str]) -> Column:
    """Condition: each left column is the same as the right one, nulls too."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()])


def join_spread(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", spread: int = 64) -> DataFrame:
    """rows joined with small, which has one row per key (null is a key too): small is repeated ``spread`` times and
    rows are dealt by key and a share of the number ``by``, different for each row, so a key with a third of all rows has 64 tasks."""
    right = small.withColumnRenamed(key, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.pmod(F.col(by), F.lit(spread)) == F.col("_part"))
    return rows.join(right, on, how).drop("_key", "_part")


def join_skewed(rows: DataFrame, small: DataFrame, key: str, value: str, count: str, deal: str, total: int, hot: int = 1024) -> DataFrame:
    """rows plus ``value`` of small, which has one row per key (not null) and how many of the ``total`` rows have it.

    Keys with more than one ``hot``th of the rows, fewer than ``hot`` in number, are broadcast. The other keys meet in a
    shuffle, in which rows of hot keys are dealt by the number ``deal`` and meet nothing.
    """
    often = small.where(F.col(count) > total / hot).select(F.col(key).alias("_hot"), F.col(value).alias("_hot_value"))
    rare = small.where(F.col(count) <= total / hot).select(F.col(key).alias("_rare"), F.col(value).alias("_rare_value"))
    out = rows.join(F.broadcast(often), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.col(deal).cast("string"))))
    out = out.join(rare, F.col("_at") == F.col("_rare"), "left")
    return out.withColumn(value, F.coalesce("_hot_value", "_rare_value")).drop("_hot", "_hot_value", "_at", "_rare", "_rare_value")
