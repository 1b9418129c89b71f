"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import join_spread, key60, n_words, packed, same_row, table, unpacked

#: Buckets of the sampling order, per source, in which the cut is searched.
ORDER_BUCKETS = 65_536


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size) -> plus ``target``.

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` times all sizes.
    A target stops at ``max_repeat`` times its source's size and the excess is reshared by weight until none is
    above: with sources sorted by the level at which they fill up, the final level is the largest of
    (budget - caps of the sources before) / (weights from here on). Rows: one per source, never per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("w", F.get(given, (F.row_number().over(by_name) - 1) % len(weights)))
    out = out.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("fill", F.col("cap") / F.col("w"))
    out = out.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return out.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _cuts(cands: DataFrame, left: DataFrame) -> DataFrame:
    """Per source, the order bucket in which the words left run out (``cut``) and the words left at its start."""
    hist = cands.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket")
    hist = hist.withColumn("upto", F.sum("n").over(w))
    hist = hist.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").where(F.col("upto") > F.col("left"))
    first = F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("rest")))
    return hist.groupBy("source").agg(first.alias("c")).select("source", F.col("c.bucket").alias("cut"), F.col("c.rest").alias("rest"))


def _take(cands: DataFrame, left: DataFrame, nearest: bool) -> DataFrame:
    """cands with ``won``: in sampling order, rows are taken while the words left last (nearest: the row that
    crosses the end too, if more than half of it fits). Only the rows of one order bucket per source are sorted."""
    marked = join_spread(cands, _cuts(cands, left), "source", "rid", "left")
    inside = marked.where(F.col("bucket") == F.col("cut"))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("size").over(order) - (F.col("size") / 2 if nearest else F.lit(0))
    inside = inside.withColumn("won", used <= F.col("rest"))
    rest = marked.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
    rest = rest.withColumn("won", F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))
    return inside.unionByName(rest).drop("cut", "rest")


def mix(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0, seed: str = "mix-1", weight_col: str | None = None) -> DataFrame:
    """Copies of each document in the mix.

    A document is expected ``target / source_size`` times (with ``weight_col``: in proportion to that weight inside
    its source, at most max_repeat times). Its whole copies are certain; for the fraction f that remains it is ranked
    by random odds over inclusion odds, u/(1-u) : f/(1-f), and the ranking's head that fills the words its source
    still lacks is taken. What the first too large document leaves open is filled once more by smaller ones further
    down the ranking, which favours small documents, by no more words than that document has. Random numbers come from doc_id and seed, so reruns agree.

    docs: doc_id, source, text (other columns are ignored). Returns one row per input row: doc_id, source, tie
    (a hash of the text), size, source_size, target, copies, taken. Null text has size 0 and one expected copy like
    any other; null source is a source of its own, last; null doc_id is one more id; rows with one id draw the same
    number and are told apart by their text. An empty table gives an empty result.
    """
    value = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), value.alias("value"), F.monotonically_increasing_id().alias("rid"))
    slim = table(slim, "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("value") * F.col("size")).alias("mass"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, max_repeat)
    targets = targets.join(sizes.select(F.col("source").alias("s"), "mass"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = targets.withColumn("rate", F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0))

    u = (key60(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) + F.lit(0.5)) / F.lit(float(2**60))
    e = F.least(F.col("rate") * F.col("value"), F.lit(float(max_repeat)))
    rows = join_spread(slim, targets, "source", "rid")
    rows = rows.withColumn("e", e).withColumn("sure", F.floor("e").cast("long")).withColumn("f", F.col("e") - F.col("sure"))
    rows = rows.withColumn("u", F.least(u, F.lit(1 - 2.0**-53))).withColumn("q", F.col("u") * (1 - F.col("f")) / (F.col("u") * (1 - F.col("f")) + (1 - F.col("u")) * F.col("f")))
    rows = rows.withColumn("bucket", F.floor(F.col("q") * ORDER_BUCKETS).cast("int")).drop("e", "u", "value", "mass", "rate")
    rows = table(rows, "mix-ranked")

    lacks = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("left"))
    open_ = rows.where((F.col("f") > 0) & (F.col("size") > 0))
    first = table(_take(open_, lacks, nearest=False), "mix-first")
    taken = first.where("won").groupBy("source").agg(F.sum("size").alias("t")).withColumnRenamed("source", "s")
    still = lacks.join(taken, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("left") - F.coalesce("t", F.lit(0))).alias("left"))
    fits = join_spread(first.where("not won").drop("won"), still, "source", "rid")
    fits = fits.withColumn("fits", F.col("size") <= F.col("left")).drop("left")
    second = _take(fits.where("fits"), still, nearest=True)
    out = rows.where((F.col("f") <= 0) | (F.col("size") <= 0)).withColumn("won", F.lit(False))
    out = out.unionByName(first.where("won")).unionByName(second.drop("fits")).unionByName(fits.where("not fits").drop("fits").withColumn("won", F.lit(False)))
    copies = F.col("sure") + F.col("won").cast("long")
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_stage(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix has them: a document with no copy is gone, one with two comes twice; columns unchanged, whatever
    further columns are named. Nulls, rows that share an id, repeated rows and empty tables as in mix(); of equal rows that
    tie at the end of the ranking, all come as often as the luckiest."""
    counts = mix(docs, **options).where("copies > 0").groupBy("doc_id", "source", "tie").agg(F.max("copies").alias("copies"))
    keyed = packed(docs, _id=F.col("doc_id"), _source=F.col("source"), _tie=F.xxhash64("text"))
    out = keyed.join(counts, same_row({"_id": "doc_id", "_source": "source", "_tie": "tie"}))
    return unpacked(out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)
