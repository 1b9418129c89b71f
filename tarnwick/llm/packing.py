"""Length buckets with the least padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import n_words, table

#: Rows that are ranked together.
SHARD_ROWS = 4096


def best_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets with the least total padding; lengths ascend, each with its count.

    Dynamic programming over the histogram: least[j] for k buckets = min over i of least[i] for k - 1 + padding of
    lengths i..j-1 to length j-1. The best i never falls as j grows, so each layer is solved by halving.
    """
    x, c = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    d = len(x)
    if d <= n_buckets:
        return [int(v) for v in lengths]
    n, s = np.concatenate([[0.0], np.cumsum(c)]), np.concatenate([[0.0], np.cumsum(c * x)])
    least = np.concatenate([[0.0], x * n[1:] - s[1:]])
    choice = []
    for _ in range(1, n_buckets):
        new, best = least.copy(), np.zeros(d + 1, np.int64)
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(j - 1, b) + 1)
            cost = least[i] + x[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
            at = int(cost.argmin())
            new[j], best[j] = cost[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        choice.append(best)
        least = new
    bounds, j = [], d
    for best in reversed(choice):
        bounds.append(int(lengths[j - 1]))
        j = int(best[j])
        if j == 0:
            break
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(set(bounds))


def pack(docs: DataFrame, budget: int = 16_384, n_buckets: int = 16, length: str | None = None) -> DataFrame:
    """Bucket, batch and slot of each document.

    Length is docs' column ``length``, tokens as a rule, or the number of words of the text where none is named. The
    histogram of lengths up to ``budget`` has at most budget + 1 rows whatever the input, and goes to the driver for the
    dynamic program. A bucket's batches hold budget // bound documents, each padded to the bound; only a bucket's last
    batch can have room left. A document longer than the budget is a batch of its own, without padding, in bucket -1,
    numbered by the same ranks as the rest.

    docs: doc_id, and length or text; other columns are ignored, whatever their names. A null text or length is 0; a
    null doc_id is ranked like any other; repeated rows get places of their own; an empty table gives an empty result.
    Rows of one id and length are counted before they are ranked and made rows again after it, in chunks that are dealt
    anew, so one id (or null) may hold any share of the rows.
    Returns doc_id, length, bucket, bound, batch, slot, padding.
    """
    size = F.coalesce(F.col(length), F.lit(0)).cast("long") if length else n_words(F.col("text"))
    slim = table(docs.select("doc_id", size.alias("length"), F.xxhash64("doc_id").alias("mix")), "pack-lengths")
    found = slim.groupBy(F.least("length", F.lit(budget + 1)).alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    hist = sorted((r["length"], r["n"]) for r in found if r["length"] <= budget)
    n_long = sum(r["n"] for r in found if r["length"] > budget)
    bounds = best_boundaries([h[0] for h in hist], [h[1] for h in hist], n_buckets) if hist else []
    return _batches(slim, hist, n_long, bounds, budget)


def _batches(slim: DataFrame, hist: list[tuple[int, int]], n_long: int, bounds: list[int], budget: int) -> DataFrame:
    bucket = F.lit(-1)
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("length") <= bounds[k], F.lit(k)).otherwise(bucket)
    sizes = [0] * len(bounds)
    for length, n in hist:
        sizes[int(np.searchsorted(bounds, length))] += n
    lists = lambda v, kind: F.array(*[F.lit(x) for x in v]).cast(f"array<{kind}>")
    known = F.coalesce(F.get(lists(bounds, "bigint"), F.col("bucket")), F.col("length"))
    in_shards = lambda n: max(1, -(-n // SHARD_ROWS))
    shards = F.coalesce(F.get(lists([in_shards(n) for n in sizes], "bigint"), F.col("bucket")), F.lit(in_shards(n_long)))
    groups = slim.groupBy("doc_id", "length", "mix").agg(F.count(F.lit(1)).alias("rows"))
    groups = groups.withColumn("bucket", bucket).withColumn("shard", F.pmod(F.xxhash64("mix", F.lit(7)), shards))
    counts = groups.groupBy("bucket", "shard").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("mix", "doc_id", "length").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("rank", F.sum("rows").over(inside) - F.col("rows")).join(offsets, ["bucket", "shard"])
    chunks = groups.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SHARD_ROWS).cast("long")))).repartition("doc_id", "length", "first")
    here = F.sequence(F.col("first"), F.least(F.col("first") + SHARD_ROWS, F.col("rows")) - 1)
    rows = chunks.withColumn("nth", F.explode(here))
    rank, room = F.col("rank") + F.col("nth") + F.col("offset"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(known, F.lit(1)))).cast("long")
    out = rows.select("doc_id", "length", "bucket", known.alias("bound"), F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot"))
    return out.withColumn("padding", F.col("bound") - F.col("length"))
