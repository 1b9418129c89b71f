"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it. edges: a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Each child has one edge and no root is a child."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
    per = ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("root"))
    return per.where("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a > b, any order of rows) -> (node, root): the least node that each node reaches. Nodes without an
    edge don't appear. Every round ends in a table in the shared folder; rounds grow with the logarithm of the nodes."""
    now = table(edges.select("a", "b").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = table(_small_star(_large_star(now)), "stars")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
