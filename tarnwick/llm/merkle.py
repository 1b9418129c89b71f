"""Merkle manifest of a dataset: digests of rows, a root for each language and for all, and a proof for each row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import table

#: Nodes of a run, which have one parent; levels of a block, whose leaves are worked on together.
ARITY, BLOCK_LEVELS = 8, 4
#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Path = list[tuple[bytes, bytes]]


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Run:
    """The nodes of one run at some level, made from leaves that come one by one; what is not yet whole waits, fewer than
    ARITY nodes at each level below."""

    def __init__(self, level: int):
        self.waiting: list[list[bytes]] = [[] for _ in range(level + 1)]

    def add(self, leaf: bytes) -> None:
        self.waiting[0].append(leaf)
        for below, above in zip(self.waiting, self.waiting[1:]):
            if len(below) < ARITY:
                break
            above.append(digest(*below))
            below.clear()

    def nodes(self) -> list[bytes]:
        """The nodes, once all leaves have come: a last, short run below has its node too."""
        for below, above in zip(self.waiting, self.waiting[1:]):
            if below:
                above.append(digest(*below))
                below.clear()
        return self.waiting[-1]


def paths(leaves: list[bytes], levels: int) -> Iterator[Path]:
    """The authentication paths of the leaves, one after another: at each level the siblings left and right of the way.

    Fractal traversal with subtrees of one level: for each level there is the run that holds the way (existing) and the
    one after it (desired), which takes one leaf at each step and so is whole when the way enters it. Kept are at most
    2 * ARITY nodes a level and what waits below, whatever the number of leaves.
    """
    spans = [ARITY ** (i + 1) for i in range(levels)]
    existing: list[list[bytes]] = []
    for i, span in enumerate(spans):
        run = Run(i)
        for leaf in leaves[:span]:
            run.add(leaf)
        existing.append(run.nodes())
    desired = [Run(i) for i in range(levels)]
    now: Path = [(b"", b"")] * levels
    for at in range(len(leaves)):
        for i, span in enumerate(spans):
            if at and at % span == 0:
                existing[i], desired[i] = desired[i].nodes(), Run(i)
            if at % (span // ARITY) == 0:
                k = at // (span // ARITY) % ARITY
                now[i] = b"".join(existing[i][:k]), b"".join(existing[i][k + 1 :])
            if at + span < len(leaves):
                desired[i].add(leaves[at + span])
        yield list(now)


def top(leaves: list[bytes], levels: int) -> bytes:
    """The node that levels lead to; leaves are at most ARITY ** levels."""
    run = Run(levels)
    for leaf in leaves:
        run.add(leaf)
    return run.nodes()[0]


def folded(leaf: bytes, path: Path) -> bytes:
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


def leaf_of(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as its number of UTF-8 bytes, a colon and its value, or ``-`` if null."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (grp, ...) plus ``idx``, the place of a row in its group by order, and ``n``, the group's size.

    Rows are sorted over ranges of (group, order), so a large group has many tasks; places are the rows' numbers inside
    their range and the counts of the ranges before. A row's number comes from its place in the written table's task."""
    at = F.monotonically_increasing_id()
    made = rows.withColumn("_row", at).repartitionByRange(F.col("grp"), *order, F.col("_row")).sortWithinPartitions(F.col("grp"), *order, F.col("_row")).drop("_row")
    made = table(made.withColumn("_at", at), "merkle-sorted").withColumn("_part", F.shiftright("_at", 33))
    ranges = made.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("grp").orderBy("_part")) - F.col("_n")
    ranges = ranges.select("grp", "_part", (before - F.col("_first")).alias("_by"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    return made.join(ranges, ["grp", "_part"]).withColumn("idx", F.col("_at") + F.col("_by")).drop("_at", "_part", "_by")


def _block_levels(n: int, most: int) -> int:
    """Levels of a block in a group of n leaves: most, or fewer if the group is less than a whole block."""
    return min(most, levels_of(n))


def _sorted(rows: pa.Table) -> tuple[pa.Table, list[bytes]]:
    rows = rows.sort_by("idx")
    return rows, [x.encode() for x in rows["node"].to_pylist()]


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (grp, idx, n, node) -> the same one block up."""
    size = ARITY**levels

    def run(rows: pa.Table) -> pa.Table:
        rows, leaves = _sorted(rows)
        n = rows["n"][0].as_py()
        return pa.table({"grp": rows["grp"][:1], "idx": [rows["idx"][0].as_py() // size], "n": [-(-n // size)], "node": [top(leaves, _block_levels(n, levels)).decode()]})

    slim = nodes.select("grp", "idx", "n", "node", F.expr(f"idx div {ARITY**levels}").alias("block"))
    return slim.groupBy("grp", "block").applyInArrow(run, "grp string, idx long, n long, node string")


PATH = "array<struct<left:string,right:string>>"


def _upward(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (grp, idx, n, node) -> (grp, idx, path, top): each node's siblings up to the top of its group. Blocks first give
    their tops, which are nodes again, fewer by the size of a block; their paths are appended to those inside the blocks."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("grp", "idx", F.lit(None).cast(PATH).alias("path"), F.col("node").alias("top")).withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    over = _upward(table(_tops(nodes, levels), "merkle-tops"), levels)

    def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, leaves = _sorted(rows)
        up = upper["path"][0].as_py()
        got = [[{"left": a.decode(), "right": b.decode()} for a, b in p] + up for p in paths(leaves, _block_levels(rows["n"][0].as_py(), levels))]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"grp": rows["grp"], "idx": rows["idx"], "path": pa.array(got, kind), "top": pa.array([upper["top"][0].as_py()] * len(leaves))})

    slim = nodes.select("grp", "idx", "n", "node", F.expr(f"idx div {ARITY**levels}").alias("block"))
    out = slim.groupBy("grp", "block").cogroup(over.groupBy("grp", "idx")).applyInArrow(run, f"grp string, idx long, path {PATH}, top string")
    return table(out, "merkle-paths")


def manifest(rows: DataFrame, proofs: bool = True, levels: int = BLOCK_LEVELS) -> DataFrame:
    """rows: group (a string), id, leaf, and found, the digest that the row has now -> id, leaf, subroot (its group's root),
    root, proof_sha256, folded_root (from found and the leaf's siblings), verified, and with proofs ``proof``, the siblings
    left and right of the way, level by level.

    Per group, leaves stand by id, null first, then by leaf. While there are several nodes, every eight in a row (the last
    run: fewer) become the digest of their digests. The groups' roots, null first, then bytewise, are leaves of one tree more.

    Equal rows are leaves beside each other. A group of one row is its own subroot; an empty table gives an empty result. Only
    digests are sorted and shuffled, never texts. Blocks of ``levels`` levels (4,096 leaves) are worked on alone; what a task holds is
    one block's digests, whatever the size of a group.
    """
    grp = F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))  # null sorts first and is a group
    digests = table(rows.select(grp.alias("grp"), "id", F.col("leaf").alias("node"), "found"), "merkle-digests")  # ranges sample their rows: not twice from texts
    placed = table(_placed(digests, [F.col("id").asc_nulls_first(), F.col("node")]), "merkle-leaves")
    blocks = table(_tops(placed, levels), "merkle-tops")
    over = _upward(blocks, levels)
    subroots = over.groupBy("grp").agg(F.first("top").alias("node"))
    all_ = table(_placed(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), [F.col("name")]), "merkle-groups")
    last = _upward(all_.select("grp", "idx", "n", "node"), levels).withColumnRenamed("path", "rest").withColumnRenamed("top", "root")
    last = all_.select("idx", F.col("name").alias("grp"), F.col("node").alias("subroot")).join(last.drop("grp"), "idx").drop("idx")
    over = over.join(last, "grp").select("grp", "idx", F.concat("path", "rest").alias("path"), "subroot", "root")
    kind = rows.schema["id"].dataType.simpleString()

    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, leaves = _sorted(block)
        up = [(x["left"].encode(), x["right"].encode()) for x in upper["path"][0].as_py()]
        subroot, root = upper["subroot"][0].as_py(), upper["root"][0].as_py()
        sums, folds, kept = [], [], []
        for leaf, path in zip((x.encode() for x in block["found"].to_pylist()), paths(leaves, _block_levels(block["n"][0].as_py(), levels)), strict=True):
            path += up
            sums.append(digest(*(x for both in path for x in both)).decode())
            folds.append(folded(leaf, path).decode())
            if proofs:
                kept.append([{"left": a.decode(), "right": b.decode()} for a, b in path])
        out = {"id": block["id"], "leaf": block["node"], "subroot": pa.array([subroot] * len(folds)), "root": pa.array([root] * len(folds)), "proof_sha256": sums, "folded_root": folds, "verified": [f == root for f in folds]}
        if proofs:
            out["proof"] = pa.array(kept, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table(out)

    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {PATH}" * proofs
    slim = placed.withColumn("block", F.expr(f"idx div {ARITY**levels}"))
    return slim.groupBy("grp", "block").cogroup(over.groupBy("grp", "idx")).applyInArrow(run, schema)


def check(docs: DataFrame, proofs: DataFrame, root: str, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """id, verified: whether each row of docs still folds to root along its proof (id, proof; one row for each id). A row
    without a proof is not verified; several rows of one id are checked each."""
    up = F.aggregate("proof", F.col("_leaf"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), leaf_of({c: F.col(c) for c in fields}).alias("_leaf"))
    return rows.join(proofs.select(F.col("id").alias("_id"), "proof"), F.col("id").eqNullSafe(F.col("_id")), "left").select("id", F.coalesce(up == root, F.lit(False)).alias("verified"))


def tampered(docs: DataFrame) -> DataFrame:
    """group, id, leaf and found of docs: in a third of the rows, by a checksum of the id, the text found is in lower case."""
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf_of(fields).alias("leaf"), F.when(changed, leaf_of(fields | {"text": lower})).alias("found"))
    return rows.withColumn("found", F.coalesce("found", "leaf"))
