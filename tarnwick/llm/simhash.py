"""SimHash near-duplicates, found by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import packed, same_row, table, unpacked
from tarnwick.llm.components import components

#: Bits of a third of the fingerprint; two thirds make a part. Of a part's bits the first 31 are covered by the [31, 26]
#: Hamming code (covering radius 1), the other 11 stand for themselves.
THIRD, CODE_BITS = 21, 31
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Bands of a near-copy sketch and minima in each: of two texts whose shingle sets are alike by 0.8, all bands differ
#: with a chance of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, BAND_ROWS = 24, 4


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # on bytes: A-Z only, and the six ASCII blanks


def _shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; fewer than width words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)], np.uint64)


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is 1 if set in over half of the hashes."""
    return simhash_of(_shingle_hashes(_words(text), width))


def simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = np.array([simhash(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "tie": pdf["tie"], "fp": fp})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), fp (the fingerprint's 64 bits as a long)."""
    kind = docs.schema["doc_id"].dataType
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    out = slim.mapInPandas(_fingerprints, "doc_id string, tie long, fp long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def _syndrome(x: Column) -> Column:
    """Position (1 to 31) of the bit whose flip makes a codeword of x; 0 if x is one."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> k & 1)
        out = out + (F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << k)
    return out


def _around() -> Column:
    """By syndrome: the flips that lead to all anchors within covering radius + threshold = 2 of a part; the nearest first."""
    rest = [1 << i for i in range(CODE_BITS, 2 * THIRD)]
    flips = []
    for s in range(CODE_BITS + 1):
        near = 1 << (s - 1) if s else 0
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE_BITS + 1) if s and 0 < (i ^ s) and i < (i ^ s)]
        flips.append([near, *pairs, *[near | r for r in rest]])
    return F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in flips])


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of different fingerprints (column fp, each once) at 2 or fewer differing bits.

    The first 63 bits are three thirds; each pair of thirds is a part of 42 bits. Two differing bits that lie in two
    thirds leave one of them to two parts at most, and two in one third spare the part without it: some part differs in
    at most one bit. Each part has its anchors. A fingerprint goes to the anchor within radius 1 as a guest and to all
    anchors within 1 + 1 as a host, 27 at most; guest and host of a linked pair meet at the guest's anchor.
    """
    third = lambda i: F.shiftrightunsigned("fp", THIRD * i).bitwiseAND(F.lit((1 << THIRD) - 1).cast("long"))
    part = lambda k, i, j: F.struct(F.lit(k).alias("part"), third(i).bitwiseOR(F.shiftleft(third(j), THIRD)).alias("x"))
    parts = prints.select("fp", F.explode(F.array(part(0, 0, 1), part(1, 1, 2), part(2, 2, 0))).alias("p"))
    parts = parts.select("fp", "p.part", "p.x", _syndrome(F.col("p.x")).alias("s"))
    masks = F.element_at(_around(), F.col("s") + 1)
    hosts = parts.select(F.col("fp").alias("b"), "part", F.explode(F.transform(masks, lambda m: F.col("x").bitwiseXOR(m))).alias("anchor"))
    guests = parts.select(F.col("fp").alias("a"), "part", F.col("x").bitwiseXOR(F.element_at(masks, 1)).alias("anchor"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return guests.join(hosts, ["part", "anchor"]).where((F.col("a") > F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tie, fingerprint (16 hex digits), component_id: the least doc_id that links reach.

    docs: doc_id, text; other columns are ignored. Null and blank texts have the fingerprint zero and are linked
    like any other. Equal fingerprints are one node however many documents have them. A null doc_id is never the
    least one unless all of its component are null. An empty table gives an empty result.
    """
    prints = table(fingerprints(docs), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = table(nodes, "simhash-nodes")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(ids, "root").select("fp", "component_id")
    out = prints.join(of, "fp")
    return out.select("doc_id", "tie", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: of the least values of its rows' hash functions over the shingles."""
    rng = np.random.default_rng(42)
    n = BANDS * BAND_ROWS
    flip, odd = rng.integers(0, 1 << 63, (2, n, 1), np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024] ^ flip) * (odd | np.uint64(1))).min(axis=1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def _sketch(text: str | None, width: int) -> tuple:
    """node (a hash of the words), number of different shingles, fingerprint, band keys."""
    words = _words(text)
    hashes = _shingle_hashes(words, width)
    node = xxhash.xxh64_intdigest(b" ".join(words), 7)
    once = np.unique(hashes)
    return node - (1 << 64) if node >> 63 else node, len(once), np.uint64(simhash_of(hashes)).view(np.int64), _band_keys(once) if words else []


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_sketch(t, width) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tie": pdf["tie"]} | {c: [x[i] for x in out] for i, c in enumerate(("node", "n", "fp", "bands"))})

    kind = docs.schema["doc_id"].dataType
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = slim.mapInPandas(run, "doc_id string, tie long, node long, n long, fp long, bands array<long>")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, set): the different shingles, as hashes, of each node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "set": [np.unique(_shingle_hashes(_words(t), width)).view(np.int64) for t in pdf["text"]]})

    texts = docs.select(F.xxhash64("text").alias("tie"), "text").join(nodes, "tie").dropDuplicates(["node"])
    return texts.select("node", "text").mapInPandas(run, "node long, set array<long>")


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) plus ``same``, the number of their common shingles, and ``all``, that of all they have."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = both.withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.withColumn("all", F.size("x") + F.size("y") - F.col("same")).drop("x", "y")


def _enough(same: Column, all_: Column, least: float) -> Column:
    return same + 1e-9 >= all_ * F.lit(least)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    return _overlap(pairs, sets).where(_enough(F.col("same"), F.col("all"), least)).drop("same", "all")


def _close_prints(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs of nodes (node, fp) that reach all nodes whose fingerprints are equal or linked: each node
    with the least node of its fingerprint, and those of two linked fingerprints."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.join(heads, "fp").where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    of = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    linked = links(heads.select("fp")).withColumnsRenamed({"a": "f", "b": "g"}).join(of("f", "x"), "f").join(of("g", "y"), "g")
    return same.unionByName(linked.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def _renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with their ``root`` replaced by the one that roots (node, root) have for it."""
    to = roots.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    return rows.join(to, F.col("root") == F.col("_from"), "left").withColumn("root", F.coalesce("_to", "root")).drop("_from", "_to")


def _mixed(named: DataFrame) -> DataFrame:
    """The rows of named (bucket, root, ...) whose bucket has several roots."""
    buckets = named.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("bucket")
    return named.join(table(buckets, "near-mixed"), "bucket", "left_semi")


def _open_nodes(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shared): how many shingles of each node in left some other node in left has too."""
    each = left.select("node").distinct().join(sets, "node").select("node", F.explode("set").alias("g"))
    held = each.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = held.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = left.groupBy("node").agg(F.min("n").alias("n"))
    return sizes.join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, tie, component_id: the least doc_id that links reach. Two texts are linked if the sets of their word
    shingles have a Jaccard similarity of at least ``least``, in lower case and whatever the blanks.

    Texts of equal words are one node. Nodes whose fingerprints are 2 or fewer bits apart are found by the anchors, as in
    near_duplicates(). At 0.8 fingerprints differ by about ten bits, more than anchors can cover, so nodes that agree in
    a band of minimum hashes share a bucket too, in which comparisons stay between components. First each node is held
    against one node of each of its buckets. Then shingles that only one of the remaining nodes has are counted: they are in
    no intersection, so nodes with too many of them go. Then each node is held against its bucket's hub, the node with the
    least share of such shingles, and last against all that remain in its buckets and can be alike: a pair's common shingles
    are at most as many as the lesser of the two has in common with the hub, and as the lesser has beside it that others
    have too. A large group of near copies is joined by its hubs, and what is too far from a hub is too far from the rest
    by that bound. So it needs few of its pairs, and yet no two of a bucket stay apart unless their exact similarity, of
    whole shingle sets, is too small.

    Null and blank texts are one node; null doc_id as in near_duplicates(); repeated rows get the same component; an empty
    table gives an empty result; further columns are ignored.
    """
    rows = table(_sketches(docs, width), "near-sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("tie").alias("tie"), F.min("n").alias("n"), F.min("fp").alias("fp"))
    nodes = table(nodes, "near-nodes")
    close = table(_close_prints(nodes.where("n > 0").select("node", "fp")), "near-prints")
    buckets = rows.select("node", "n", F.explode("bands").alias("bucket")).groupBy("bucket", "node").agg(F.min("n").alias("n"))
    buckets = table(buckets, "near-buckets")
    mix = F.xxhash64("node", "bucket")
    heads = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), F.min(F.struct(mix.alias("mix"), F.col("node"), F.col("n"))).alias("head"))
    heads = heads.where("nodes > 1").select("bucket", F.col("head.node").alias("head"), F.col("head.n").alias("head_n"))
    buckets = table(buckets.join(table(heads, "near-heads"), "bucket"), "near-shared")

    wanted = buckets.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = table(_sets(docs, wanted.join(nodes, "node").select("node", "tie"), width), "near-sets")

    sizes = lambda m, n: F.least(m, n) + 1e-9 >= F.greatest(m, n) * F.lit(least)
    first = buckets.where((F.col("node") != F.col("head")) & sizes(F.col("n"), F.col("head_n")))
    first = first.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
    first = table(first.unionByName(close).distinct(), "near-pairs")
    roots = components(table(_alike(first, sets, least), "near-links"))
    named = table(_renamed(buckets.select("bucket", "node", "n", F.col("node").alias("root")), roots), "near-named")
    left = table(_mixed(named), "near-left")
    left = left.join(table(_open_nodes(left, sets), "near-open"), "node").where(F.col("shared") + 1e-9 >= F.col("n") * F.lit(least))
    left = table(left, "near-candidates")

    def merged(found: DataFrame) -> DataFrame:
        """found (pairs of nodes with their roots) -> (node, root) of the roots that they join."""
        return components(found.select(F.greatest("r1", "r2").alias("a"), F.least("r1", "r2").alias("b")))

    hub = F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), F.xxhash64("bucket", "node").alias("mix"), "node", "root")).alias("hub")
    hubs = table(left.groupBy("bucket").agg(hub).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.root").alias("r2")), "near-hubs")
    left = table(left.join(hubs, "bucket"), "near-spokes")
    second = left.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("root").alias("r1"), "r2").dropDuplicates(["a", "b"])
    second = table(_overlap(second, sets), "near-second")
    by_hub = merged(second.where((F.col("r1") != F.col("r2")) & _enough(F.col("same"), F.col("all"), least)))
    left = left.join(second.select(F.col("a").alias("node"), F.col("b").alias("hub"), "same"), ["node", "hub"])
    left = table(_mixed(_renamed(left, by_hub)), "near-rest").select("bucket", "node", "n", "root", "same", (F.col("shared") - F.col("same")).alias("extra"))
    right = left.select(F.col("bucket").alias("bucket2"), F.col("node").alias("m"), F.col("n").alias("n2"), F.col("root").alias("r2"), F.col("same").alias("same2"), F.col("extra").alias("extra2"))
    most = F.least("same", "same2") + F.least("extra", "extra2")
    can = _enough(most, F.col("n") + F.col("n2") - most, least)
    third = left.join(right, (F.col("bucket") == F.col("bucket2")) & (F.col("root") != F.col("r2")) & (F.col("node") > F.col("m")) & can)
    third = third.select(F.col("node").alias("a"), F.col("m").alias("b"), F.col("root").alias("r1"), "r2").dropDuplicates(["a", "b"])
    by_rest = merged(table(_alike(table(third, "near-third"), sets, least), "near-third-links"))

    nodes = nodes.select("node", "least", F.col("node").alias("root"))
    for found in (roots, by_hub, by_rest):
        nodes = _renamed(nodes, found)
    nodes = table(nodes, "near-roots")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(ids, "root").select("node", "component_id")
    return rows.select("doc_id", "tie", "node").join(of, "node").select("doc_id", "tie", "component_id")


def _one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("tie").alias("tie"))
    keyed = packed(docs, _id=F.col("doc_id"), _tie=F.xxhash64("text"))
    out = keyed.join(stay, same_row({"_id": "component_id", "_tie": "tie"}), "left_semi")
    again = out.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("_tie")))
    return unpacked(again.where("_nth = 1"), docs)


def near_dedup_stage(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the least doc_id (null only if all are
    null); of rows that share that id, one row. Columns and texts unchanged, whatever further columns are named; null and
    blank texts are one group; an empty table stays empty. Near-duplicates as in near_duplicates(): op4's 3 words and 2 bits."""
    return _one_each(docs, near_duplicates(docs))


def near_copies_stage(docs: DataFrame) -> DataFrame:
    """The same with the groups of near_copies(): five-word shingles alike by at least 0.8."""
    return _one_each(docs, near_copies(docs))
