"""Decontamination, Merkle manifest, divergence audit."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import decontaminate, divergence, merkle
from tests.llm import brute
from tests.llm.test_operators import ODD, frame, sentence

ITEMS = "item_id string, text string, doc_id string, tie long, words string, block int"


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", 2) for i, t in items], ITEMS)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(11)
    items = [(f"i{k}", sentence(rng, rng.randint(11, 60))) for k in range(12)]
    passage = sentence(rng, 30)
    items += [("shared-1", sentence(rng, 5) + " " + passage), ("shared-2", passage + " " + sentence(rng, 9)), ("short", "Zebra-quagga; okapi"), ("one", "Xyzzyx"), ("again", passage), ("again", items[0][1])]
    items += [(None, "null id words that are long enough to be one whole window of ten"), ("none", None), ("blank", " \n"), ("marks", "?! ...")]
    docs = [(i, sentence(rng, rng.randint(1, 80))) for i in range(40)]
    docs += [(50 + i, sentence(rng, 12) + ". " + " ".join(t.split()[a : a + 10 + i]).upper() + " -- " + sentence(rng, 7)) for i, (_, t) in enumerate(items[:12]) for a in (0, 1)]
    docs += [(80, passage + " " + passage), (81, "a zebra, QUAGGA okapi! zebra quagga okapi"), (82, "xyzzyx " * 30), (83, " ".join(passage.split()[:9])), (84, passage.replace(" ", "\n\n"))]
    docs += [(85, items[3][1]), (85, items[3][1]), (85, "other text of the same id"), (None, items[4][1]), (86, "null id WORDS that are long enough to be one whole window of ten ünd mehr")]
    docs += [(90 + i, t) for i, t in enumerate(ODD)]
    return docs, items


def leaks_of(rows):
    return sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), sorted((m["item_id"], m["item_start"], m["doc_start"], m["n_words"]) for m in r["matches"])) for r in rows)


@pytest.mark.parametrize("shard, block, chunk", [(1 << 20, 1 << 20, 1 << 16), (37, 1 << 20, 1 << 16), (200, 160, 40)])
def test_contamination_equals_trying_all_places(spark, leaks, shard, block, chunk):
    """Also with tiny shards, and with a benchmark of several blocks and items of several chunks: a match that runs over the
    end of a chunk is then told in parts, so only its words, items and documents are held."""
    docs, items = leaks
    got = leaks_of(decontaminate.contamination(frame(spark, docs), benchmark(spark, items), longest=True, shard_words=shard, block_words=block, chunk_words=chunk).collect())
    want = sorted((d is not None, d, n, h, i, m) for d, n, h, i, m in brute.contamination(docs, items))
    if block < 1 << 20:
        got, want = [g[:5] for g in got], [w[:5] for w in want]
    assert got == want


def test_clean_removes_documents_hit_and_keeps_columns(spark, leaks):
    docs, items = leaks
    got = decontaminate.clean(frame(spark, docs), benchmark(spark, items))
    want = sorted(str(d) for d, _, h, *_ in brute.contamination(docs, items) if not h)
    assert got.columns == frame(spark, docs).columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_contamination_of_nothing(spark, leaks):
    docs, items = leaks
    assert decontaminate.contamination(frame(spark, []), benchmark(spark, items)).count() == 0
    got = decontaminate.contamination(frame(spark, docs), benchmark(spark, [])).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] or r["items"] for r in got)


def test_long_text_and_hot_passage(spark):
    rng = random.Random(5)
    passage = sentence(rng, 40)
    docs = [(0, sentence(rng, 300_000) + " " + passage)] + [(i, sentence(rng, 3) + " " + passage + " " + sentence(rng, 3)) for i in range(1, 600)]
    items = [(f"i{k}", sentence(rng, 6) + " " + passage) for k in range(50)]
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, docs), benchmark(spark, items)).collect()}
    assert len(got) == 600
    assert all(r["n_hit"] >= 40 and len(r["items"]) == 50 for r in got.values())
    assert got[0]["spans"][-1]["b"] == 300_040


# --- Merkle manifest ---


def leaves_frame(spark, rows):
    full = [(*r, 1, 2, "n", "b") for r in rows]
    return spark.createDataFrame(full, "group string, id long, leaf string, found string, idx long, n long, node string, block string")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {"a": 65, None: 3, "": 1, "é": 64}, {"a": 700, "b": 1, "c": 513}, {f"l{i}": 1 + i % 3 for i in range(70)}])
@pytest.mark.parametrize("levels", [4, 2, 1])
def test_manifest_equals_whole_tree(spark, sizes, levels):
    """With blocks of 4,096, 64 and 8 leaves, so that the larger groups have several, up to three times over."""
    if levels == 1 and sum(sizes.values()) < 100:
        pytest.skip("one size of groups is enough here")
    rng = random.Random(sum(sizes.values()))
    digest = lambda x: brute.hashlib.sha256(str(x).encode()).hexdigest()
    rows = [(g, i, digest((g, i)), digest((g, i, rng.random() < 0.3))) for g, n in sizes.items() for i in range(n)]
    rows = [(g, i, leaf, leaf if rng.random() < 0.7 else found) for g, i, leaf, found in rows]
    rng.shuffle(rows)
    got = merkle.manifest(leaves_frame(spark, rows), levels=levels).collect()
    want = brute.merkle(rows)
    assert sorted((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got) == sorted(want)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)


def test_manifest_of_equal_rows_and_null_ids(spark):
    rows = [("a", 1, "x", "x")] * 20 + [("a", None, "y", "y")] * 3 + [(None, None, "z", "w"), (None, 4, "q", "q")]
    got = merkle.manifest(leaves_frame(spark, rows), proofs=False).collect()
    want = brute.merkle(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got), key=key) == sorted(want, key=key)
    assert merkle.manifest(leaves_frame(spark, [])).count() == 0


def test_check_finds_changed_rows(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(ODD)] + [(20 + i, f"Text {i}") for i in range(100)])
    rows = merkle.tampered(docs).withColumn("found", F.col("leaf"))
    proofs = merkle.manifest(rows).cache()
    root = proofs.first()["root"]
    assert all(r["verified"] for r in merkle.check(docs, proofs, root).collect())
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    got = {r["id"]: r["verified"] for r in merkle.check(changed.union(frame(spark, [(999, "new")])), proofs, root).collect()}
    assert {i for i, ok in got.items() if not ok} == {3, 999, *range(23, 120, 10)}


def test_traversal_holds_few_nodes():
    leaves = [str(i).encode() for i in range(4096)]
    run = merkle.Run(3)
    most = 0
    for leaf in leaves[: 8**4]:
        run.add(leaf)
        most = max(most, sum(map(len, run.waiting)))
    assert most <= 4 * merkle.ARITY
    assert merkle.folded(leaves[77], list(merkle.paths(leaves, 4))[77]) == merkle.top(leaves, 4)


# --- divergence ---


def test_audit_equals_plain_python(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "of", "Ünd", "naïve", "x9y", "in-side", "_", "42", "rare" + str(rng.randint(0, 40))])
    rows = [(rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "b", "c", None, "é"]), " ".join(word() for _ in range(rng.randint(0, 40)))) for _ in range(150)]
    rows += [("fr", "alone", "un deux"), ("it", "a", None), ("it", "b", ""), ("en", "empty", None), ("es", "a", "uno dos"), ("es", "a", "uno dos"), ("es", "b", "uno"), ("es", "c", "1 2 3")]
    rows += [("en", "hot", "x " * 5000)]
    docs = spark.createDataFrame([(7, *r, "t", 1, 2, "k") for r in rows], "doc_id long, lang string, source string, text string, term string, n long, rank int, kind string")
    want = sorted(brute.audit(rows))
    for chunk, gathered in ((1 << 24, 1 << 20), (64, 3)):
        got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs, chunk, gathered).collect())
        assert got == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_cuts_terms_at_200(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260)]
    rows = [("en", s, " ".join(words)) for s in ("a", "b") for _ in range(2)] + [("en", "b", "other " * 50)] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs).collect())
    assert got == sorted(brute.audit(rows))
    assert sum(r[1:3] == ("a", "term") for r in got) == 200


# --- all three ---

CLASHES = ["_row", "_id", "_tie", "_bad", "tie", "item", "item_id", "spans", "items", "grp", "idx", "node", "n", "block", "found", "leaf", "root", "_at", "_part", "term", "p", "q", "v", "words", "terms", "none", "kind", "value", "rank", "one"]


def test_clashing_columns_nulls_and_long_texts(spark):
    """Columns named like inner ones, a row of nulls, repeated rows and a text of a million words change nothing."""
    rng = random.Random(31)
    rows = [(i, sentence(rng, 30), rng.choice(["en", None]), f"s{i % 3}", 1) for i in range(20)] + [(None,) * 5] * 2 + [(50, "word " * 1_000_000 + sentence(rng, 12), "en", "s1", None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select(*[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES], "*")
    items = spark.createDataFrame([("a", rows[3][1]), ("b", "word " * 11)], "item_id string, text string")

    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows if r[0] not in (3, 50))
    assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASHES)
    hits = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert hits[50] == (1_000_012, 1_000_000, ["b"]) and hits[3] == (30, 30, ["a"]) and hits[None] == (0, 0, [])

    key = lambda df: sorted(map(str, df.collect()))
    proofs = merkle.manifest(merkle.tampered(docs), proofs=False)
    assert proofs.count() == 23 and key(proofs) == key(merkle.manifest(merkle.tampered(plain), proofs=False))
    assert key(divergence.audit(docs)) == key(divergence.audit(plain))
