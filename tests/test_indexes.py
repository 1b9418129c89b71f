"""Vector index, postings, partitioned tables and the stream of interactions."""

from __future__ import annotations

import glob
import math
import os
import random
import re
import shutil
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tarnwick.config import InterestConfig
from tarnwick.engine import BLOCKS_A_PARTITION, Engine
from tarnwick.operators import postings, search, vector_index
from tarnwick.operators.search import bm25, knn, ranked, top
from tarnwick.plans import indexes
from tarnwick.streaming import stateful

NOW = datetime(2024, 3, 1, 12, tzinfo=UTC)
SF = "/root/testdata/sf0.1"


def vectors(spark, n=900, dim=8, seed=1):
    """Clusters of unequal sizes, one with a third of all rows, and equal vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[0 if i % 3 == 0 else rng.integers(12)] + 0.4 * rng.normal(size=dim)
        v = centres[1] if i % 50 == 7 else v
        rows.append((f"d{i:04d}", i % 2, (v / np.linalg.norm(v)).astype(np.float32).tolist(), "a" if i % 90 == 0 else "b"))
    return spark.createDataFrame(rows, "document_id string, sub_id long, embedding array<float>, kind string").repartition(4)


def asked(rows, every=20):
    q = rows.where(F.expr("try_cast(substring(document_id, 2) AS int)") % every == 0)
    return q.select(F.col("document_id").alias("q"), F.col("embedding").cast("array<double>").alias("vec"), F.array("document_id").alias("exclude"))


def hits(df):
    return sorted((r["q"], r["document_id"], r["sub_id"], round(r["score"], 9)) for r in df.collect())


# --- vector index ---


def test_index_holds_every_row_in_its_nearest_list(spark):
    rows = vectors(spark)
    index = vector_index.build(rows, n_lists=20)
    got = index.lists.collect()
    centroids = index.centroids()
    assert len(got) == 900 and sorted(r["document_id"] for r in got) == sorted(r["document_id"] for r in rows.collect())
    for r in got[::37]:
        far = ((centroids - np.array(r["embedding"])) ** 2).sum(axis=1)
        assert far[r["list"]] == pytest.approx(far.min()) and r["far"] == pytest.approx(math.sqrt(far.min()))
    again, probes = vector_index.fit(rows, 20)
    assert (again == centroids).all() and index.probes() == probes


def test_exact_searches_equal_the_scan(spark):
    rows = vectors(spark)
    index = vector_index.build(rows, n_lists=30)
    want = hits(knn(rows, asked(rows), 7))
    assert hits(vector_index.search(index, asked(rows), 7, probes=30)) == want
    assert hits(vector_index.search(index, asked(rows), 7, probes=1, exact=True)) == want
    assert hits(vector_index.search(index, asked(rows), 7, candidates=1, exact=True)) == want
    own = asked(rows).withColumn("k", F.when(F.col("q") < "d0300", 3).otherwise(12))
    assert hits(vector_index.search(index, own, 7, exact=True)) == hits(knn(rows, own, 7))


def by_hand(rows, queries, k=None):
    """All pairs, in Python."""
    kept = [(r["document_id"], r["sub_id"], np.array(r["embedding"], np.float64)) for r in rows.collect()]
    out = []
    for q in queries.collect():
        scores = [((1 + min(1.0, max(-1.0, float(sum(e * np.array(q["vec"])))))) / 2, d, s) for d, s, e in kept if d not in (q["exclude"] or [])]
        scores = sorted(scores, key=lambda r: (round(r[0], 12), *r[1:]), reverse=True)
        out += [(q["q"], d, s, round(x, 9)) for x, d, s in scores[: k or q["k"]]]
    return sorted(out)


@pytest.mark.parametrize("most", [1000, 7])
def test_queries_of_one_vector_are_looked_up_together(spark, monkeypatch, most):
    """Each leaves out documents of its own; where those have many snippets, it is looked up alone."""
    monkeypatch.setattr(search, "MOST_SHARED", most)
    scanned = []
    monkeypatch.setattr(search, "_scanned", lambda rows, asked, f=search._scanned: scanned.append(asked.count()) or f(rows, asked))
    rows = vectors(spark, 300).withColumn("document_id", F.concat(F.substring("document_id", 1, 3), F.lit("x")))  # 30 documents of 10 snippets
    rows = rows.withColumn("sub_id", F.row_number().over(Window.partitionBy("document_id").orderBy(F.hash("embedding"), "sub_id")).cast("long"))
    some = rows.where("sub_id = 1").orderBy("document_id").limit(3).select(F.col("embedding").cast("array<double>").alias("vec"))
    users = spark.range(40).select(F.concat(F.lit("u"), "id").alias("u"), F.when(F.col("id") > 2, F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: F.format_string("d%02dx", (i * 7 + F.col("id")) % 30))).alias("exclude"), (1 + F.col("id") % 5).cast("int").alias("k"))
    queries = some.crossJoin(users).select(F.concat_ws("/", "u", F.hash("vec").cast("string")).alias("q"), "vec", "k", "exclude").cache()
    assert hits(knn(rows, queries)) == by_hand(rows, queries)
    assert scanned[0] == 3 and sum(scanned) < queries.count()


def test_the_scan_pairs_no_blocks_and_the_index_no_query_with_every_list(spark, monkeypatch):
    """Rows stream past queries; before, a row of a join had a block of each, and ten thousand such went to Python at once."""
    rows = vectors(spark)
    plan = knn(rows, asked(rows), 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    index = vector_index.build(rows, n_lists=20)
    monkeypatch.setattr(vector_index, "_probed", lambda *a: pytest.fail("queries are paired with lists"))
    for all_lists in ({"probes": 20}, {"candidates": 1 << 31}):
        assert hits(vector_index.search(index, asked(rows), 10, **all_lists)) == by_hand(rows, asked(rows), 10)


def test_equal_vectors_tie_wherever_they_stand(spark):
    """Copies in batches and cells of all sizes have one score, so the larger id comes first."""
    v = (np.random.default_rng(3).normal(size=64) / 8).astype(np.float32).tolist()
    rows = spark.range(30_011).select(F.format_string("d%05d", "id").alias("document_id"), F.lit(0).cast("long").alias("sub_id"), F.lit(v).alias("embedding"))
    q = spark.createDataFrame([(f"q{i}", [float(x) * (i + 1) / 99 for x in v]) for i in range(7)], "q string, vec array<double>")
    got = hits(knn(rows, q, 5))
    assert [(r[0], r[1]) for r in got] == sorted((f"q{i}", f"d{30_010 - j:05d}") for i in range(7) for j in range(5))


def test_filters_leave_as_many_results_as_exist(spark):
    """Ten rows pass: a query whose lists have too few of them looks into the others."""
    rows = vectors(spark)
    index = vector_index.build(rows, n_lists=30)
    want = hits(knn(rows.where("kind = 'a'"), asked(rows), 8))
    assert hits(vector_index.search(index, asked(rows), 8, probes=1, condition=F.col("kind") == "a", exact=True)) == want
    loose = vector_index.search(index, asked(rows), 8, probes=1, shown=rows.where("kind = 'a'"))
    assert loose.groupBy("q").count().where("count <> 8").count() == 0
    none = vector_index.search(index, asked(rows), 8, condition=F.col("kind") == "z")
    assert none.count() == 0


def test_recall_of_the_default(spark):
    got = {(r["q"], r["document_id"]) for r in indexes.knn_ivf(spark, SF).collect()}
    want = {(r["q"], r["document_id"]) for r in indexes.knn_ivf_exact(spark, SF).collect()}
    print("recall", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)


def test_only_probed_lists_are_read(spark):
    index = vector_index.build(vectors(spark), n_lists=30)
    plan = index.lists.where(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list", plan)


def test_refresh_moves_rows_of_changed_documents(spark):
    rows = vectors(spark, 200)
    index = vector_index.build(rows, n_lists=10)
    new = spark.createDataFrame([("d0003", 0, [1.0] + [0.0] * 7, "b"), ("d0003", 1, [0.0, 1.0] + [0.0] * 6, "b"), ("new", 0, [0.0] * 7 + [1.0], "a")], rows.schema)
    changed = spark.createDataFrame([("d0003",), ("d0004",), ("new",)], "document_id string")
    vector_index.refresh(index, changed, new)
    after = rows.join(changed, "document_id", "left_anti").unionByName(new)
    assert index.lists.count() == 198 - 0 + 3
    assert hits(vector_index.search(index, asked(after), 5, exact=True)) == hits(knn(after, asked(after), 5))


# --- postings ---


def texts(spark, n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i}", j, " ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.choice([0, 1, 8, 60])))) for i in range(n) for j in range(1 + i % 2)]
    rows += [("rare", 0, "Zebra zebra w1"), ("rare2", 0, "zebra " + "w3 " * 50), ("blank", 0, " ?! "), ("null", 0, None), ("ü", 0, "Ünd w1-w2")]
    return spark.createDataFrame(rows, "document_id string, sub_id long, text string")


@pytest.fixture(scope="module")
def scanned(spark):
    """Texts, queries, and by query the scores of the scan, of all snippets and under a filter; best first."""
    docs = texts(spark).cache()
    queries = {"one": "w1", "rare": "zebra", "mixed": "zebra w1 w2 w3", "many": " ".join(f"w{i}" for i in range(0, 60, 3)), "twice": "w7 w7 W8", "none": "unheard", "umlaut": "ünd W1"}
    condition = (F.col("sub_id") == 0) & F.col("document_id").like("%1%")
    scores = {(name, bool(c is not None)): sorted((r["score"] for r in bm25(docs, text, c).collect()), reverse=True) for name, text in queries.items() for c in (None, condition)}
    return docs, queries | {"blank": " . "}, docs.where(condition), scores


@pytest.mark.parametrize("blocks", [1, 64])
def test_postings_give_the_scan_s_scores(spark, scanned, blocks):
    docs, queries, shown, scores = scanned
    index = postings.build(docs, blocks).cache()
    q = spark.createDataFrame(list(queries.items()), "q string, text string")
    for k, rows, filtered in ((10, None, False), (10, shown, True), (1000, None, False)):
        got = postings.search(index, q, k, rows).collect()
        for name in queries:
            have = sorted((r["score"] for r in got if r["q"] == name), reverse=True)
            assert have == pytest.approx(scores.get((name, filtered), [])[:k]), (name, k, filtered)
        assert len({(r["q"], r["document_id"], r["sub_id"]) for r in got}) == len(got)


@pytest.mark.parametrize("blocks", [1, 64])
def test_postings_past_cells_give_the_same(spark, scanned, blocks, monkeypatch):
    """Where queries and snippets share many terms, their pairs aren't shuffled: only each share's best snippets leave a task."""
    docs, queries, shown, scores = scanned
    index = postings.build(docs, blocks).cache()
    q = spark.createDataFrame(list(queries.items()), "q string, text string")
    inner, rows_out = postings._of_cells, []
    monkeypatch.setattr(postings, "_of_cells", lambda *a: (rows_out.append(inner(*a).count()), inner(*a))[1])
    for k, rows, filtered in ((10, None, False), (10, shown, True), (3, docs.where("false"), True), (1000, None, False)):
        pairs = postings.search(index, q, k, rows).collect()
        with monkeypatch.context() as m:
            for name, n in (("MOST_SHUFFLED", 0), ("MOST_PUSHED", 5), ("QUERIES_A_CELL", 3), ("SHARES", 5), ("SCORES_AT_ONCE", 600)):
                m.setattr(postings, name, n)
            got = postings.search(index, q, k, rows).collect()
        assert sorted(got) == sorted(pairs)
        assert rows_out.pop() <= 5 * k * len(queries) and not rows_out
        for name in queries if rows is None or filtered and k == 10 else ():
            have = sorted((r["score"] for r in got if r["q"] == name), reverse=True)
            assert have == pytest.approx(scores.get((name, filtered), [])[:k]), (name, k, filtered)


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    """With 64 blocks whatever the size, a task gathered a 64th of all snippets."""
    monkeypatch.setattr(postings, "ROWS_A_BLOCK", 1)
    got = indexes._postings(spark, "/root/testdata/sf0.001").select("block").distinct().count()
    assert got > 64 and postings.blocks_for(10) == 64


def test_blocks_that_cannot_reach_the_result_are_not_scored(spark, monkeypatch):
    """A rare word lies in few blocks: of those that have the frequent words only, none is scored a second time."""
    docs = texts(spark, 2000)
    index = postings.build(docs, 256).cache()
    q = spark.createDataFrame([("q", "zebra w1")], "q string, text string")
    seen = []
    inner = postings._scores
    monkeypatch.setattr(postings, "_scores", lambda a, p, s: (seen.append(a.select("q", "block").distinct().count()), inner(a, p, s))[1])
    got = [r["document_id"] for r in ranked(postings.search(index, q, 2)).orderBy("rank").collect()]
    assert got == ["rare", "rare2"]
    having = index.where("term in ('zebra', 'w1')").select("block").distinct().count()
    assert seen[0] == 2 and sum(seen) < having / 10 and having > 100


def test_no_text_is_read_and_terms_reach_the_scan(spark, tmp_path):
    postings.build(texts(spark), 16).sortWithinPartitions("term").write.parquet(str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    plan = index.where(F.col("term").isin("", "w1")).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "docs" not in plan.split("ReadSchema")[1]


# --- a tenant's tables ---


def files(root, *tables):
    return {f: os.stat(f).st_mtime_ns for t in tables for f in glob.glob(f"{root}/{t}/**/*.parquet", recursive=True)}


def touched(before, after):
    """Partitions with files that came or went."""
    return {os.path.dirname(f) for f in set(before) ^ set(after)}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("base")
    e = Engine(spark, str(root), "t")
    e.store.create("t", partitions=4)
    words = {"sport": "ball goal team match", "food": "soup bread salt pan", "sky": "star moon cloud rain"}
    e.upsert([{"id": f"{k}{i}", "snippet": f"{w} {k} number{i}", "tags": [k, "all"]} for k, w in words.items() for i in range(8)])
    return root


@pytest.fixture
def engine(spark, tmp_path, base):
    shutil.copytree(base, tmp_path / "tenants")
    return Engine(spark, str(tmp_path / "tenants"), "t")


def test_an_interaction_rewrites_one_partition(engine):
    root = engine.store.path("t", "")[:-1]
    for u in range(2):
        engine.interact(f"u{u}", [("sky0", 0)], NOW)
    names = ("center_of_interest", "weighted_tag", "users", "interaction")
    before, documents = files(root, *names), files(root, "document", "snippet", "postings")
    engine.interact("u1", [("food1", 0), ("gone", 0)], NOW + timedelta(hours=1))
    changed = touched(before, files(root, *names))
    part = engine.store.parts("t", ["u1"])[0]
    assert changed == {f"{root}/{n}/part={part}" for n in names}
    assert files(root, "document", "snippet", "postings") == documents
    before = files(root, *names)
    engine.recommend_user("u1", count=3, now=NOW + timedelta(days=2))
    assert touched(before, files(root, *names)) == {f"{root}/users/part={part}"}
    assert engine.store.table("t", "users").count() == 2 and engine.store.table("t", "interaction").count() == 3


def test_a_document_rewrites_one_partition(engine):
    root = engine.store.path("t", "")[:-1]
    names = ("document", "snippet", "postings")
    part = engine.store.parts("t", ["food3"])[0]
    before = files(root, *names)
    engine.put_tags("food3", ["x"])
    assert touched(before, files(root, *names)) == {f"{root}/document/part={part}/is_candidate=true"}
    before = files(root, *names)
    engine.add_candidates(["food3"], False)
    changed = touched(before, files(root, *names))
    assert {c.replace(f"{root}/", "") for c in changed} >= {f"document/part={part}/is_candidate=false", f"postings/part={part}"}
    assert all(f"part={part}" in c for c in changed) and not any("snippet" in c for c in changed)
    assert "food3" not in {r[0] for r in engine.candidates().collect()} and engine.store.table("t", "document").count() == 24
    engine.delete(["food3"])
    assert engine.store.table("t", "document").count() == 23 and engine.store.table("t", "snippet").where("document_id = 'food3'").count() == 0


def test_an_emptied_partition_is_empty(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "tenants"), "t")
    e.store.create("t", partitions=64)
    e.upsert([{"id": "a", "snippet": "one text"}, {"id": "b", "snippet": "another text"}])
    e.delete(["a"])
    t = e.store.tables("t")
    assert [r[0] for r in t["document"].select("document_id").collect()] == ["b"] == [r[0] for r in t["snippet"].select("document_id").collect()]
    assert t["postings"].where("term = 'one'").count() == 0
    e.set_candidates([])
    assert e.candidates().count() == 0 and e.store.table("t", "postings").count() == 0 and e.store.table("t", "document").count() == 1


def test_scans_are_pruned(engine):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*is_candidate", plan(engine.candidates()))
    assert re.search(r"PartitionFilters: \[.*part#\d+ = \d|PartitionFilters: \[.*part#\d+ IN", plan(engine._of("snippet", "food1")))


def test_partition_of_a_key_is_spark_s(spark, engine):
    keys = ["", "a", "user-7", "ünï", "x" * 500]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", engine.store.part(F.col("k"), 13).alias("p")).collect()
    assert all(engine.store.part_of(r["k"], 13) == r["p"] for r in got)


def test_postings_of_a_tenant_follow_its_documents(spark, engine):
    engine.upsert([{"id": "sky1", "snippet": "wholly new words"}, {"id": "more", "snippet": "soup of stars"}])
    engine.delete(["food0"])
    engine.add_candidates(["food2"], False)
    rows = engine.store.table("t", "snippet").join(engine.candidates(), "document_id")
    want = postings.build(rows.select("document_id", "sub_id", F.col("snippet").alias("text")), 4 * BLOCKS_A_PARTITION)
    key = lambda df: sorted((r["block"], r["term"], r["n"], r["max_tf"], r["min_dl"], r["docs"]) for r in df.collect())
    assert key(engine.store.table("t", "postings")) == key(want)
    found = engine.search(text="soup words", count=5, hybrid=True, show_raw_scores=True, filter={"$ids": ["sky1", "more", "food5"]})
    lexical = {r["document_id"]: r["score"] for r in bm25(rows.withColumnRenamed("snippet", "text"), "soup words").collect()}
    assert {r["document_id"]: r["bm25_score"] for r in found.collect() if r["bm25_score"]} == {d: pytest.approx(lexical[d]) for d in ("sky1", "more", "food5")}


def test_vectors_of_a_tenant_follow_its_documents(spark, engine):
    engine.index_vectors(6)
    engine.upsert([{"id": "sky1", "snippet": "wholly new words"}, {"id": "more", "snippet": "soup of stars"}])
    engine.delete(["food0"])
    same = lambda **how: [(r["document_id"], round(r["score"], 9)) for r in engine.search(text="soup bread new", count=8, **how).collect()]
    assert same(num_candidates=100) == same()
    assert {r["document_id"] for r in engine.search(text="soup bread salt pan food", count=3, num_candidates=3).collect()} <= {f"food{i}" for i in range(1, 8)}


# --- interactions as a stream ---


def user_tables(engine):
    t = engine.store.tables(engine.tenant)
    centres = sorted((r["user_id"], r["coi_id"], r["view_count"], r["view_time_ms"], r["last_view"], [round(x, 9) for x in r["point"]]) for r in t["center_of_interest"].collect())
    return centres, *(sorted(map(tuple, t[n].collect())) for n in ("weighted_tag", "users", "interaction"))


def test_stream_ends_as_replayed_calls(spark, tmp_path, engine, monkeypatch):
    """Users with and without interests from before, unknown snippets, three micro-batches with a restart between them, and one
    that fails when its tables are written but not yet noted, so that it is written twice."""
    rng = random.Random(4)
    ids = [f"{k}{i}" for k in ("sport", "food", "sky") for i in range(8)] + ["gone"]
    calls = []
    for b in range(3):
        calls.append([(f"u{u}", [(rng.choice(ids), 0) for _ in range(rng.randint(1, 4))], NOW + timedelta(days=b, minutes=u)) for u in range(3) if (u + b) % 3])
    twin = Engine(spark, str(tmp_path / "tenants"), "t2")
    twin.store.create("t2", partitions=4)
    other = engine.store.tables("t")
    twin.store.commit("t2", {n: other[n] for n in ("document", "snippet")})
    for e in (engine, twin):
        e.interact("u1", [("sky0", 0), ("food2", 0)], NOW - timedelta(days=1))
        e.interact("u9", [("sky0", 0)], NOW - timedelta(days=1))
    schema = "user_id string, document_id string, sub_id long, event_id long, time_stamp timestamp"
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for b, batch in enumerate(calls):
        rows = [(u, d, s, i, t) for u, docs, t in batch for i, (d, s) in enumerate(docs)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        if b == 2:
            with monkeypatch.context() as m:
                m.setattr(engine.store, "_log", lambda *a: 1 / 0)
                with pytest.raises(Exception, match="ZeroDivisionError"):
                    engine.interact_stream(stream, checkpoint).awaitTermination()
        engine.interact_stream(stream, checkpoint).awaitTermination()
        for u, docs, t in batch:
            twin.interact(u, docs, t)
    versions = len(engine.store.versions("t"))
    engine.interact_stream(stream, checkpoint).awaitTermination()  # nothing new
    assert len(engine.store.versions("t")) == versions
    assert user_tables(engine) == user_tables(twin)
    notes = [r["note"] for r in engine.store.commits("t").where("note like 'stream%'").orderBy("version").collect()]
    assert len(notes) == 3 and len(set(notes)) == 3


def test_state_is_asked_once_for_all_tags_and_centres(spark):
    """A call to the state is a round trip, so there are as many for a user of 300 tags and 100 centres as for one of a few."""
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = rows

        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    states = {}
    handle = type("Handle", (), {f"get{k}State": lambda self, name, *a: states.setdefault(name, State()) for k in ("List", "Map", "Value")})()
    p = stateful.Interactions(InterestConfig())
    p.init(handle)
    row = Row("document_id", "sub_id", "event_id", "time_stamp", "embedding", "tags")
    rows = [row(f"d{i}", 0, i, 100 - i, np.eye(100)[i].tobytes(), [f"t{3 * i + j}" for j in range(3)]) for i in range(100)]
    rows += [row("gone", 0, 100, 500, None, None), row("d7", 0, 101, None, np.eye(100)[7].tobytes(), ["t0"])]
    out = [r for r in p.handleInputRows(("u",), iter(rows), None)]
    assert len(calls) <= 4
    assert {r["tag"]: r["weight"] for r in out if r["kind"] == "tag"} == {f"t{i}": 1 + (i == 0) for i in range(300)}
    assert [r["time_stamp"] for r in out if r["kind"] == "seen"] == [500] and sum(r["kind"] == "log" for r in out) == 101
    centres = [r for r in out if r["kind"] == "centre"]
    assert len(centres) == 100 and sorted(r["view_count"] for r in centres) == [1] * 99 + [2]
    again = [r for r in p.handleInputRows(("u",), iter(rows[:1]), None) if r["kind"] == "tag"]
    assert {r["tag"]: r["weight"] for r in again} == {"t0": 3, "t1": 2, "t2": 2} and len(calls) <= 8
