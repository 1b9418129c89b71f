from __future__ import annotations

import base64
import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.config import BatchTooLarge, DocumentNotFound, EngineConfig, IncompatibleType, IncompatibleUpdate, InterestConfig, InvalidCount, InvalidFilter, InvalidProperties, InvalidUser, NotEnoughInteractions, PropertyNotFound, UnindexedId
from tarnwick.engine import Engine
from tarnwick.functions import ids, values
from tarnwick.operators import evaluate, filters, fusion, ingest, interests, personalize, split, summarize
from tarnwick.operators.embed import Embedder
from tarnwick.operators.search import bm25, knn, top
from tarnwick.sources import corpus, readers

NOW = datetime(2024, 2, 1, tzinfo=UTC)
SCHEMA = {"lang": "keyword", "n": "number", "on": "boolean", "at": "date", "many": "keyword[]"}


# --- filters ---


@pytest.mark.parametrize("good", [
    {"lang": {"$eq": "en"}}, {"on": {"$eq": True}}, {"at": {"$eq": "2024-01-01T00:00:00Z"}}, {"lang": {"$in": []}}, {"lang": {"$in": ["a"] * 500}},
    {"n": {"$gt": 1}}, {"n": {"$lte": -1.5}}, {"at": {"$lt": "2024-01-01T00:00:00+02:00"}}, {"$and": []}, {"$and": [{"$or": []}]}, {"$ids": []}, {"$ids": ["a"] * 500},
])
def test_filter_accepts(good):
    assert filters.parse(good) is not None


@pytest.mark.parametrize("bad", [
    {}, {"lang": {"$eq": None}}, {"lang": {"$eq": 1}}, {"lang": {"$eq": ["a"]}}, {"lang": {"$eq": "a", "$in": []}}, {"lang": {"$eq": "a"}, "n": {"$gt": 1}},
    {"lang": {"$in": ["a"] * 501}}, {"lang": {"$in": [1]}}, {"lang": {"$in": "a"}}, {"n": {"$gt": True}}, {"n": {"$gt": [1]}}, {"n": {"$gt": "no date"}}, {"n": {"$ne": 1}},
    {"$and": [{"$and": [{"$and": []}]}]}, {"$or": [{"n": {"$gt": 1}}] * 11}, {"$ids": ["a"] * 501}, {"$ids": ["b c"]}, {"$ids": ["_x"]}, {"a b": {"$eq": "x"}},
])
def test_filter_rejects(bad):
    with pytest.raises(InvalidFilter):
        filters.parse(bad)


def test_filter_schema_checks():
    with pytest.raises(UnindexedId):
        filters.validate(filters.parse({"other": {"$eq": "x"}}), SCHEMA)
    for bad in ({"many": {"$eq": "x"}}, {"n": {"$gt": "2024-01-01T00:00:00Z"}}, {"on": {"$eq": "true"}}, {"at": {"$eq": "x"}}):
        with pytest.raises(IncompatibleType):
            filters.validate(filters.parse(bad), SCHEMA)
    filters.validate(filters.parse({"$or": [{"lang": {"$in": ["x"]}}, {"many": {"$in": ["x"]}}, {"$ids": ["q"]}]}), SCHEMA)
    with pytest.raises(IncompatibleUpdate):
        filters.extend_schema(SCHEMA, {"lang": "number"})
    with pytest.raises(IncompatibleUpdate):
        filters.extend_schema(SCHEMA, {f"p{i}": "number" for i in range(7)})
    assert len(filters.extend_schema(SCHEMA, {f"p{i}": "number" for i in range(6)})) == 11


def test_ranges_merge():
    body = [{"n": {"$gt": 3}}, {"n": {"$gte": 3}}, {"n": {"$lt": 9}}, {"n": {"$lte": 12}}, {"lang": {"$eq": "x"}}]
    both = filters.merge_ranges(filters.parse({"$and": body}))
    assert {(c.op, c.value) for c in both.children} == {("$eq", "x"), ("$gt", 3), ("$lt", 9)}
    either = filters.merge_ranges(filters.parse({"$or": body}))
    assert {(c.op, c.value) for c in either.children} == {("$eq", "x"), ("$gte", 3), ("$lte", 12)}


def test_published_after_joins_a_root_and():
    tree = filters.published_after(filters.parse({"$and": [{"n": {"$gt": 1}}]}), "2024-01-01T00:00:00Z")
    assert len(tree.children) == 2
    assert filters.published_after(None, "2024-01-01T00:00:00Z").name == "publication_date"


def test_filter_over_stored_values(spark):
    rows = [("a", '{"lang":"en","n":5,"on":true,"many":["x","y"],"at":"2024-01-01T00:00:00Z"}'), ("b", '{"lang":7,"n":"5","on":"yes","many":[],"at":"soon"}'), ("c", "{}"), ("d", '{"lang":null}')]
    df = spark.createDataFrame(rows, "document_id string, p string").withColumn("properties", F.parse_json("p"))
    resolve = filters.from_json_column(F.col("properties"))
    hit = lambda f: sorted(r[0] for r in df.where(filters.compile_filter(filters.parse(f), SCHEMA, resolve)).select("document_id").collect())
    assert hit({"lang": {"$eq": "7"}}) == ["b"]
    assert hit({"n": {"$gte": 5}}) in (["a"], ["a", "b"])
    assert hit({"many": {"$in": ["y", "z"]}}) == ["a"]
    assert hit({"at": {"$lte": "2024-01-01T01:00:00+01:00"}}) == ["a"]
    assert hit({"$and": []}) == ["a", "b", "c", "d"] and hit({"lang": {"$in": []}}) == []
    assert hit({"$ids": ["c", "q"]}) == ["c"]


def test_the_fold_s_expression_compares_each_centre_once(spark):
    """Lambdas know no common subexpressions: what is named twice in them is worked out twice, or once for each centre or number."""
    e = spark.createDataFrame([], "events array<struct<t:timestamp,e:array<double>>>")
    plan = e.select(interests.fold_column(F.col("events")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("zip_with(") == 2  # the product, and the step


def test_pairs_stream_past_centres_across_batches(spark, monkeypatch):
    """No group of a user goes to Python by itself; users whose rows lie in many batches, or in many parts, have the same scores."""
    monkeypatch.setattr(interests, "ROWS_A_PART", 50)
    rng = np.random.default_rng(5)
    v = lambda: rng.normal(size=6).tolist()
    centres = [(f"u{u}", s, v(), float(rng.random()), float(rng.random())) for u in range(9) for s in range(u * 3)]
    pairs = [(f"u{u}", f"d{i}", 0, v()) for u in range(10) for i in range(1 + 25 * (u % 4))]
    c = spark.createDataFrame(centres, "user_id string, step int, point array<double>, decay double, relevance double")
    p = spark.createDataFrame(pairs, "user_id string, document_id string, sub_id long, embedding array<double>")
    want = {}
    for u, d, _, e in pairs:
        if mine := [x for x in centres if x[0] == u]:
            sims = [min(1.0, max(-1.0, float(np.dot(x[2], e)))) for x in mine]
            i = int(np.argmax(sims))
            want[u, d] = (sims[i] * mine[i][3] + mine[i][4] + 1) / 4
    out = interests.interest_scores(p, c)
    assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r["user_id"], r["document_id"]): r["score"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want)


# --- scores ---


def scores(spark, pairs):
    return spark.createDataFrame([(d, 0, s) for d, s in pairs], "document_id string, sub_id long, score double")


def as_dict(df):
    return {r["document_id"]: r["score"] for r in df.collect()}


def test_rrf_and_merges(spark):
    a, b = scores(spark, [("x", 9.0), ("y", 3.0)]), scores(spark, [("y", 0.7), ("z", 0.2)])
    assert as_dict(fusion.rrf(a, b)) == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})
    assert as_dict(fusion.rrf(a, b, weight_b=0.0)) == pytest.approx({"x": 1 / 61, "y": 1 / 62, "z": 0.0})
    assert as_dict(fusion.weighted_sum(a, b)) == pytest.approx({"x": 4.5, "y": 1.85, "z": 0.1})
    assert as_dict(fusion.average_duplicates_only(a, b)) == pytest.approx({"x": 9.0, "y": 1.85, "z": 0.2})
    assert as_dict(fusion.normalize(a)) == pytest.approx({"x": 1.0, "y": 1 / 3})
    assert as_dict(fusion.normalize(scores(spark, [("x", 0.0)]))) == {"x": 0.0}
    assert as_dict(fusion.normalize_if_max_gt1(b)) == pytest.approx({"y": 0.7, "z": 0.2})
    tied = scores(spark, [("a", 1.0), ("c", 1.0), ("b", 1.0)])
    assert [r["document_id"] for r in top(tied, 2).collect()] == ["c", "b"]


def test_knn_scores_and_exclusions(spark):
    rows = spark.createDataFrame([("same", 0, [1.0, 0.0]), ("right", 0, [0.0, 1.0]), ("back", 0, [-1.0, 0.0])], "document_id string, sub_id long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0], 3, []), ("r", [1.0, 0.0], 1, ["same"])], "q string, vec array<double>, k int, exclude array<string>")
    got = {(r["q"], r["document_id"]): r["score"] for r in knn(rows, q).collect()}
    assert got == pytest.approx({("q", "same"): 1.0, ("q", "right"): 0.5, ("q", "back"): 0.0, ("r", "right"): 0.5})


def test_bm25_prefers_rare_terms(spark):
    rows = spark.createDataFrame([("a", 0, "common rare"), ("b", 0, "common common"), ("c", 0, "common"), ("d", 0, "else")], "document_id string, sub_id long, text string")
    assert [r["document_id"] for r in top(bm25(rows, "Rare, common!"), 9).collect()][0] == "a"
    assert bm25(rows, "...").count() == 0


# --- interests ---


def test_fold_moves_or_adds():
    config = InterestConfig()
    state = interests.fold([], [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "u", config)
    assert [c["view_count"] for c in state] == [2, 1] and state[0]["last_view"] == 2
    p = np.array([0.98, 0.06])
    assert state[0]["point"] == pytest.approx(p / np.linalg.norm(p))
    interests.log_view_time(state, [0.0, 1.0], 500)
    assert [c["view_time_ms"] for c in state] == [0, 500]


def test_shift_golden(spark):
    three = lambda v: F.array(*[F.lit(float(x)) for x in v])
    a, e = values.normalized(three([1, 1, 1])), values.normalized(three([1, 2, 3]))
    got = spark.range(1).select(values.moved(a, e, 0.1).alias("p")).first()["p"]
    assert np.linalg.norm(got) == pytest.approx(1.0)
    assert got == sorted(got)


def test_decay_goldens(spark):
    at = lambda days: F.lit(NOW - timedelta(days=days))
    got = spark.range(1).select(interests.decay(at(5), F.lit(NOW), 30), interests.decay(at(-1), F.lit(NOW), 30), interests.decay(at(40), F.lit(NOW), 30), interests.decay(at(5), F.lit(NOW), 0)).first()
    assert tuple(got) == pytest.approx((0.58591455, 1.0, 0.0, 0.0))


def test_relevance_and_weights(spark):
    rows = [("u", "a", 3, 30, NOW), ("u", "b", 1, 0, NOW), ("v", "c", 0, 0, NOW - timedelta(days=99)), ("v", "d", 0, 0, NOW - timedelta(days=99))]
    df = spark.createDataFrame(rows, "user_id string, coi_id string, view_count long, view_time_ms long, last_view timestamp")
    got = {r["coi_id"]: r for r in interests.weights(interests.relevance(df, F.lit(NOW))).collect()}
    assert got["a"]["relevance"] == pytest.approx(1.75) and got["b"]["relevance"] == pytest.approx(0.25)
    assert got["a"]["weight"] + got["b"]["weight"] == pytest.approx(1.0)
    assert got["c"]["weight"] == got["d"]["weight"] == 0.5


def test_config_domain():
    for bad in ({"shift": 1.1}, {"threshold": -1.5}, {"min_interests": 0}, {"horizon_days": 1.5}):
        with pytest.raises(ValueError):
            InterestConfig(**bad)
    with pytest.raises(InvalidCount):
        EngineConfig().checked_count(101)
    with pytest.raises(InvalidCount):
        EngineConfig().checked_count(0)


def test_history(spark):
    t = lambda d: NOW - timedelta(days=d)
    rows = [("u", 0, "a", 0, None), ("u", 1, "b", 0, t(3)), ("u", 2, "a", 0, t(4)), ("u", 3, "c", 0, None)]
    h = spark.createDataFrame(rows, "user_id string, pos long, document_id string, sub_id long, time_stamp timestamp")
    filled = personalize.backfill_history(h, F.lit(NOW)).orderBy("pos").collect()
    days = [round((NOW.replace(tzinfo=None) - r["time_stamp"]).total_seconds() / 86400) for r in filled]
    assert days == [3, 3, 4, 0] and [r["warned"] for r in filled] == [False, True, False, False]
    used = personalize.trim_history(h, 3, 1)
    assert sorted((r["pos"], r["used"]) for r in used.collect()) == [(1, False), (2, False), (3, True)]


# --- values and text ---


def test_identifiers(spark):
    good, bad = ["a", ".a_b", "A-b:c@d", "x" * 256, " a "], ["", "_a", "a b", "é", "x" * 257, None]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "v string, ok boolean")
    assert df.where(ids.valid_document_id(F.col("v")) != F.col("ok")).count() == 0
    code = spark.createDataFrame([("d", 0), ("d", 3), ("_s.x", 2)], "d string, s long").select("d", "s", ids.encode_snippet_id(F.col("d"), F.col("s")).alias("c"))
    d, s = ids.decode_snippet_id(F.col("c"))
    assert code.where((d != F.col("d")) | (s != F.col("s"))).count() == 0


def test_values(spark):
    got = spark.range(1).select(values.properties_size(F.lit('{"p":"defghijklm"}')), values.average_pooled(F.expr("array(array(1D, 2D), array(3D, 4D), array(9D, 9D))"), F.expr("array(1, 1, 0)")), values.normalized(F.expr("array(0D, 0D)")), values.weighted_number(F.lit(0.25), 10), values.decoded_base64(F.lit("!")), values.parsed_date(F.lit("2024-01-01")))
    assert tuple(got.first()) == (27, [2.0, 3.0], [0.0, 0.0], 3, None, None)


def test_summaries_and_splits():
    assert summarize.summarize_one("") == "" and summarize.summarize_one("too short. again") == "too short. again"
    a = "the quick brown fox jumps over the lazy dog near the old river bank today"
    text = f"{a} one. {a} two. {a} three. {a} four. {a} five. {a} six."
    assert summarize.summarize_one(text).count(".\n") == 3
    parts = split.split_one(" ".join(f"Word{i} ends here." for i in range(400)), 50, 60)
    assert all(split.length(p) <= 60 for p in parts) and sum(map(split.length, parts)) == 1200
    assert all(split.length(p) <= 60 for p in split.split_one("w " * 1000, 50, 60)) and split.split_one(None) == []
    ranked = summarize.summarize_ranked_one(" ".join(f"{a.capitalize()} number{i}." for i in range(9)))
    assert ranked and len(ranked.split(". ")) <= 5


def test_ndcg_and_replay(spark):
    log = spark.createDataFrame([(1, "a-0 b-1 c-0")], "impression_id long, log string")
    clicks = evaluate.parse_clicks(log)
    ranked = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "impression_id long, document_id string, rank int")
    got = evaluate.replay(ranked, clicks, (1, 2, 9)).first()
    assert got["ndcg_at_1"] == 0 and got["ndcg_at_2"] == pytest.approx((1 / np.log2(3)) / (1 + 1e-5)) and got["ndcg_at_9"] == got["ndcg_at_2"]
    assert evaluate.choose(spark.range(100), 10, F.col("id")).collect() == evaluate.choose(spark.range(100).repartition(5), 10, F.col("id")).collect()


# --- ingestion ---


def test_candidate_resolution(spark):
    rows = [(s, d, e) for s in (None, True, False) for d in (None, True, False) for e in (None, True, False) if s is None or d is None]
    want = [s if s is not None else (e if e is not None else d) if d is not None else True for s, d, e in rows]
    df = spark.createDataFrame([(*r, w) for r, w in zip(rows, want, strict=True)], "s boolean, d boolean, e boolean, w boolean")
    assert df.where(ingest.resolve_candidate(F.col("s"), F.col("d"), F.col("e")) != F.col("w")).count() == 0


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "tenants"), "t1")
    engine.store.create("t1")
    engine.extend_schema({"kind": "keyword"})
    words = {"sport": "ball goal team match", "food": "soup bread salt pan", "sky": "star moon cloud rain"}
    docs = [{"id": f"{k}{i}", "snippet": f"{w} {k} number{i}", "properties": f'{{"kind":"{k}"}}', "tags": [k]} for k, w in words.items() for i in range(4)]
    report = {r["document_id"]: r["status"] for r in engine.upsert([*docs, {"id": "_bad", "snippet": "x"}, {"id": "empty", "snippet": ""}]).collect()}
    assert report["_bad"] == report["empty"] == "invalid" and report["food0"] == "new" and len(report) == 14
    again = {r["document_id"]: r["status"] for r in engine.upsert([docs[0], docs[1] | {"tags": ["other"]}, docs[2] | {"snippet": "new text"}]).collect()}
    assert again == {"sport0": "unchanged", "sport1": "changed", "sport2": "new"}
    with pytest.raises(BatchTooLarge):
        engine.upsert([docs[0]] * 101)

    first = engine.search(text="soup bread salt pan food", count=4).collect()
    assert {r["document_id"] for r in first} == {f"food{i}" for i in range(4)}
    near = engine.search(document_id="food0", count=3, filter={"kind": {"$eq": "food"}}).collect()
    assert {r["document_id"] for r in near} == {"food1", "food2", "food3"}
    mixed = engine.search(text="moon number2", count=5, hybrid=True, show_raw_scores=True, include_snippet=True).collect()
    assert mixed[0]["document_id"] == "sky2" and mixed[0]["bm25_score"] > 0 and mixed[0]["snippet"]

    with pytest.raises(NotEnoughInteractions):
        engine.recommend_user("u1")
    engine.interact("u1", [("sky0", 0), ("sky1", 0), ("gone", 0)], NOW)
    engine.interact("u1", [("sky1", 0)], NOW)
    t = engine.store.tables("t1")
    assert t["interaction"].count() == 2 and t["weighted_tag"].first()["weight"] == 3
    recommended = [r["document_id"] for r in engine.recommend_user("u1", count=2, now=NOW).orderBy("rank").collect()]
    assert set(recommended) == {"sky2", "sky3"}
    inline = engine.recommend([{"document_id": "food0"}, {"document_id": "food1"}], count=2, now=NOW).collect()
    assert {r["document_id"] for r in inline} == {"food2", "food3"}
    personal = engine.search(text="number3", count=5, user_id="u1", now=NOW).collect()
    assert "sky0" not in {r["document_id"] for r in personal}
    assert engine.store.tables("t1")["users"].first()["last_seen"] is not None
    later = NOW + timedelta(days=1)
    engine.recommend_user("u1", count=1, now=later)
    assert engine.store.tables("t1")["users"].first()["last_seen"].replace(tzinfo=UTC) == later
    by_history = engine.search(text="number3", count=5, history=[{"document_id": "sky0"}, {"document_id": "sky1"}, {"document_id": "sky1"}], now=NOW).collect()
    assert {r["document_id"] for r in by_history} and not {"sky0", "sky1"} & {r["document_id"] for r in by_history}
    assert len({r["score"] for r in by_history}) > 1
    with pytest.raises(InvalidUser):
        engine.search(text="x", user_id="u1", history=[])
    one, all_ = (engine.search(text="number3 sky", hybrid=True, show_raw_scores=True, filter=f, count=20, exclude_seen=False).collect() for f in ({"$ids": ["sky3"]}, None))
    raw = {r["document_id"]: r["bm25_score"] for r in all_}
    assert one[0]["bm25_score"] == pytest.approx(raw["sky3"])

    assert [r[0] for r in engine.set_candidates(["sky2", "nope"]).collect()] == ["nope"]
    assert [r[0] for r in engine.candidates().collect()] == ["sky2"]
    engine.add_candidates(["food0"])
    assert [r[0] for r in engine.delete(["food0", "nope"]).collect()] == ["nope"]
    assert sorted(r[0] for r in engine.candidates().collect()) == ["sky2"]
    engine.put_properties("sky2", None)
    assert engine.properties("sky2").first()[0] == "{}"
    engine.put_property("sky2", "kind", "night")
    assert engine.property("sky2", "kind").first()[0] == "night"
    engine.delete_property("sky2", "kind")
    with pytest.raises(PropertyNotFound):
        engine.property("sky2", "kind")
    with pytest.raises(DocumentNotFound):
        engine.property("gone", "kind")
    engine.extend_schema({"size": "number", "on": "boolean", "names": "keyword[]", "at": "date", "word": "keyword"})
    engine.put_properties("sky2", '{"size": 1.5, "on": true, "names": ["a", "b"], "at": "2024-01-02T03:04:05Z", "free": 7}')
    engine.put_property("sky2", "size", 3)
    engine.put_property("sky2", "other", ["x"])
    engine.delete_property("sky2", "free")
    assert json.loads(engine.properties("sky2").first()[0]) == {"size": 3, "on": True, "names": ["a", "b"], "at": "2024-01-02T03:04:05Z", "other": ["x"]}
    for name, bad in (("size", "3"), ("on", 1), ("names", "a"), ("at", "yesterday"), ("word", 5)):
        with pytest.raises(IncompatibleType):
            engine.put_property("sky2", name, bad)
    for bad in ('{"size": "3"}', '{"on": null}', '{"names": [1]}', '{"at": "x"}', '{"free": {"a": 1}}', '["no object"]', '{"long": "' + "x" * 2049 + '"}', '{"a b": 1}', json.dumps({f"k{i}": "x" * 600 for i in range(5)})):
        with pytest.raises(InvalidProperties):
            engine.put_properties("sky2", bad)
    told = engine.upsert([{"id": "p1", "snippet": "text", "properties": '{"size": true}'}, {"id": "p2", "snippet": "text", "properties": '{"size": 4}'}, {"id": "p3", "file": base64.b64encode(b" \n ").decode()}, {"id": "p4", "file": base64.b64encode(b"One. Two.").decode(), "split": False}, {"id": "p5", "file": base64.b64encode(b"One. Two.").decode()}, {"id": "p6", "file": base64.b64encode(b"One.").decode(), "summarize": True}])
    assert {r[0]: r[1] for r in told.collect()} == {"p1": "invalid", "p2": "new", "p3": "invalid", "p4": "invalid", "p5": "new", "p6": "invalid"}
    steps = {r["document_id"]: r["preprocessing_step"] for r in engine.store.tables("t1")["document"].collect()}
    assert steps["p5"] == "nltk_split_v1" and steps["p2"] == "none"
    engine.put_tags("sky2", ["x", "x"])
    engine.store.create("t2")
    assert engine.store.tenants() == ["t1", "t2"]
    engine.store.drop("t2")
    assert engine.store.tenants() == ["t1"] and engine.store.versions("t1")[0] == 1


def test_embedder_is_deterministic():
    a, b, zero = Embedder()(["same words", "same words", ""])
    assert (a == b).all() and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not zero.any()


# --- sources and plans ---


def test_readers(spark, tmp_path):
    (tmp_path / "clicks.tsv").write_text("1\tu\t2019\ta b\tx-1 y-0\n2\tv\t2019\t\tz-1\n")
    clicks = evaluate.parse_clicks(readers.click_log(spark, str(tmp_path / "clicks.tsv")))
    assert sorted(map(tuple, clicks.collect())) == [("1", "x", 1), ("1", "y", 0), ("2", "z", 1)]
    (tmp_path / "news.tsv").write_text("n1\tsport\tball\ttitle\ttext\n")
    assert readers.news(spark, str(tmp_path / "news.tsv")).first()["sub_category"] == "ball"
    (tmp_path / "p.json").write_text('{\n"name": ["a/b"]\n}')
    assert readers.json_document(spark, str(tmp_path / "p.json")).first()["name"] == ["a/b"]
    (tmp_path / "r.jsonl").write_text('{"id": "a", "snippet": "x", "tags": ["t"]}\n')
    assert readers.requests(spark, str(tmp_path / "r.jsonl")).first()["tags"] == ["t"]
    lines = [json.dumps({"id": f"d{i}", "snippet": "s"} | ({"unknown": 1} if i == 3 else {})) for i in range(6)] + ["no json"]
    (tmp_path / "many").mkdir()
    for k in range(2):
        (tmp_path / "many" / f"{k}.jsonl").write_text("\n".join(lines[k::2]) + "\n")
    got = readers.requests(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [r["id"] for r in got] == ["d0", "d2", "d4", None, "d1", None, "d5"] and [r["pos"] for r in got] == list(range(7))
    bad = ingest.validated(readers.requests(spark, str(tmp_path / "many"))).where("size(errors) > 0").count()
    assert bad == 2
    with pytest.raises(ValueError):
        readers.requests_of(spark, [{"id": "a", "unknown": 1}])
    readers.write_results(clicks, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    html = "<html><style>p{}</style><p>a &lt; b &amp;amp; c</p><!-- x --><script>1</script></html>"
    df = spark.createDataFrame([(html,)], "html string").select(readers.html_text(F.col("html")).alias("t"))
    assert df.first()["t"] == "a < b &amp; c"


def test_filters_and_columns_reach_the_scan(spark):
    tree = filters.parse({"$and": [{"lang": {"$eq": "en"}}, {"n_chars": {"$gte": 500}}]})
    rows = corpus.documents(spark, "/root/testdata/sf0.001").where(filters.compile_filter(tree, corpus.SCHEMA, corpus.by_columns())).select("document_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]


def test_queries_are_registered_with_sql():
    import __spark_entry__ as entry_points

    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


def test_view_times(spark):
    c = spark.createDataFrame([("u", "a", 0, [1.0, 0.0], 5), ("u", "b", 1, [0.0, 1.0], 0), ("v", "c", 0, [1.0, 0.0], 1)], "user_id string, coi_id string, step int, point array<double>, view_time_ms long")
    v = spark.createDataFrame([("u", [0.9, 0.1], 10), ("u", [0.8, 0.1], 1), ("w", [1.0, 0.0], 3)], "user_id string, embedding array<double>, view_ms long")
    assert {r["coi_id"]: r["view_time_ms"] for r in interests.view_times(v, c).collect()} == {"a": 16, "b": 0, "c": 1}


def test_users_with_many_rows_are_dealt_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([("u" if i % 3 else "v", str(i), 0, rng.normal(size=4).tolist()) for i in range(60)], "user_id string, document_id string, sub_id long, embedding array<double>")
    centres = spark.createDataFrame([(u, f"{u}{i}", i, rng.normal(size=4).tolist(), 0.5, 0.25, 0) for u in "uvw" for i in range(3)], "user_id string, coi_id string, step int, point array<double>, decay double, relevance double, view_time_ms long")
    views = pairs.select("user_id", "embedding", F.length("document_id").cast("long").alias("view_ms"))

    def both():
        return sorted((r["user_id"], r["document_id"], round(r["score"], 12)) for r in interests.interest_scores(pairs, centres).collect()), sorted((r["coi_id"], r["view_time_ms"]) for r in interests.view_times(views, centres).collect())

    whole = both()
    monkeypatch.setattr(interests, "ROWS_A_PART", 7)
    assert both() == whole and len(whole[0]) == 60 and len(whole[1]) == 9


def test_fold_after_earlier_centres_equals_one_fold(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    rows = [(f"u{i % 3}", NOW + timedelta(minutes=i), i, unit(rng.normal(size=3))) for i in range(60)]
    e = spark.createDataFrame(rows, "user_id string, time_stamp timestamp, event_id long, embedding array<double>")
    once = interests.fold_interactions(e)
    twice = interests.fold_interactions(e.where("event_id >= 25 and user_id <> 'u2'"), prior=interests.fold_interactions(e.where("event_id < 25 or user_id = 'u2'")))
    key = lambda df: sorted((r["user_id"], r["step"], r["coi_id"], r["view_count"], r["last_view"], [round(x, 9) for x in r["point"]]) for r in df.collect())
    assert key(once) == key(twice)
