"""Queries of histories, interests, reranking, recommendations and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.config import InterestConfig
from tarnwick.functions.values import interest_match as match
from tarnwick.operators import evaluate, personalize
from tarnwick.operators import interests as ci
from tarnwick.plans.common import CENTRES, with_corpus
from tarnwick.session import new_path
from tarnwick.sources import corpus
from tarnwick.streaming import interactions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Interests of the simulated personas.
PERSONAS = {"anglophone": ["en/src1", "en/src2"], "francophile": ["fr/src3"], "generalist": ["de/src4", "es/src5"]}


def now():
    """The time at which the queries are asked."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(with_corpus(" SELECT DISTINCT user_id, document_id FROM inter"))
def seen_documents(spark: SparkSession, sf: str) -> DataFrame:
    return personalize.seen_documents(corpus.interactions(spark, sf))


LAST_SEEN = with_corpus(" SELECT user_id, max(time_stamp) AS last_seen FROM inter GROUP BY user_id")


@query(LAST_SEEN)
def last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return personalize.last_seen(corpus.interactions(spark, sf))


TAGS = """, tw AS (SELECT user_id, tag, count(*) AS weight FROM (SELECT i.user_id, unnest(d.tags) AS tag FROM inter i JOIN doc d USING (document_id)) GROUP BY user_id, tag)"""


@query(with_corpus(TAGS + " SELECT * FROM tw"))
def tag_weights(spark: SparkSession, sf: str) -> DataFrame:
    return personalize.tag_weights(corpus.interactions(spark, sf), corpus.documents(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that each user has interacted with."""
    seen = personalize.seen_documents(corpus.interactions(spark, sf))
    return seen.join(corpus.snippets_of_documents(spark, sf).select("document_id", "sub_id", "embedding", "tags"), "document_id")


PAIRS = """, pairs AS (SELECT DISTINCT i.user_id, s.document_id, s.tags, s.e FROM inter i JOIN snip s USING (document_id)), tot AS (SELECT user_id, sum(weight) AS total FROM tw GROUP BY user_id),
tagged AS (SELECT p.user_id, document_id, (coalesce(a.weight, 0) + coalesce(b.weight, 0))::DOUBLE / total AS score FROM pairs p JOIN tot USING (user_id)
  LEFT JOIN tw a ON a.user_id = p.user_id AND a.tag = p.tags[1] LEFT JOIN tw b ON b.user_id = p.user_id AND b.tag = p.tags[2])"""


@query(with_corpus(TAGS + PAIRS + " SELECT user_id, document_id, round(score, 6) AS score FROM tagged"))
def tag_rerank_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = personalize.tag_scores(_pairs(spark, sf), tag_weights(spark, sf))
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"))


def fold_sql(threshold: float) -> str:
    return with_corpus(f"""
, ev AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY time_stamp, event_id) AS n, time_stamp AS t, e FROM inter JOIN snip USING (document_id)
), st AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(p DOUBLE[], c BIGINT, l TIMESTAMP)[] AS s FROM ev
  UNION ALL
  SELECT user_id, n, CASE WHEN b >= {threshold} THEN list_transform(s, lambda x, i: CASE WHEN i = k THEN
      {{'p': list_transform(list_transform(range(1, 65), lambda j: .9::DOUBLE * x.p[j] + .1::DOUBLE * e[j]), lambda y: y / w), 'c': x.c + 1, 'l': t}} ELSE x END)
    ELSE list_append(s, {{'p': e, 'c': 1::BIGINT, 'l': t}}) END
  FROM (SELECT *, sqrt(list_sum(list_transform(range(1, 65), lambda j: pow(.9::DOUBLE * s[k].p[j] + .1::DOUBLE * e[j], 2)))) AS w
    FROM (SELECT *, list_position(d, b) AS k FROM (SELECT *, list_max(d) AS b
      FROM (SELECT st.user_id, ev.n, st.s, ev.t, ev.e, list_transform(st.s, lambda x: greatest(least(list_dot_product(x.p, ev.e), 1), -1)) AS d FROM st JOIN ev ON ev.user_id = st.user_id AND ev.n = st.n + 1))))
)
SELECT user_id, step - 1 AS step, s.c AS view_count, s.l AS last_view, round(s.p[1], 6) AS p1, round(s.p[2], 6) AS p2, round(s.p[64], 6) AS p64
FROM (SELECT user_id, unnest(s) AS s, generate_subscripts(s, 1) AS step FROM (SELECT user_id, arg_max(s, n) AS s FROM st GROUP BY user_id))""")


def _fold_rows(interests: DataFrame) -> DataFrame:
    p = lambda i: F.round(F.element_at("point", i), 6).alias(f"p{i}")
    return interests.select("user_id", F.col("step").cast("long").alias("step"), "view_count", "last_view", p(1), p(2), p(64))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.interactions(spark, sf).join(corpus.snippets(spark, sf), ["document_id", "sub_id"])


@query(fold_sql(0.67))
def coi_fold(spark: SparkSession, sf: str) -> DataFrame:
    return _fold_rows(ci.fold_interactions(_events(spark, sf)))


@query(fold_sql(0.2))
def coi_fold_low_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _fold_rows(ci.fold_interactions(_events(spark, sf), InterestConfig(threshold=0.2)))


@query(fold_sql(0.67))
def coi_fold_expression(spark: SparkSession, sf: str) -> DataFrame:
    """The fold as one JVM-side expression over each user's ordered events."""
    e = _events(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("time_stamp").alias("t"), "event_id", F.col("embedding").cast("array<double>").alias("e")))).alias("events"))
    each = e.select("user_id", F.posexplode(ci.fold_column(F.col("events"))).alias("step", "c"))
    return _fold_rows(each.select("user_id", "step", F.col("c.n").alias("view_count"), F.col("c.last").alias("last_view"), F.col("c.point").alias("point")))


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """One centre for each document that a user has interacted with."""
    g = _events(spark, sf).groupBy("user_id", "document_id")
    c = g.agg(F.any_value("embedding").alias("e"), F.count(F.lit(1)).alias("view_count"), F.sum(F.floor(F.col("value") * 1000).cast("long")).alias("view_time_ms"), F.max("time_stamp").alias("last_view"))
    coi_id = F.concat_ws(":", "user_id", "document_id")
    return c.select("user_id", coi_id.alias("coi_id"), coi_id.alias("step"), F.col("e").cast("array<double>").alias("point"), "view_count", "view_time_ms", "last_view")


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    return ci.relevance(centres(spark, sf), now())


@query(with_corpus(" SELECT coi_id, round(decay, 6) AS decay FROM rel", CENTRES))
def coi_decay(spark: SparkSession, sf: str) -> DataFrame:
    return _relevant(spark, sf).select("coi_id", F.round("decay", 6).alias("decay"))


@query(with_corpus(" SELECT coi_id, round(relevance, 6) AS relevance FROM rel2", CENTRES))
def coi_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _relevant(spark, sf).select("coi_id", F.round("relevance", 6).alias("relevance"))


@query(with_corpus(" SELECT coi_id, round(weight, 6) AS weight FROM wts", CENTRES))
def coi_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ci.weights(_relevant(spark, sf)).select("coi_id", F.round("weight", 6).alias("weight"))


@query(with_corpus(" SELECT user_id, coi_id, pos, round(weight, 6) AS weight FROM best", CENTRES))
def coi_top(spark: SparkSession, sf: str) -> DataFrame:
    out = ci.top_interests(ci.weights(_relevant(spark, sf)))
    return out.select("user_id", "coi_id", F.col("pos").cast("long").alias("pos"), F.round("weight", 6).alias("weight"))


NEAREST = """, near AS (
  SELECT p.user_id, p.document_id, max(greatest(least(list_dot_product(c.point, p.e), 1), -1)) AS sim,
         arg_max({'d': decay, 'r': relevance}, list_dot_product(c.point, p.e)) AS c FROM pairs p JOIN rel2 c USING (user_id) GROUP BY p.user_id, p.document_id
), inte AS (SELECT user_id, document_id, (sim * c.d + c.r + 1) / 4 AS score FROM near)"""


@query(with_corpus(TAGS + PAIRS + NEAREST + " SELECT user_id, document_id, round(score, 6) AS score FROM inte", CENTRES))
def interest_score(spark: SparkSession, sf: str) -> DataFrame:
    out = ci.interest_scores(_pairs(spark, sf), _relevant(spark, sf))
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"))


def _rr(score: str, weight: str, table: str) -> str:
    return f"(SELECT user_id, document_id, {weight} / (60.0::DOUBLE + row_number() OVER (PARTITION BY user_id ORDER BY {score} DESC, document_id DESC)) AS r FROM {table})"


RERANK = f""" SELECT user_id, document_id, round(coalesce(i.r, 0) + coalesce(t.r, 0) + s.r, 6) AS score
FROM {_rr("score", "1.0::DOUBLE", "inte")} i JOIN {_rr("score", "1.0::DOUBLE", "tagged")} t USING (user_id, document_id)
JOIN {_rr("document_id::BIGINT", "0.5::DOUBLE", "pairs")} s USING (user_id, document_id)"""


@query(with_corpus(TAGS + PAIRS + NEAREST + RERANK, CENTRES))
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's documents, with a search score that falls with the id, reranked with the weights of a search."""
    pairs = _pairs(spark, sf)
    rows = pairs.select("user_id", "document_id", "sub_id", F.col("document_id").cast("double").alias("score"))
    tags = personalize.tag_scores(pairs, tag_weights(spark, sf))
    out = personalize.rerank(rows, ci.interest_scores(pairs, _relevant(spark, sf)), tags, (1.0, 1.0, 0.5))
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"))


MULTI = """, hits AS (
  SELECT * FROM (SELECT b.user_id, b.coi_id, s.document_id, b.weight, row_number() OVER (PARTITION BY b.coi_id ORDER BY (1 + greatest(least(list_dot_product(s.e, b.point), 1), -1)) / 2 DESC, s.document_id DESC) AS r
    FROM best b, snip s WHERE s.is_candidate AND NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = b.user_id AND i.document_id = s.document_id))
  WHERE r <= ceil(weight * 10)
), multi AS (SELECT user_id, document_id, sum(1 / (60.0::DOUBLE + r)) AS score FROM hits GROUP BY user_id, document_id)"""


@query(with_corpus(MULTI + " SELECT user_id, document_id, round(score, 6) AS score FROM multi", CENTRES))
def multi_coi_search(spark: SparkSession, sf: str) -> DataFrame:
    top = ci.top_interests(ci.weights(_relevant(spark, sf)))
    rows = corpus.snippets_of_documents(spark, sf).where("is_candidate")
    out = personalize.search_by_interests(rows, top, personalize.seen_documents(corpus.interactions(spark, sf)), 10, 100)
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"))


RECOMMEND = MULTI + TAGS + """, pairs AS (SELECT m.user_id, m.document_id, s.tags, s.e FROM multi m JOIN snip s USING (document_id)), tot AS (SELECT user_id, sum(weight) AS total FROM tw GROUP BY user_id),
tagged AS (SELECT p.user_id, document_id, (coalesce(a.weight, 0) + coalesce(b.weight, 0))::DOUBLE / total AS score FROM pairs p JOIN tot USING (user_id)
  LEFT JOIN tw a ON a.user_id = p.user_id AND a.tag = p.tags[1] LEFT JOIN tw b ON b.user_id = p.user_id AND b.tag = p.tags[2])""" + NEAREST + f"""
SELECT user_id, document_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, document_id DESC) AS rank FROM (
    SELECT user_id, document_id, i.r + t.r AS score FROM {_rr("score", "1.0::DOUBLE", "inte")} i JOIN {_rr("score", "1.0::DOUBLE", "tagged")} t USING (user_id, document_id))
) WHERE rank <= 10"""  # fmt: skip


@query(with_corpus(RECOMMEND, CENTRES))
def recommend_all(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations for all users in one plan: interests, budgeted search, fusion, exclusion, rerank, cut."""
    rows = corpus.snippets_of_documents(spark, sf).where("is_candidate")
    seen = personalize.seen_documents(corpus.interactions(spark, sf))
    out = personalize.recommend(rows, centres(spark, sf), tag_weights(spark, sf), seen, now(), 10, 100)
    return out.select("user_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions as inline histories; those of purchases without a time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    time = F.when(F.col("event_type") != "purchase", F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("string").alias("user_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.get_json_object("props", "$.k").alias("document_id"), F.lit(0).cast("long").alias("sub_id"), time.alias("time_stamp"))


HISTORY = """WITH h AS (
  SELECT user_id::VARCHAR AS user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, json_extract_string(props, '$.k') AS document_id, CASE WHEN event_type <> 'purchase' THEN ts END AS t FROM events
), filled AS (
  SELECT user_id, pos, document_id, coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), TIMESTAMP '2024-02-01') AS time_stamp FROM h
)"""


@query(HISTORY + " SELECT user_id, pos, time_stamp, coalesce(time_stamp > lead(time_stamp) OVER (PARTITION BY user_id ORDER BY pos), false) AS warned FROM filled")
def history_backfill(spark: SparkSession, sf: str) -> DataFrame:
    return personalize.backfill_history(_history(spark, sf), now()).select("user_id", "pos", "time_stamp", "warned")


@query(HISTORY + " SELECT user_id, pos, age <= 20 AS used FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS age FROM filled) WHERE age <= 200")
def history_trim(spark: SparkSession, sf: str) -> DataFrame:
    return personalize.trim_history(personalize.backfill_history(_history(spark, sf), now())).select("user_id", "pos", "used")


@query(HISTORY + " SELECT user_id, document_id, max(time_stamp) AS time_stamp FROM filled WHERE document_id IN (SELECT vec_id::VARCHAR FROM embeddings JOIN documents ON doc_id = vec_id) GROUP BY user_id, document_id")
def history_load(spark: SparkSession, sf: str) -> DataFrame:
    filled = personalize.backfill_history(_history(spark, sf), now())
    return personalize.load_history(filled, corpus.snippets(spark, sf)).select("user_id", "document_id", "time_stamp")


RELEVANCE = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"


@query(f"""WITH r AS (
  SELECT user_id, {RELEVANCE} AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, rank) AS ideal FROM r)
SELECT user_id, round(sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) / (sum(CASE WHEN ideal <= 5 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) ELSE 0 END) + 1e-5), 6) AS ndcg_at_5,
  round(sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) / (sum(CASE WHEN ideal <= 10 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) ELSE 0 END) + 1e-5), 6) AS ndcg_at_10
FROM i GROUP BY user_id""")  # fmt: skip
def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    r = e.select("user_id", F.expr(RELEVANCE).alias("relevance"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")).alias("rank"))
    out = evaluate.ndcg(r, (5, 10), "user_id")
    return out.select("user_id", F.round("ndcg_at_5", 6).alias("ndcg_at_5"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


@query(with_corpus(""" SELECT c.coi_id, c.view_time_ms + coalesce(sum(floor(i.value * 1000)::BIGINT), 0)::BIGINT AS view_time_ms
FROM coi c LEFT JOIN inter i ON i.user_id = c.user_id AND c.coi_id = i.user_id || ':' || i.document_id GROUP BY c.coi_id, c.view_time_ms""", CENTRES))
def view_times(spark: SparkSession, sf: str) -> DataFrame:
    """Every interaction's time goes to the nearest centre, which here is its own document's."""
    views = _events(spark, sf).select("user_id", "embedding", F.floor(F.col("value") * 1000).cast("long").alias("view_ms"))
    return ci.view_times(views, centres(spark, sf)).select("coi_id", "view_time_ms")


@query("""WITH c AS (
  SELECT user_id, event_id::VARCHAR AS document_id, (event_type = 'click')::INTEGER AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, rank) AS ideal FROM c)
SELECT user_id AS impression_id, round(sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) / (sum(CASE WHEN ideal <= 5 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) ELSE 0 END) + 1e-5), 6) AS ndcg_at_5
FROM i GROUP BY user_id""")
def click_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Click logs, one line of "document-label" items per user, against a ranking by value."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    item = F.concat_ws("-", F.col("event_id").cast("string"), (F.col("event_type") == "click").cast("int").cast("string"))
    log = e.groupBy(F.col("user_id").alias("impression_id")).agg(F.array_join(F.collect_list(item), " ").alias("log"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    ranked = e.select(F.col("user_id").alias("impression_id"), F.col("event_id").cast("string").alias("document_id"), rank.alias("rank"))
    out = evaluate.replay(ranked, evaluate.parse_clicks(log), (5,))
    return out.select("impression_id", F.round("ndcg_at_5", 6).alias("ndcg_at_5"))


def _happens(percent: int, seed: int) -> str:
    return f"('0x' || substr(md5(persona || ':' || doc_id || '#{seed}'), 1, 12))::BIGINT % 1000000 < {percent * 10_000}"


@query(f"""WITH p AS (
  SELECT * FROM (VALUES ('anglophone', 1), ('francophile', 2), ('generalist', 3)) v(persona, k)
), shown AS (
  SELECT persona, doc_id, n_chars, CASE k WHEN 1 THEN lang = 'en' OR source IN ('src1', 'src2') WHEN 2 THEN lang = 'fr' OR source = 'src3' ELSE lang IN ('de', 'es') OR source IN ('src4', 'src5') END AS fully,
    CASE k WHEN 1 THEN lang = 'en' OR source <> 'src1' OR source <> 'src2' WHEN 2 THEN lang = 'fr' OR source <> 'src3' ELSE lang IN ('de', 'es') OR source <> 'src4' OR source <> 'src5' END AS half
  FROM documents, p
), r AS (
  SELECT persona, CASE WHEN fully AND {_happens(20, 42)} THEN 2 WHEN half AND {_happens(5, 43)} THEN 1 ELSE 0 END AS rel,
    row_number() OVER (PARTITION BY persona ORDER BY n_chars DESC, doc_id) AS rank FROM shown
), i AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY rel DESC, rank) AS ideal FROM r)
SELECT persona, round(sum(CASE WHEN rank <= 3 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) / (sum(CASE WHEN ideal <= 3 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) ELSE 0 END) + 1e-5), 6) AS ndcg_at_3,
  round(sum(CASE WHEN rank <= 5 THEN (pow(2, rel) - 1) / log2(rank + 1.0) ELSE 0 END) / (sum(CASE WHEN ideal <= 5 THEN (pow(2, rel) - 1) / log2(ideal + 1.0) ELSE 0 END) + 1e-5), 6) AS ndcg_at_5
FROM i GROUP BY persona""")  # fmt: skip
def persona_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated personas: each clicks a fifth of the interesting documents it is shown; nDCG of showing by length."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    personas = F.explode(F.array(*[F.struct(F.lit(p).alias("persona"), F.array(*map(F.lit, likes)).alias("likes")) for p, likes in PERSONAS.items()]))
    shown = d.select("doc_id", "lang", "source", "n_chars", personas.alias("p")).select("doc_id", "lang", "source", "n_chars", "p.*")
    full, semi = match(F.col("lang"), F.col("source"), F.col("likes"))
    key = F.concat_ws(":", "persona", F.col("doc_id").cast("string"))
    clicked = F.when(full & evaluate.happens(0.2, key), 2).when(semi & evaluate.happens(0.05, key, 43), 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("persona").orderBy(F.col("n_chars").desc(), "doc_id"))
    out = evaluate.ndcg(shown.select("persona", clicked.alias("relevance"), rank.alias("rank")), (3, 5), "persona")
    return out.select("persona", F.round("ndcg_at_3", 6).alias("ndcg_at_3"), F.round("ndcg_at_5", 6).alias("ndcg_at_5"))


@query("SELECT doc_id, lang IN ('en', 'fr') OR source IN ('src1', 'src2') AS interesting, lang IN ('en', 'fr') OR source <> 'src1' OR source <> 'src2' AS semi_interesting FROM documents")
def interest_match(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = match(F.col("lang"), F.col("source"), F.array(F.lit("en/src1"), F.lit("fr/src2")))
    return d.select("doc_id", a.alias("interesting"), b.alias("semi_interesting"))


@query("""WITH e AS (SELECT user_id, source, count(*) AS n FROM events JOIN documents ON doc_id = json_extract_string(props, '$.k')::BIGINT GROUP BY user_id, source)
SELECT user_id::VARCHAR AS iteration, round(max(n) / sum(n), 6) AS saturation FROM e GROUP BY user_id""")
def saturation(spark: SparkSession, sf: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("iteration"), F.get_json_object("props", "$.k").alias("document_id"))
    categories = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("category"))
    return evaluate.saturation(seen, categories).select("iteration", F.round("saturation", 6).alias("saturation"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    e = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.where(F.col("event_type").isin("view", "click", "purchase")).select("event_id", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("document_id"), F.lit(0).cast("long").alias("sub_id"), F.col("ts").cast("timestamp").alias("time_stamp"))


def _drained(updates: DataFrame, name: str) -> DataFrame:
    """Everything that the stream emits until it has read all there is, with its batch number."""
    spark = updates.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    q = updates.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*updates.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


@query(fold_sql(0.67))
def stream_coi_state(spark: SparkSession, sf: str) -> DataFrame:
    """The interests that the stream leaves behind: the same as the batch fold's."""
    events = streams.deduplicated(_stream(spark, sf)).join(corpus.snippets(spark, sf), ["document_id", "sub_id"])
    return _fold_rows(streams.latest_state(_drained(streams.interest_updates(events), "stream-interests")))


@query(LAST_SEEN)
def stream_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return streams.latest_state(_drained(streams.last_seen_updates(_stream(spark, sf)), "stream-seen"))
