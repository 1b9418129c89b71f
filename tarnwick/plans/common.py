"""SQL shared by the oracle queries."""

#: The corpus relations (sources/corpus.py) for DuckDB.
CORPUS = """
doc AS (
  SELECT d.doc_id::VARCHAR AS document_id, [lang, source] AS tags, d.doc_id % 10 <> 0 AS is_candidate, lang, n_chars::DOUBLE AS n_chars,
         [lang, source] AS topics, quality = 1 AS quality, TIMESTAMP '2024-01-01' + to_hours(d.doc_id::INTEGER) AS publication_date, text
  FROM documents d LEFT JOIN labels USING (doc_id)
), snip AS (
  SELECT doc.*, embedding::DOUBLE[] AS e FROM doc JOIN embeddings ON vec_id::VARCHAR = document_id
), inter AS (
  SELECT event_id, user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS document_id, ts AS time_stamp, value
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
)"""

#: One centre of interest for each document that a user has interacted with, so that SQL can express what follows.
CENTRES = """
coi AS (
  SELECT i.user_id, i.user_id || ':' || i.document_id AS coi_id, any_value(s.e) AS point, count(*) AS view_count,
         sum(floor(i.value * 1000)::BIGINT)::BIGINT AS view_time_ms, max(time_stamp) AS last_view
  FROM inter i JOIN snip s USING (document_id) GROUP BY i.user_id, i.document_id
), rel AS (
  SELECT *, CASE WHEN last_view > TIMESTAMP '2024-02-01' THEN 1.0 ELSE greatest((exp(-0.1 * 30) - exp(-0.1 * age)) / (exp(-0.1 * 30) - 1), 0.0) END AS decay
  FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_view)) / 86400000000.0::DOUBLE AS age FROM coi)
), rel2 AS (
  SELECT *, (view_count / greatest(sum(view_count) OVER u, 1) + view_time_ms / greatest(sum(view_time_ms) OVER u, 1)) * decay AS relevance
  FROM rel WINDOW u AS (PARTITION BY user_id)
), wts AS (
  SELECT *, CASE WHEN sum(raw) OVER u > 0 THEN raw / sum(raw) OVER u ELSE 1.0 / count(*) OVER u END AS weight
  FROM (SELECT *, 1 - exp(-3 * relevance) AS raw FROM rel2) WINDOW u AS (PARTITION BY user_id)
), best AS (
  SELECT * EXCLUDE (weight), weight / sum(weight) OVER (PARTITION BY user_id) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, coi_id DESC) AS pos FROM wts) WHERE pos <= 10
)"""


def with_corpus(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join((CORPUS, *more)) + body
