"""Queries of summaries, splits, snippets and page texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import ingest, sentences, summarize, word_vectors
from tarnwick.operators.split import Splitter, split_text
from tarnwick.operators.subwords import Subwords
from tarnwick.session import table
from tarnwick.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")


@query("""WITH s AS (
  SELECT doc_id, unnest(string_split(text, '.')) AS raw, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents
), k AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS kept FROM (SELECT doc_id, i, trim(raw, ' ') AS sentence, strlen(trim(raw, ' ')) AS size FROM s) WHERE size > 50 AND size < 1500
), w AS (
  SELECT doc_id, i, size, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda x: x <> '')) AS words FROM k WHERE i < kept
)
SELECT a.doc_id::VARCHAR AS document_id, a.i, coalesce(sum(pow(len(list_intersect(a.words, b.words)), 3)), 0)::BIGINT AS shared, a.size
FROM w a LEFT JOIN w b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY a.doc_id, a.i, a.size""".replace("\\\\", "\\"))  # fmt: skip
def sentence_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return summarize.sentence_overlap(_docs(spark, sf))


@query("""WITH s AS (
  SELECT doc_id, unnest(string_split(text, '.')) AS raw, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents
), t AS (
  SELECT doc_id, i, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM s
), k AS (
  SELECT *, strlen(sentence) AS size, count(*) OVER (PARTITION BY doc_id) AS kept FROM t WHERE strlen(sentence) > 50 AND strlen(sentence) < 1500
), w AS (
  SELECT doc_id, i, sentence, size, list_distinct(list_filter(regexp_split_to_array(lower(sentence), '\\s+'), lambda x: x <> '')) AS words FROM k WHERE i < kept
), sc AS (
  SELECT a.doc_id, a.i, a.sentence, sum(pow(len(list_intersect(a.words, b.words)), 3)) / pow(a.size, 5) * 1e10 AS score
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.i < b.i GROUP BY a.doc_id, a.i, a.sentence, a.size
), best AS (
  SELECT doc_id, string_agg(sentence, '.' || chr(10) ORDER BY i) AS summary
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM sc WHERE score > 0) WHERE n <= 4 GROUP BY doc_id
)
SELECT d.doc_id::VARCHAR AS document_id, coalesce(summary, text, '') AS summary FROM documents d LEFT JOIN best USING (doc_id)""")  # fmt: skip
def summarize_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", summarize.summarized(F.col("text")).alias("summary"))


@query()
def summarize_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", summarize.summarized_by_rank(F.col("text")).alias("summary"))


@query()
def split_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("document_id", F.posexplode(split_text(F.col("text"))).alias("sub_id", "snippet"))


@query("SELECT conv_id::VARCHAR AS document_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def snippets_regroup(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets back to documents, in the order of sub_id: here the turns of conversations."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("conv_id").cast("string").alias("document_id"), F.array_join("t.text", "\n").alias("text"), "n")


TAGS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->|<[^>]*>"


@query(f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '{TAGS}', ' ', 'g'),
  '&nbsp;', ' '), '&#39;', ''''), '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g'), ' ') AS text FROM pages""")  # fmt: skip
def pages_text(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", readers.html_text(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def last_row_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Last-write-wins over any key."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return ingest.last_wins(c, "conv_id", "turn").select("conv_id", "turn", "role")


@query("""WITH t AS (
  SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS token FROM documents
), k AS (
  SELECT token, rtrim(token, '"'')]}»”’“›‹') AS bare FROM t
), c AS (
  SELECT lower(rtrim(rtrim(ltrim(token, '"''([{«„“‘»›‹'), '"'')]}»”’“›‹'), '.,;:!?…')) AS core, bare LIKE '%.' AND NOT bare LIKE '%..' AS period FROM k
), y AS (
  SELECT CASE WHEN regexp_full_match(core, '[-+]?[0-9]+([.,:/-][0-9]+)*') THEN '#' ELSE core END AS type, period FROM c
), n AS (
  SELECT type, count(*) FILTER (period) AS with_, count(*) FILTER (NOT period) AS without FROM y GROUP BY type
), s AS (
  SELECT count(*) AS all_, count(*) FILTER (period) AS periods FROM y
), r AS (
  SELECT type, with_, without, length(replace(type, '.', '')) AS letters, periods::DOUBLE / all_ AS p FROM n, s WHERE with_ > 0 AND regexp_matches(type, '\\p{L}')
)
SELECT type, with_, without,
       round(2 * (with_ * ln(.99::DOUBLE) + without * ln(.01::DOUBLE) - with_ * ln(p) - CASE WHEN without > 0 THEN without * ln(1 - p) ELSE 0 END)
             * exp(-letters::DOUBLE) * (length(type) - letters + 1) * pow(letters::DOUBLE, -without::DOUBLE), 6) AS score FROM r""".replace("\\\\", "\\"))  # fmt: skip
def abbreviation_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How likely each word that ends in a period is an abbreviation, by likelihood ratio."""
    counts = sentences.type_counts(table(sentences.token_types(_docs(spark, sf)), "token-types"))
    return sentences.abbreviations(counts).select("type", "with_", "without", F.round("score", 6).alias("score"))


@query()
def split_snippets_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of at most 500 tokens of a vocabulary, and never more than 520, by sentences of a model trained on the corpus."""
    import public_tokenizers

    docs = _docs(spark, sf)
    splitter = Splitter(length=Subwords.from_file(public_tokenizers.path("word_bpe_49k.json")).length, sentences=sentences.train(docs).split)
    return docs.select("document_id", F.posexplode(split_text(F.col("text"), splitter)).alias("sub_id", "snippet"))


WORDS_SQL = """WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents
), v AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS i FROM (SELECT unnest(t) AS word, count(*) AS n FROM t GROUP BY word) WHERE n >= 5 QUALIFY i < 2000
), p AS (
  SELECT t[k] AS a, t[k + o] AS b FROM (SELECT t, unnest(range(1, len(t) + 1)) AS k FROM t), range(1, 5) r(o) WHERE k + o <= len(t)
), w AS (
  SELECT x.i AS i, y.i AS j FROM p JOIN v x ON x.word = a JOIN v y ON y.word = b
), c AS (
  SELECT i, j, count(*) AS n FROM (SELECT i, j FROM w UNION ALL SELECT j, i FROM w) GROUP BY i, j
), r AS (
  SELECT i, sum(n) AS n FROM c GROUP BY i
)
SELECT x.word AS word, y.word AS context, c.n::BIGINT AS n, round(ln(c.n * (SELECT sum(n) FROM c)::DOUBLE / (a.n::DOUBLE * b.n)), 6) AS information
FROM c JOIN r a ON a.i = c.i JOIN r b ON b.i = c.j JOIN v x ON x.i = c.i JOIN v y ON y.i = c.j WHERE ln(c.n * (SELECT sum(n) FROM c)::DOUBLE / (a.n::DOUBLE * b.n)) > 0""".replace("\\\\", "\\")


@query(WORDS_SQL)
def word_information(spark: SparkSession, sf: str) -> DataFrame:
    """How much more often than by chance the 2,000 most frequent words of the corpus meet, which word vectors are learnt from."""
    docs = _docs(spark, sf)
    words = table(word_vectors.vocabulary(docs, most=2000), "vocabulary")
    pairs = table(word_vectors.co_occurrences(docs, words), "co-occurrences")
    name = lambda i, to: words.select(F.col("i").alias(i), F.col("word").alias(to))
    out = word_vectors.information(pairs).join(pairs, ["i", "j"]).join(name("i", "word"), "i").join(name("j", "context"), "j")
    return out.select("word", "context", "n", F.round("v", 6).alias("information"))
