"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import decontaminate, divergence, language_id, line_dedup, lz_fingerprint, merkle, mixing, packing, pii, quality, simhash, substring_dedup, token_counts
from tarnwick.llm.common import documents

#: Stands for the secret that a deployment passes to pii.pseudonyms().
PII_KEY = "not-a-secret: set your own"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_and_edit(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(op8_token_counts(spark, sf_dir), length="n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonyms(documents(spark, sf_dir), PII_KEY)
    return out.select("doc_id", F.size("found").alias("n_replaced"), F.array_join("found", ",").alias("kinds"), F.col("safe_text").alias("text"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(merkle.tampered(documents(spark, sf_dir)), proofs=False)
    return out.withColumnRenamed("id", "doc_id")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_lz_fingerprint": op6_lz_fingerprint,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_pii": op10_pii,
    "op11_decontamination": op11_decontamination,
    "op12_merkle": op12_merkle,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST)) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END * 1.0::DOUBLE, 2.0::DOUBLE) AS e,
         least((('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT::DOUBLE + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE, 1.0::DOUBLE - 1.1102230246251565e-16::DOUBLE) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, floor(e)::BIGINT AS sure, e - floor(e) AS f,
         CASE WHEN e - floor(e) > 0 AND size > 0 THEN u * (1 - (e - floor(e))) / (u * (1 - (e - floor(e))) + (1 - u) * (e - floor(e))) END AS q
  FROM r
), n AS (
  SELECT source, first(target) - sum(sure * size) AS lacks FROM q GROUP BY source
), one AS (
  SELECT q.*, n.lacks, q.q IS NOT NULL AND sum(q.size) OVER (PARTITION BY q.source, q.q IS NULL ORDER BY q.q, q.doc_id) <= n.lacks AS won
  FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source
), m AS (
  SELECT *, lacks - coalesce(sum(size) FILTER (won) OVER (PARTITION BY source), 0) AS still FROM one
), two AS (
  SELECT *, q IS NOT NULL AND NOT won AND size <= still AS fits FROM m
), done AS (
  SELECT *, won OR (fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY q, doc_id) - size / 2.0 <= still) AS has FROM two
)
SELECT doc_id, size, source_size, target, (sure + has::BIGINT) * size AS taken FROM done
"""

ORACLE_SQL["op3_quality"] = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, range(0, 3) t(k) GROUP BY doc_id
), rows_ AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), lines AS (
  SELECT doc_id, host, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS norm
  FROM rows_ WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id
), content AS (
  SELECT doc_id, host, md5(string_agg(norm, chr(10) ORDER BY pos)) AS content FROM lines GROUP BY doc_id, host
), hosts AS (
  SELECT host, count(DISTINCT coalesce(content, '')) AS total FROM (SELECT DISTINCT doc_id, host FROM d) x LEFT JOIN content c USING (doc_id, host) GROUP BY host
), freq AS (
  SELECT l.host, norm, count(DISTINCT content) AS docs FROM lines l JOIN content USING (doc_id) GROUP BY l.host, norm
), often AS (
  SELECT f.host, norm FROM freq f JOIN hosts h ON f.host IS NOT DISTINCT FROM h.host WHERE docs > 10 AND docs > total * 0.05::DOUBLE
), lost AS (
  SELECT doc_id, sum(n)::BIGINT AS lost FROM lines l JOIN often o ON l.norm = o.norm AND l.host IS NOT DISTINCT FROM o.host GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS n_removed_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= n_words * 0.5 AS kept, n_removed_words FROM failed
"""

ORACLE_SQL["op5_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS rows_ FROM documents
), r AS (
  SELECT doc_id, unnest(rows_) AS line, generate_subscripts(rows_, 1) AS pos FROM d
), l AS (
  SELECT doc_id, pos, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS norm,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS s
  FROM r WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), n AS (
  SELECT *, len(string_split(norm, ' ')) AS n FROM l
), near AS (
  SELECT doc_id, s, norm, n, lead(norm) OVER o AS norm2, lead(n) OVER o AS n2, lead(norm, 2) OVER o AS norm3 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), win AS (
  SELECT doc_id, s, CASE WHEN n >= 50 THEN 1 WHEN n + n2 >= 50 THEN 2 ELSE 3 END AS size,
         CASE WHEN n >= 50 THEN norm WHEN n + n2 >= 50 THEN norm || chr(10) || norm2 ELSE norm || chr(10) || norm2 || chr(10) || norm3 END AS w
  FROM near
), later AS (
  SELECT doc_id, s, size FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM win WHERE w IS NOT NULL) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS s FROM later, range(0, 3) t(k) WHERE k < size
), lines AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines FROM l GROUP BY doc_id
), out AS (
  SELECT r.doc_id, count(g.s)::BIGINT AS n_removed, string_agg(CASE WHEN g.s IS NULL THEN line END, chr(10) ORDER BY r.pos) AS kept
  FROM r LEFT JOIN l USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.s = l.s GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN out USING (doc_id)
"""

ORACLE_SQL["op9_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM win), range(0, 50) t(j) WHERE doc_id > least
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), out AS (
  SELECT doc_id, count(g.i)::BIGINT AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY i) AS kept
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN out USING (doc_id)
"""

ORACLE_SQL["op11_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), tests AS (
  SELECT DISTINCT item_id, n, md5(array_to_string(w[i : i + n - 1], ' ')) AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), wins AS (
  SELECT doc_id, n, i, md5(array_to_string(w[i : i + n - 1], ' ')) AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM tests))
), met AS (
  SELECT doc_id, n, i, item_id FROM wins JOIN tests USING (n, k)
), hit AS (
  SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM met), range(0, 10) t(j) WHERE j < n GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op12_merkle"] = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
         list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                     lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384::BIGINT) ELSE xor(c, x) >> 1 END) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, lang, sha256(head || body) AS leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN sha256(head || low) ELSE sha256(head || body) END AS found,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx
  FROM field
), up AS (
  SELECT lang, 0 AS lvl, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaf
  UNION ALL
  SELECT lang, any_value(lvl) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lang, idx // 8
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, max(lvl) OVER () AS tall FROM up WHERE n = 1
), over AS (
  SELECT 0 AS lvl, idx, subroot AS h, n FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM over WHERE n > 1 GROUP BY idx // 8
), sides AS (
  SELECT a.lang, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM up a JOIN up b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lang, a.lvl, a.idx
), over_sides AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM over a JOIN over b ON a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.lvl, a.idx
), way AS (
  SELECT doc_id, s.lvl, l, r FROM leaf JOIN sides s ON leaf.lang IS NOT DISTINCT FROM s.lang AND s.idx = leaf.idx // (8 ** s.lvl)::BIGINT
  UNION ALL
  SELECT doc_id, tall + 1 + o.lvl, l, r FROM leaf JOIN subroots t ON leaf.lang IS NOT DISTINCT FROM t.lang JOIN over_sides o ON o.idx = t.idx // (8 ** o.lvl)::BIGINT
), proof AS (
  SELECT doc_id, string_agg(l || r, '' ORDER BY lvl) AS p, list(struct_pack(l := l, r := r) ORDER BY lvl) AS steps FROM way GROUP BY doc_id
), fold AS (
  SELECT doc_id, found AS h, 0 AS k, coalesce(steps, []) AS steps FROM leaf LEFT JOIN proof USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(steps[k + 1].l || h || steps[k + 1].r), k + 1, steps FROM fold WHERE k < len(steps)
)
SELECT leaf.doc_id, leaf.leaf, t.subroot, o.h AS root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM leaf JOIN subroots t ON leaf.lang IS NOT DISTINCT FROM t.lang JOIN (SELECT h FROM over WHERE n = 1) o ON true
LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, h FROM fold WHERE k = len(steps)) f ON f.doc_id = leaf.doc_id
"""

ORACLE_SQL["op13_divergence"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT doc_id, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS words FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, coalesce(sum(n), 0) AS words FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.words + l.v) AS p,
         1 + 1000000000::HUGEINT * (kept.n + 1) // (l.words + l.v) AS q
  FROM s JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
), pair AS (
  SELECT pairs.lang, pairs.source, item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM pairs LEFT JOIN p a ON a.lang = pairs.lang AND a.source = pairs.source LEFT JOIN p b ON b.lang = pairs.lang AND b.source = item AND b.term = a.term
  GROUP BY pairs.lang, pairs.source, item
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "C") AS rank FROM pair
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item COLLATE "C") AS rank FROM term) WHERE rank <= 200
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
"""
