"""Source divergence audit: which sources of a language differ most, and by which terms; counted by DuckDB in shards of terms."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import table

#: Documents that must have a term, and terms that are told of each group.
LEAST_DOCS, MOST_TERMS = 3, 200
#: The whole of a distribution.
WHOLE = 1_000_000_000
#: Bytes of text that DuckDB counts at once, and rows of counts that a task gathers before it passes them on.
CHUNK_BYTES, GATHERED = 1 << 23, 1 << 19
#: A byte of a term is a letter of A-Z (in lower case then), a-z, or part of a character beyond ASCII; all others divide.
LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
PARTS = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("p", pa.int64()), ("value", pa.decimal128(38, 0))])


def _shard() -> duckdb.DuckDBPyConnection:
    """An in-memory database for one shard: one thread, and nothing on the executor's disks."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.decimal128(38, 0): "decimal(38,0)"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _count(db: duckdb.DuckDBPyConnection, langs: list[str], sources: list[str], texts: list[bytes]) -> pa.Table:
    """COUNTS of some documents: how often each term stands in a group and in how many of the documents."""
    split = pc.ascii_split_whitespace(pa.array([t.translate(LETTERS) for t in texts], pa.binary()).cast(pa.large_string()))
    terms = pa.table({"doc": pc.list_parent_indices(split), "term": split.flatten()})
    docs = pa.table({"doc": np.arange(len(texts)), "lang": langs, "source": sources})
    db.register("terms", terms)
    db.register("docs", docs)
    return db.sql("""
        WITH in_doc AS (SELECT doc, term, count(*) AS n FROM terms WHERE term <> '' GROUP BY doc, term)
        SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs FROM in_doc JOIN docs USING (doc) GROUP BY lang, source, term
    """).to_arrow_table().cast(COUNTS)


def _merged(db: duckdb.DuckDBPyConnection, parts: list[pa.Table]) -> pa.Table:
    db.register("parts", pa.concat_tables(parts))
    return db.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM parts GROUP BY lang, source, term").to_arrow_table().cast(COUNTS)


def _term_counts(batches: Iterator[pa.RecordBatch], chunk_bytes: int, gathered: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> COUNTS, each key once for a task unless it has more than ``gathered`` of them."""
    db, parts, held = _shard(), [], 0
    for batch in batches:
        lang, source, text = (batch.column(i).to_pylist() for i in range(3))
        first, size = 0, 0
        for i, t in enumerate(text):
            size += len(t)
            if size >= chunk_bytes or i == len(text) - 1:
                parts.append(_count(db, lang[first : i + 1], source[first : i + 1], text[first : i + 1]))
                held += parts[-1].num_rows
                first, size = i + 1, 0
                if held > 2 * gathered:
                    parts = [_merged(db, parts)]
                    held = parts[0].num_rows
                    if held > gathered:
                        yield from parts.pop().to_batches(1 << 14)
                        held = 0
    if parts:
        yield from _merged(db, parts).to_batches(1 << 14)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of a shard, which has all rows of its terms -> what the kept terms count in each group (n), in the language
    (total), and a one at one row of each term. The rows stream into the aggregation."""
    db = _shard()
    db.register("parts", pa.RecordBatchReader.from_batches(COUNTS, (b.cast(COUNTS) for b in batches)))
    out = db.sql(f"""
        WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM parts GROUP BY lang, source, term)
        SELECT lang, source, term, n, (sum(n) OVER w)::BIGINT AS total, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS one
        FROM c WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {LEAST_DOCS}
    """).to_arrow_table()
    yield from out.cast(pa.schema([*COUNTS][:4] + [("total", pa.int64()), ("one", pa.int64())])).to_batches(1 << 14)


SCORED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("p", pa.int64()), ("none", pa.int64()), ("q", pa.int64())])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SCORED of a shard -> its part of the sums of all pairs, of the histograms, and its best terms of each group."""
    db = _shard()
    rows = [pa.table({f.name: b.column(f.name) for f in SCORED}).cast(SCORED) for b in batches]
    if not rows:
        return
    db.register("rows_", pa.concat_tables(rows))
    db.sql("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // q")
    # Terms that both sources have, less what the histograms will say of them; a source lacks most terms of the others.
    yield from db.sql("""
        SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS p, sum((f(a.p, b.p) - f(a.p, b.none))::HUGEINT - f(a.none, b.p) + f(a.none, b.none))::DECIMAL(38, 0) AS value
        FROM rows_ a JOIN rows_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
    """).to_arrow_table().cast(PARTS).to_batches(1 << 14)
    yield from db.sql("SELECT 'p' AS kind, lang, source, '' AS item, p, count(*)::DECIMAL(38, 0) AS value FROM rows_ GROUP BY lang, source, p").to_arrow_table().cast(PARTS).to_batches(1 << 14)
    yield from db.sql(f"""
        SELECT 'term' AS kind, lang, source, term AS item, 0::BIGINT AS p, f(p, q)::DECIMAL(38, 0) AS value FROM rows_ WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {MOST_TERMS}
    """).to_arrow_table().cast(PARTS).to_batches(1 << 14)


def _share(n: str, all_: str) -> Column:
    """1 + floor(WHOLE * (n + 1) / all_), exactly; all_ is 0 only where no term is kept, and no share is used."""
    return F.expr(f"cast(1 + (cast({WHOLE} as decimal(18,0)) * cast({n} + 1 as decimal(19,0))) div greatest({all_}, 1L) as long)")


def _far(p: str, q: str, times: str) -> Column:
    """floor((p - q) ** 2 / q) so many times."""
    return F.expr(f"cast((({p} - {q}) * ({p} - {q})) div {q} as decimal(20,0)) * cast({times} as decimal(18,0))").cast("decimal(38,0)")


def _ranked(rows: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(by))


def audit(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, gathered: int = GATHERED) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group (lang, source) lies from each other source of its language
    (part ``pair``, all of them) and which terms it has more of than the language (part ``term``, the first 200).

    docs: lang, source, text; other columns are ignored. Null is the empty string in all three. A term is a run of letters
    (A-Z in lower case) and of characters beyond ASCII; a language keeps the terms that three of its documents have. A document is a
    row, so repeated rows count each. Ties go to the item that comes first in UTF-8. A group without terms has its pairs; a
    language without kept terms has pairs of value 0; an empty table gives an empty result. All numbers are whole.

    Tasks count their own documents in DuckDB, each text by itself and chunks of ``chunk_bytes`` at once. The counts are dealt to
    shards by language and term, whose number and size Spark chooses (``spark.sql.shuffle.partitions``, adaptive), so a
    language with most rows is spread like any other, and a frequent term has one row for each task and source. In a shard DuckDB
    merges the counts, drops rare terms, and later adds up f over pairs of sources that share a term: the only pairs
    that are formed. For what one source has and the other lacks, the histogram of p decides, since the other's p is
    then one constant; Spark adds the histograms up and meets them with the groups of the language. Only sums for each pair
    leave a shard. A row for each pair of sources of a language is the result itself; sources are thus assumed to be
    few enough for that.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    slim = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    counts = slim.mapInArrow(lambda batches: _term_counts(batches, chunk_bytes, gathered), _ddl(COUNTS)).repartition("lang", "term")
    kept = table(counts.mapInArrow(_kept, "lang string, source string, term string, n long, total long, one long"), "kept-terms")

    groups = slim.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("one").alias("v"), F.sum("n").alias("lang_words"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["words", "terms", "v", "lang_words"])
    groups = table(groups.withColumn("none", _share("0L", "words + v")), "term-groups")

    scored = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "words + v").alias("p"), "none", _share("total", "lang_words + v").alias("q"))
    parts = table(scored.repartition("lang", "term").mapInArrow(_sums, _ddl(PARTS)), "term-sums")

    side = lambda n: groups.select("lang", *[F.col(c).alias(f"{c}{n}") for c in ("source", "none", "terms", "v")])
    pairs = side("").join(side("2"), "lang").where("source <> source2")
    rest = pairs.select("lang", "source", F.col("source2").alias("item"), F.when(F.col("v") > 0, _far("none", "none2", "v - terms - terms2")).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))
    seen = parts.where("kind = 'p'").groupBy("lang", "source", "p").agg(F.sum("value").cast("long").alias("n"))
    seen = seen.join(side("2"), "lang").where("source <> source2")
    ways = F.array(F.struct(F.col("source"), F.col("source2").alias("item"), _far("p", "none2", "n").alias("value")), F.struct(F.col("source2").alias("source"), F.col("source").alias("item"), _far("none2", "p", "n").alias("value")))
    seen = seen.select("lang", F.explode(ways).alias("x")).select("lang", "x.source", "x.item", "x.value")
    both = parts.where("kind = 'pair'").select("lang", "source", "item", "value")
    pairs = both.unionByName(rest).unionByName(seen).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    terms = parts.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    dealt = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= MOST_TERMS).drop("rank")
    terms = _ranked(terms).where(F.col("rank") <= MOST_TERMS)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return _ranked(pairs).withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
