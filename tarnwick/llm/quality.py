"""Quality rules: per-document base figures, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import BLANKS, WORD, packed, table, unpacked

SYMBOLS = "#*$%&|<>"
#: From so many different repeated 3-word windows on, positions are found by sorting instead of by lookup.
FEW = 16


def _repeat_words(n: Column, h: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; n: words, h: the windows' hashes in order."""

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(positions, start, step, lambda a: a["n"])

    def by_lookup(d: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains(d, F.get(h, i)))

    def by_sorting() -> Column:
        def same(t: Column) -> Column:
            def again(x: Column, j: Column) -> Column:
                return (x["h"] == F.get(t, j - 1)["h"]) | (x["h"] == F.get(t, j + 1)["h"])

            return F.sort_array(F.transform(F.filter(t, again), lambda x: x["i"]))

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.element_at(F.transform(F.array(F.sort_array(pairs)), same), 1)

    d = F.col("again")
    positions = F.when(F.size(d) <= FEW, by_lookup(d)).otherwise(by_sorting())
    return F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(covered(positions))


def line_frame(docs: DataFrame) -> DataFrame:
    """One row per document: rid (unique), doc_id, host, tie, the base figures, ``lines``: key and words of each line with
    a word, and ``content``: a hash of all keys in order.

    Lines are normalised before they are hashed: lower case, digits as 0, blanks as one space. The key holds the host
    too, so that equal lines of two hosts have different keys.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), F.split(text, "\n").alias("rows"))
    has_word = lambda c: F.btrim(c, F.lit(BLANKS)) != ""
    base = base.withColumn("n", F.size("w")).withColumn("rows", F.filter("rows", has_word))
    w = F.col("w")
    base = base.withColumn("h", F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("sorted", F.sort_array("h"))
    s = F.col("sorted")
    base = base.withColumn("again", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    norm = F.regexp_replace(F.regexp_replace(F.lower("text"), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    keyed = F.transform(F.filter(F.split(norm, "\n"), has_word), lambda c: F.struct(F.xxhash64("host", F.btrim(c, F.lit(" "))).alias("k"), F.regexp_count(c, F.lit(WORD)).alias("n")))
    return base.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "host",
        F.xxhash64("text").alias("tie"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("rows") - F.size(F.array_distinct("rows"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("n"), F.col("h")).alias("n_repeat_words"),
        keyed.alias("lines"),
    )


def frequent_lines(lines: DataFrame, min_docs: int = 10, rate: float = 0.05) -> DataFrame:
    """(k) of the lines that more than max(min_docs, rate * the host's documents) distinct documents of a host share.

    Documents with equal sequences of normalised lines are one document, in both counts: exact copies of a text make
    no line boilerplate. Hot hosts and large groups of copies are combined before each shuffle; a key is a 64-bit hash.
    """
    keys = F.transform("lines", lambda x: x["k"])
    host = F.xxhash64("host").alias("host")
    one = lines.select(host, F.xxhash64(keys).alias("content"), F.array_distinct(keys).alias("keys")).groupBy("host", "content").agg(F.first("keys").alias("keys"))
    hosts = one.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    counts = one.select("host", F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("docs"), F.min("host").alias("host"))
    out = counts.where(F.col("docs") > min_docs).join(hosts, "host")
    return out.where(F.col("docs") > F.col("all") * F.lit(rate)).select("k")


def quality(docs: DataFrame, min_words: int = 50, min_docs: int = 10, rate: float = 0.05, min_left: float = 0.5, spread: int = 16) -> DataFrame:
    """Base figures and verdict of every document.

    base_failed: fewer than min_words words, or more than half of them in repeated 3-word windows. kept: not
    base_failed, and at least min_left of the words are left once the host's frequent lines are removed.

    docs: doc_id, text, source (the host); other columns are ignored, whatever their names. Null text counts as empty,
    null source is a host of its own, null ids are ids; repeated rows give repeated results; an empty table gives an
    empty result. A frequent line is hot by nature: its rows are dealt over ``spread`` tasks.
    """
    lines = table(line_frame(docs), "quality-lines")
    often = table(frequent_lines(lines, min_docs, rate), "quality-frequent")
    flat = lines.select("rid", F.explode("lines").alias("x")).select("rid", F.col("x.k").alias("k"), F.col("x.n").alias("n"), F.pmod(F.xxhash64("rid"), F.lit(spread)).cast("int").alias("part"))
    dealt = often.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    hit = flat.join(dealt, ["k", "part"]).groupBy("rid").agg(F.sum("n").alias("lost"))
    return _verdict(lines.drop("lines"), hit, min_words, min_left)


def _verdict(rows: DataFrame, hit: DataFrame, min_words: int, min_left: float) -> DataFrame:
    out = rows.join(hit, "rid", "left").withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * F.lit(min_left)
    return out.select("doc_id", "host", "tie", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words")


def quality_stage(docs: DataFrame, **options) -> DataFrame:
    """docs without those that quality() rejects; columns and texts unchanged, whatever further columns are named.

    Null texts and texts without words are rejected (too few words); rows of one doc_id are judged each by its own
    text; repeated rows stay or go together; an empty table stays empty.
    """
    bad = quality(docs, **options).where("not kept").select(F.xxhash64("doc_id", "tie", "host").alias("row_key")).distinct()
    keyed = packed(docs, row_key=F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "source"))
    return unpacked(keyed.join(bad, "row_key", "left_anti"), docs)
