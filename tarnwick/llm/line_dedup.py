"""Repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import let, packed, same_row, table, unpacked


def _lines(text: Column) -> Column:
    """k: hash, n: words, i: position of each line with a word; in lower case with blanks as one space."""
    norm = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")

    def line(c: Column, i: Column) -> Column:
        words = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
        return F.struct(F.xxhash64(c).alias("k"), F.when(c == "", 0).otherwise(words).alias("n"), i.alias("i"))

    return F.filter(F.transform(F.transform(F.split(norm, "\n"), lambda c: F.trim(c)), line), lambda x: x["n"] > 0)


def minima(slim: DataFrame, run: int, min_words: int) -> DataFrame:
    """The places that winnowing selects in slim's ``lines``, one row each: doc_id, tie, place p, its gram's hash g, the
    lines around it (c0, c1, ...: line hashes from p - (run - 2) to p + run - 1, null beyond the ends), and the windows
    that selected it (w0, w1, ...: size of the window that begins at p - (run - 2), ...; 0: did not select p).

    A window is the shortest stretch of lines from its first line on that has ``run`` lines or ``min_words`` words. It
    selects the pair of lines with the least hash in it, the rightmost of equals; a window of one line selects that.
    """
    x, back = F.col("lines"), run - 2

    def window(s: Column) -> Column:
        n = F.lit(0)
        size, whole = None, F.when(s + run <= F.size(x), run).otherwise(0)
        for j in range(run - 1):
            n = n + F.get(x, s + j)["n"]
            size = F.when(n >= min_words, j + 1) if size is None else size.when(n >= min_words, j + 1)
        pairs = [F.get(F.col("pairs"), s + j) for j in range(run - 1)]
        return F.struct(size.otherwise(whole).alias("size"), F.array(*pairs).alias("pairs"))

    def chosen(w: Column, s: Column) -> Column:
        inside = F.slice(w["pairs"], 1, F.greatest(w["size"] - 1, F.lit(0)))
        least = F.array_min(inside)
        at = w["size"] - 1 - F.array_position(F.reverse(inside), least).cast("int")
        return F.struct(w["size"].alias("size"), F.when(w["size"] == 1, s).otherwise(s + at).alias("p"), F.when(w["size"] == 1, F.xxhash64(F.get(x, s)["k"])).otherwise(least).alias("g"))

    def place(p: Column) -> Column:
        wins = [F.get(F.col("chosen"), p - back + j) for j in range(back + 1)]
        mine = [F.when(w["p"] == p, w["size"]).otherwise(0) for w in wins]
        around = [F.when(p - back + j >= 0, F.get(x, p - back + j)["k"]).alias(f"c{j}") for j in range(2 * run - 2)]
        g = F.coalesce(*[F.when(w["p"] == p, w["g"]) for w in wins])
        return F.struct(p.alias("p"), g.alias("g"), *around, *[m.alias(f"w{j}") for j, m in enumerate(mine)])

    out = slim.where(F.size("lines") > 0).withColumn("pairs", F.transform(x, lambda a, i: F.xxhash64(a["k"], F.get(x, i + 1)["k"])))
    every = F.sequence(F.lit(0), F.size(x) - 1)
    out = out.withColumn("windows", F.transform(every, window)).withColumn("chosen", F.transform("windows", chosen))
    out = out.select("doc_id", "tie", F.explode(F.filter(F.transform(every, place), lambda q: q["g"].isNotNull())).alias("q"))
    return out.select("doc_id", "tie", "q.*")


def _extend(rows: DataFrame, first: DataFrame, run: int) -> DataFrame:
    """rows joined with the first place of their gram and matched line by line to both sides: v0, v1, ... are the sizes
    of the windows that the match covers, w0, w1, ... those of the windows that it leaves open. A first place matches nothing."""
    back = run - 2
    out = rows.join(first, "g")
    here = F.struct("doc_id", "tie", "p")
    itself = here == F.col("first")
    holds = [F.coalesce(F.col(f"c{j}") == F.col(f"f{j}"), F.lit(False)) for j in range(2 * run - 2)]
    # reach[j]: how far to the right, from line j on, the match holds
    reach = [F.lit(0)] * (2 * run - 1)
    for j in reversed(range(2 * run - 2)):
        reach[j] = F.when(holds[j], reach[j + 1] + 1).otherwise(0)
    covered = [~itself & (F.col(f"w{j}") > 0) & (reach[j] >= F.col(f"w{j}")) for j in range(back + 1)]
    done = [F.when(c, F.col(f"w{j}")).otherwise(0).alias(f"v{j}") for j, c in enumerate(covered)]
    left = [F.when(c | itself, 0).otherwise(F.col(f"w{j}")).alias(f"w{j}") for j, c in enumerate(covered)]
    return out.select("doc_id", "tie", "p", *[f"c{j}" for j in range(2 * run - 2)], *done, *left)


def repeated_runs(slim: DataFrame, run: int, min_words: int) -> DataFrame:
    """(doc_id, tie, s, size): all windows that occur before, in an earlier document (by doc_id, null first, then by tie) or
    further up in the same one; s counts lines with a word.

    Equal windows select the same gram at the same place, so a repeated window's places share a gram. Places of a gram
    that is selected once go no further. The others are joined with the first place of their gram, and the match is
    extended to both sides. Windows that it does not reach are open: their repeats, if any, are open too, as they differ
    from the first place alike. Open places are joined anew, with the first place that has all lines of the window.
    No gram's places are paired with each other.
    """
    back = run - 2
    rows = table(minima(slim, run, min_words), "line-minima")
    around = [f"c{j}" for j in range(2 * run - 2)]
    least = F.min(F.struct("doc_id", "tie", "p", *around)).alias("first")
    first = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), least).where("n > 1")
    first = first.select("g", F.struct("first.doc_id", "first.tie", "first.p").alias("first"), *[F.col(f"first.c{j}").alias(f"f{j}") for j in range(2 * run - 2)])
    met = table(_extend(rows, table(first, "line-first"), run), "line-matches")
    spans = lambda v: F.filter(F.array(*[F.struct((F.col("p") - back + j).alias("s"), F.col(f"{v}{j}").alias("size"), F.lit(j).alias("j")) for j in range(back + 1)]), lambda x: x["size"] > 0)
    closed = met.select("doc_id", "tie", F.explode(spans("v")).alias("x")).select("doc_id", "tie", "x.s", "x.size")
    open_ = met.select("doc_id", "tie", *around, F.explode(spans("w")).alias("x"))
    keys = [reduce(lambda otherwise, j, t=t: F.when(F.col("x.j") == j, F.col(f"c{j + t}")).otherwise(otherwise), range(back + 1), F.lit(None).cast("bigint")) for t in range(run)]
    open_ = open_.select("doc_id", "tie", "x.s", "x.size", *[F.when(F.col("x.size") > t, k).alias(f"k{t}") for t, k in enumerate(keys)])
    on = [F.coalesce(f"k{t}", F.lit(0)).alias(f"k{t}") for t in range(run)]
    open_ = table(open_.select("doc_id", "tie", "s", "size", *on), "line-open")
    names = ["size", *[f"k{t}" for t in range(run)]]
    begins = open_.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tie", "s")).alias("first")).where("n > 1").drop("n")
    later = open_.join(table(begins, "line-begins"), names).where(F.struct("doc_id", "tie", "s") > F.col("first"))
    return closed.unionByName(later.select("doc_id", "tie", "s", "size"))


def line_cuts(docs: DataFrame, run: int = 3, min_words: int = 50) -> DataFrame:
    """(doc_id, tie, n_lines, gone), one row for each different pair of doc_id and text; gone: the positions, among all
    lines of the text, of those that later repeated runs cover."""
    slim = docs.select("doc_id", F.xxhash64("text").alias("tie"), _lines(F.col("text")).alias("lines"))
    slim = table(slim, "line-keys")  # else the planner repeats the keys' expressions inside the windows'
    runs = repeated_runs(slim, run, min_words).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("s", "size")).alias("runs"))
    at = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["s"] + r["size"] - 1))))
    found = runs.select(F.col("doc_id").alias("id"), F.col("tie").alias("t"), at.alias("at"))
    out = slim.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")), "left")
    gone = F.coalesce(F.transform("at", lambda s: F.get(F.col("lines"), s)["i"]), F.array().cast("array<int>"))
    out = out.groupBy("doc_id", "tie").agg(F.first(F.size("lines")).cast("long").alias("n_lines"), F.first(gone).alias("gone"))
    return table(out, "line-cuts")


def _kept(text: Column, gone: Column) -> Column:
    left = lambda rows: F.transform(F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), gone), lambda i: F.get(rows, i))
    return F.when(F.size(gone) > 0, let(F.split(text, "\n"), lambda rows: F.array_join(left(rows), "\n"))).otherwise(text)


def _with_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    keyed = packed(docs, _id=F.col("doc_id"), _tie=F.xxhash64("text"))
    return keyed.join(cuts, same_row({"_id": "doc_id", "_tie": "tie"}), "left")


def dedup_lines(docs: DataFrame, run: int = 3, min_words: int = 50) -> DataFrame:
    """docs plus n_lines, n_removed (lines with a word) and kept_text: the text without the lines of later repeated
    runs; all other lines, blank ones too, stay as they are.

    A run counts from ``run`` lines on, or from fewer lines that have ``min_words`` words together. Lines are compared in
    lower case with blanks as one space, by 64-bit hashes and in runs of several lines by all of them. The first place of
    a run stays: by doc_id (null first), then by a hash of the text, then by position.

    Null text stays null and has no lines. Rows that share a doc_id are told apart by their text; equal rows are one
    document and don't count as repeats of each other. An empty table gives an empty result. Further columns of docs
    pass through, whatever their names; those named like an added column give way to it.
    """
    out = _with_cuts(docs, line_cuts(docs, run, min_words))
    n = F.size("gone").cast("long")
    return unpacked(out, docs, n_lines=F.col("n_lines"), n_removed=n, kept_text=_kept(F.col("_row")["text"], F.col("gone")))


def line_dedup_stage(docs: DataFrame, **options) -> DataFrame:
    """docs with the kept texts and their new n_chars (where docs has that column); documents that lose every line with
    a word are gone. Other columns are unchanged, whatever their names; nulls, ties, repeated rows and empty tables as in
    dedup_lines(): null texts and texts without words stay."""
    cuts = line_cuts(docs, **options).where("size(gone) > 0").withColumn("all", F.size("gone") == F.col("n_lines"))
    out = _with_cuts(docs, cuts).where(~F.coalesce("all", F.lit(False)))
    cut = F.col("gone").isNotNull()
    out = out.withColumn("_text", F.when(cut, _kept(F.col("_row")["text"], F.col("gone"))).otherwise(F.col("_row")["text"]))
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[(new[c].cast(kinds[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
