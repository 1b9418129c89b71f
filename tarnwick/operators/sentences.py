"""Sentence boundaries by a model that is trained without labels: abbreviations, collocations and sentence starters by
their likelihood ratios (Kiss and Strunk, 2006), counted by grouped aggregation."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.session import table

# Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Entries of each part of a model, the strongest first; bounds what the driver and the tasks hold.
MOST_ENTRIES = 100_000
#: Different pairs of tokens that a task holds before it passes their counts on.
PAIRS_AT_ONCE = 1 << 18

#: Quotes and brackets that stand before or after a word, marks that end a sentence, and marks that end a part of one.
OPENING, CLOSING, ENDS, MARKS = "\"'([{«„“‘»›‹", "\"')]}»”’“›‹", ".!?…", ".,;:!?…"
NUMBER = r"[-+]?[0-9]+([.,:/-][0-9]+)*"
TOKEN, NUMBERS, DIGITS = re.compile(r"\S+"), re.compile(NUMBER), frozenset("0123456789")
#: The end of a token at which a sentence can end, and the blanks after it.
END = re.compile(f"([{re.escape(ENDS)}][{re.escape(CLOSING)}]*)\\s+")
LOWER, UPPER_INSIDE, UPPER_FIRST = 1, 2, 4


def word_type(token: str) -> str:
    """Lower case without quotes, brackets and marks around; a number is ``#``."""
    core = token.lstrip(OPENING).rstrip(CLOSING).rstrip(MARKS).lower()
    return "#" if core[-1:] in DIGITS and NUMBERS.fullmatch(core) else core


def _bare(token: Column) -> Column:
    return F.rtrim(token, F.lit(CLOSING))


def _type(token: Column) -> Column:
    core = F.lower(F.rtrim(F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING)), F.lit(MARKS)))
    return F.when(core.rlike(f"^{NUMBER}$"), F.lit("#")).otherwise(core)


def _period(token: Column) -> Column:
    """One period at the end, under closing quotes and brackets."""
    return _bare(token).endswith(".") & ~_bare(token).endswith("..")


#: Of the token before: first, stop, after_mark, certain; of the token: type, period, case.
PAIR = "first string, stop boolean, after_mark boolean, certain boolean, type string, period boolean, case int, n long"


def _told_before(token: str | None) -> tuple[str | None, bool | None, bool, bool | None]:
    if token is None:
        return None, None, True, None
    bare = token.rstrip(CLOSING)
    stop = bare.endswith(".") and not bare.endswith("..")
    return word_type(token) if stop else None, stop, bare[-1:] in {*ENDS, ":"}, bare[-1:] in {"!", "?"}


def _told(token: str) -> tuple[str, bool, int]:
    bare, first = token.rstrip(CLOSING), _first(token)
    case = {"Lu": 2, "Ll": 1}.get(unicodedata.category(first), 0) if first else 0
    return word_type(token), bare.endswith(".") and not bare.endswith(".."), case


def _told_pairs(counts: Counter, pairs: Counter) -> pa.RecordBatch:
    """counts: of all tokens; pairs: of those after a mark or at the beginning, with the one before."""
    before = {b: _told_before(b) for b in {b for b, _ in pairs}}
    tokens = {t: _told(t) for t in counts}
    sums: Counter = Counter()
    for (b, t), n in pairs.items():
        sums[before[b] + tokens[t]] += n
        counts[t] -= n
    plain = _told_before("")
    for t, n in counts.items():
        if n:
            sums[plain + tokens[t]] += n
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.int32()]
    columns = zip(*sums, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(sums.values(), pa.int64())], names=[c.split()[0] for c in PAIR.split(", ")])


def token_pairs(docs: DataFrame) -> DataFrame:
    """How often (n) each type of token (a run without blanks) stands after each other: first, stop (it ends in a period), after_mark, certain
    (it ends in ! or ?), type, period, case (1 lower, 2 upper, 0 neither). first is told only where it ends in a period. What is told of
    the one before is null, or after_mark, at the beginning. Tasks count equal pairs first, and hold a bounded number of them."""
    run_, last, marks = re.compile(r"[^ \t\n\x0b\f\r]+"), frozenset(CLOSING + ENDS + ":"), frozenset(ENDS + ":")
    other = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # blanks to split() alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pairs = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                t = run_.findall(text) if other.search(text) else text.split()
                if not t:
                    continue
                counts.update(t)
                at = [i for i, x in enumerate(t, 1) if x[-1] in last and x.rstrip(CLOSING)[-1:] in marks]
                if at and at[-1] == len(t):
                    at.pop()
                pairs.update([(None, t[0]), *((t[i - 1], t[i]) for i in at)])
                if len(counts) + len(pairs) >= PAIRS_AT_ONCE:
                    yield _told_pairs(counts, pairs)
                    counts, pairs = Counter(), Counter()
        if counts:
            yield _told_pairs(counts, pairs)

    each = docs.select("text").mapInArrow(run, PAIR)
    return each.groupBy(*(c for c in each.columns if c != "n")).agg(F.sum("n").alias("n"))


def token_types(docs: DataFrame) -> DataFrame:
    """type, period, n of all tokens: what type_counts() needs of token_pairs(), without the pairs. Equal tokens are counted
    before their types are worked out."""
    each = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(_type(F.col("token")).alias("type"), _period(F.col("token")).alias("period")).agg(F.sum("n").alias("n"))


def type_counts(counts: DataFrame) -> DataFrame:
    """token_pairs() or token_types() -> type, with_, without, all, periods, of the types with letters that end in a period somewhere."""
    ended, other = F.when(F.col("period"), F.col("n")).otherwise(0), F.when(F.col("period"), 0).otherwise(F.col("n"))
    sums = counts.agg(F.sum("n").alias("all"), F.sum(ended).alias("periods"))
    types = counts.groupBy("type").agg(F.sum(ended).alias("with_"), F.sum(other).alias("without"))
    return types.where(F.col("type").rlike(r"\p{L}") & (F.col("with_") > 0)).crossJoin(F.broadcast(sums))  # sums: one row


def _binomial(k: Column, n: Column, p: Column) -> Column:
    """log of p ** k * (1 - p) ** (n - k), with 0 ** 0 = 1."""
    part = lambda m, q: F.when(m > 0, m * F.log(F.greatest(q, F.lit(1e-300)))).otherwise(F.lit(0.0))
    return part(k, p) + part(n - k, 1 - p)


def abbreviations(counts: DataFrame) -> DataFrame:
    """counts (type, with_, without: how often a type ends in a period, or not; all, periods: sums over all types) plus ``score``.

    The ratio of the likelihoods that the type takes a period nearly always or as often as any word does, times a factor
    for shortness, one for periods inside, and a penalty for each time that it stands without."""
    n, k = F.col("with_") + F.col("without"), F.col("with_")
    ratio = 2 * (_binomial(k, n, F.lit(0.99)) - _binomial(k, n, F.col("periods") / F.col("all")))
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inside = F.length("type") - letters + 1
    return counts.withColumn("score", ratio * F.exp(-letters) * inside * F.pow(letters.cast("double"), -F.col("without")))


def dependence(first: str, second: str, both: str, all_: str) -> Column:
    """Dunning's log-likelihood ratio that second follows first more or less often than it stands anywhere; the
    arguments name columns of counts."""
    a, b, ab, n = (F.col(c).cast("double") for c in (first, second, both, all_))
    apart = _binomial(ab, a, ab / a) + _binomial(b - ab, n - a, (b - ab) / F.greatest(n - a, F.lit(1.0)))
    return 2 * (apart - _binomial(ab, a, b / n) - _binomial(b - ab, n - a, b / n))


@dataclass(frozen=True)
class SentenceModel:
    """What training found; an empty model ends a sentence at each mark."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()
    contexts: dict[str, int] = field(default_factory=dict)

    def ends(self, token: str, following: str) -> bool:
        """Whether a sentence ends between the two tokens, the first of which ends in a mark."""
        bare = token.rstrip(CLOSING)
        if not bare.endswith(".") or bare.endswith(".."):
            return not bare.endswith((".", "…")) or not _first(following).islower()
        kind, after = word_type(token), word_type(following)
        initial = len(kind) == 1 and kind.isalpha()
        if (kind, after) in self.collocations:
            return False
        if kind not in self.abbreviations and not initial and kind != "#":
            return True
        first, seen = _first(following), self.contexts.get(after, 0)
        if first.isupper() and seen & LOWER and not seen & UPPER_INSIDE:
            return True  # elsewhere in lower case, so a sentence begins with it
        if first.islower():
            return False
        return kind == "#" or (not initial and first.isupper() and after in self.starters)

    def split(self, text: str | None) -> list[str]:
        """The sentences of a text, without blanks around; marks stay with the sentence they end."""
        text = text or ""
        out, start, seen = [], 0, 0
        for m in END.finditer(text):
            if m.end() == len(text):
                break
            token = text[seen : m.end(1)].rsplit(None, 1)[-1]
            seen = m.end()
            if self.ends(token, TOKEN.match(text, seen)[0]):
                out.append(text[start : m.end(1)])
                start = seen
        last = text[start:].strip()
        return [*out, last] if last else out


def _first(token: str) -> str:
    return token.lstrip(OPENING)[:1]


def _strongest(rows: DataFrame, by: str) -> list:
    return rows.orderBy(F.desc(by), *[c for c in rows.columns if c != by]).limit(MOST_ENTRIES).collect()


def train(docs: DataFrame) -> SentenceModel:
    """A model from all rows of docs (text). Tokens are counted by type, and by type and the one before; only counts leave a
    task, and of the results at most MOST_ENTRIES of each kind, the strongest, the driver. Null texts have no tokens; an empty
    table gives the empty model."""
    counts = table(token_pairs(docs), "token-pairs")
    scored = abbreviations(type_counts(counts))
    known = _strongest(scored.where(F.col("score") >= ABBREVIATION).select("type", "score"), "score")
    short = [r["type"] for r in known]
    if not short:
        short_of = lambda c: F.lit(False)
    else:
        listed = F.broadcast(docs.sparkSession.createDataFrame([(t, True) for t in short], "first string, short boolean"))  # MOST_ENTRIES rows at most
        counts = counts.join(listed, "first", "left")
        short_of = lambda c: F.coalesce(F.col("short"), F.lit(False))
    counts = counts.withColumn("short_first", short_of("first"))
    initial = F.col("first").rlike(r"^\p{L}$")
    ended = F.coalesce((F.col("stop") & ~F.col("short_first") & ~initial & (F.col("first") != "#")) | F.col("certain"), F.lit(False))

    word = F.col("type").rlike(r"^\p{L}")
    by_type = counts.groupBy("type").agg(
        F.sum("n").alias("count"),
        F.sum(F.when(ended, F.col("n")).otherwise(0)).alias("began"),
        F.max(F.when(F.col("case") == 1, LOWER).otherwise(0)).alias("lower"),
        F.max(F.when((F.col("case") == 2) & ~F.col("after_mark"), UPPER_INSIDE).otherwise(0)).alias("inside"),
        F.max(F.when((F.col("case") == 2) & ended, UPPER_FIRST).otherwise(0)).alias("first_"),
    )
    total = counts.agg(F.sum("n").alias("all"), F.sum(F.when(ended, F.col("n")).otherwise(0)).alias("ends"))
    starters = by_type.where(word & (F.col("began") > 0)).crossJoin(F.broadcast(total)).withColumn("score", dependence("ends", "count", "began", "all"))
    starters = starters.where((F.col("score") >= STARTER) & (F.col("began") / F.col("ends") > F.col("count") / F.col("all")))
    context = by_type.where(word).select("type", (F.col("lower") + F.col("inside") + F.col("first_")).alias("seen"), "count")

    near = counts.where(F.col("stop") & (F.col("short_first") | initial | (F.col("first") == "#"))).groupBy("first", "type").agg(F.sum("n").alias("both")).where(word & (F.col("both") > 1))
    firsts = counts.where("stop").groupBy("first").agg(F.sum("n").alias("count_first"))
    pairs = near.join(firsts, "first").join(by_type.select("type", "count"), "type").crossJoin(F.broadcast(total.select("all")))
    pairs = pairs.withColumn("score", dependence("count_first", "count", "both", "all"))
    pairs = pairs.where((F.col("score") >= COLLOCATION) & (F.col("both") / F.col("count_first") > F.col("count") / F.col("all")))
    begun = frozenset(r["type"] for r in _strongest(starters.select("type", "score"), "score"))
    met = frozenset((r["first"], r["type"]) for r in _strongest(pairs.select("first", "type", "score"), "score") if r["type"] not in begun)
    return SentenceModel(frozenset(short), begun, met, {r["type"]: r["seen"] for r in _strongest(context, "count")})


def sentences(text: Column, model: SentenceModel) -> Column:
    """The sentences of a text, as an array."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.split(t) for t in texts])

    return run(text)
