"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import join_skewed, let, table

#: Labelled documents that the text model is fitted on, at most, in equal shares for all languages, but LEAST_DOCS each.
FIT_DOCS, LEAST_DOCS = 8000, 20
#: Buckets of byte trigrams, and numbers that the model may have: with over 256 languages it has fewer buckets.
MOST_BUCKETS, MODEL_SIZE = 1 << 16, 1 << 24
#: A page's text counts as so many independent trigrams at most: they are far from independent.
TEXT_WEIGHT = 50.0
#: Pages' worth of belief that a host has in its domain, a domain in the whole, and a language in an unseen mark.
HOST_PRIOR, DOMAIN_PRIOR, MARK_PRIOR = 5.0, 20.0, 10.0
MARKS = ("declared", "suffix", "domain", "host")


def _grams(text: str, buckets: int) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)) & np.uint32(buckets - 1)


def _least_hashes(rows: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """At most ``most`` different rows (lang, text) of each language, those with the least hashes. A bound on the hash,
    from the languages' counts of rows, lets little more than these leave the scan; copies are one row before any sort."""
    bound = lambda n: int((min(1.0, 1.2 * most / max(1, n)) - 0.5) * 2.0**64 - 1024)
    bounds = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(bound(n)).cast("long"))])
    hashed = rows.withColumn("h", F.xxhash64("text", "lang")).where(F.col("h") <= bounds[F.col("lang")])
    one = hashed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    ranked = one.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("nth") <= most).select("lang", "text")


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, from at most FIT_DOCS different labelled rows (text,
    lang), every language with its share. What reaches the driver is a count for each language and bucket at most."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return [], np.zeros((0, MOST_BUCKETS), np.float32)
    buckets = MOST_BUCKETS
    while buckets * len(counts) > MODEL_SIZE and buckets > 256:
        buckets //= 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                into = sums.setdefault(lang, np.zeros(buckets, np.int64))
                into += np.bincount(_grams(text, buckets), minlength=buckets)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": v[at]})

    sample = _least_hashes(rows, counts, max(LEAST_DOCS, FIT_DOCS // len(counts))).repartition(8)
    got = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts)
    logs = np.full((len(langs), buckets), 0.5)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        logs[i, own["bucket"]] += own["n"]
    return langs, np.log(logs / logs.sum(axis=1, keepdims=True)).astype(np.float32)


def page_marks(pages: DataFrame) -> DataFrame:
    """page_id, text (without markup), declared, host, domain, suffix; what is missing is an empty string. A script,
    style, title, menu or comment that is not closed goes on to the page's end. The language is declared in the first html tag."""
    page = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(page, r"(?is)<(script|style|title|nav)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    tag = F.regexp_extract(page, r"(?i)<html\b([^>]*)", 1)  # to the next >, so a page is read once whatever it repeats
    declared = F.lower(F.regexp_extract(tag, r"""(?i)\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    labels = F.split("host", r"\.")
    rows = pages.select("page_id", text.alias("text"), declared.alias("declared"), host.alias("host"))
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return rows.withColumn("domain", domain).withColumn("suffix", F.element_at(labels, -1))


def _text_scores(marks: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """marks without the text, plus ``ll``: per language the scaled log likelihood, the best being 0. Character
    references in the text are read as the characters they stand for."""
    given = marks.sparkSession.sparkContext.broadcast(logs)  # MODEL_SIZE numbers at most

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                grams = _grams(html.unescape(text), given.value.shape[1])
                ll = given.value[:, grams].sum(axis=1, dtype=np.float64) * min(1.0, TEXT_WEIGHT / max(1, len(grams)))
                out.append(ll - ll.max())
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), pd.DataFrame({"ll": out})], axis=1)

    cols = [f.name + " " + f.dataType.simpleString() for f in marks.schema if f.name != "text"]
    return marks.mapInPandas(score, ", ".join(cols) + ", ll array<double>")


def fuse(scores: DataFrame, n_langs: int) -> DataFrame:
    """scores (page_id, ll: log likelihoods of the text by language, declared, suffix, domain, host) plus ``score``: the
    log posteriors, not normalised.

    The posteriors of the texts alone are summed by mark and by host over all pages. log posterior = ll + log P(declared
    | language) + log P(suffix | language) + log host prior. A host's prior is its own sum smoothed by its domain's,
    which is smoothed by the whole. A page's own share is left out of all of these sums but the overall one.
    """
    k = range(n_langs)
    total = F.aggregate(F.transform("ll", F.exp), F.lit(0.0), lambda a, x: a + x)
    rows = scores.withColumn("p", let(total, lambda t: F.transform("ll", lambda x: F.exp(x) / t))).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("site", F.concat_ws(" ", "domain", "host"))
    rows = table(rows, "page-scores")
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in k]
    gather = lambda df, name: df.withColumn(name, F.array(*[F.col(f"s{i}") for i in k])).drop(*[f"s{i}" for i in k])
    n = rows.count()
    out = rows.join(F.broadcast(gather(rows.agg(*sums), "all_sum")))  # one row
    for name, key in zip(MARKS, ("declared", "suffix", "domain", "site"), strict=True):
        by = gather(rows.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), *sums), f"{name}_sum")
        out = join_skewed(out, table(by, f"page-{name}"), key, f"{name}_sum", "pages", "rid", n)
    return out.withColumn("score", F.array(*[_score(i) for i in k])).drop("rid", "site")


def _sum(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _score(i: int) -> Column:
    at = lambda c: F.get(c, F.lit(i))
    others = lambda c: F.greatest(at(c) - at("p"), F.lit(0.0))
    others_sum = lambda c: F.greatest(_sum(c) - 1, F.lit(0.0))
    overall = at("all_sum") / _sum("all_sum")
    domain = (others("domain_sum") + DOMAIN_PRIOR * overall) / (others_sum("domain_sum") + DOMAIN_PRIOR)
    host = (others("host_sum") + HOST_PRIOR * domain) / (others_sum("host_sum") + HOST_PRIOR)
    mark = lambda c: F.log((others(c) + MARK_PRIOR * _sum(c) / _sum("all_sum")) / (others("all_sum") + MARK_PRIOR))
    return at("ll") + mark("declared_sum") + mark("suffix_sum") + F.log(F.greatest(host, F.lit(1e-12)))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence of each page: text likelihoods, fused as in fuse() with the
    declared language, the address's suffix and the host's prior. A mark that contradicts the texts loses its weight.

    pages: page_id, url, html; labelled: text, lang; other columns are ignored, whatever their names. A null url or html
    has no marks; an empty page, or one without text, follows its host and marks; pages are read whole, however long;
    null page_ids and repeated rows pass through, each repetition counting as a page. Of languages that tie the first by
    name is taken. Labelled rows without text or language are left out; without any no language is known and lang is
    null. An empty table of pages gives an empty result.
    """
    marks = page_marks(pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html"))
    langs, logs = fit(labelled)
    kind = pages.schema["page_id"].dataType
    if not langs:
        none = F.lit(None).cast("string")
        return marks.select(F.col("page_id").cast(kind).alias("page_id"), "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    out = fuse(_text_scores(marks, langs, logs), len(langs))
    best = lambda c: F.get(F.array(*[F.lit(x) for x in langs]), F.array_position(c, F.array_max(c)).cast("int") - 1)
    norm = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "host", "declared", best(F.col("ll")).alias("text_lang"), best(F.col("score")).alias("lang"), F.round(1 / norm, 6).alias("confidence"))
