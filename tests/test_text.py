"""Sentence model, subwords, splitting, segmentation and ranked summaries, each against a plain version."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwick.operators import embed, segment, sentences, split, summarize
from tarnwick.operators.split import Splitter, by_marks, cut
from tarnwick.operators.subwords import Subwords, byte_letters

ABBREVIATIONS = ["Dr.", "Prof.", "approx.", "z.B.", "e.g.", "No.", "St.", "vs.", "Inc."]
NAMES = ["Miller", "Tanaka", "Okoro", "Weiss", "London", "Paris", "Vega"]
NOUNS = ["river", "engine", "market", "letter", "garden", "method", "window", "doctor", "paper", "winter"]
VERBS = ["moves", "changes", "holds", "finds", "opens", "closes", "keeps", "follows"]
FIRST = ["The", "A", "This", "Its", "However", "In", "Some", "We"]


def prose(rng, n):
    """Sentences with abbreviations, initials, numbers and quotes, as (text, true sentences)."""
    out = []
    for _ in range(n):
        words = [rng.choice(FIRST)] + [rng.choice(["the", "a", "this", "its", "some", "in", "we"] + NOUNS + VERBS) for _ in range(rng.randint(3, 9))]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(1, len(words)), rng.choice([f"{rng.choice(ABBREVIATIONS)} {rng.choice(NAMES)}", f"approx. {rng.randint(2, 99)}", f"e.g. the {rng.choice(NOUNS)}", f"J. {rng.choice(NAMES)}", f"No. {rng.randint(1, 9)}"]))
        end = rng.choice([".", ".", ".", ".", "!", "?", '."', ".)"])
        out.append(" ".join(words) + end)
    return " ".join(out), out


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng, 30)[0]) for i in range(150)] + [(900, None), (901, ""), (902, " . ")], "doc_id long, text string")
    return sentences.train(docs)


def test_likelihood_ratios_equal_plain_counts(spark):
    rng = random.Random(2)
    texts = [prose(rng, 20)[0] for _ in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["type"]: r for r in sentences.abbreviations(sentences.type_counts(sentences.token_pairs(docs))).collect()}
    tokens = [w for t in texts for w in t.split()]
    ends = lambda w: w.rstrip(sentences.CLOSING).endswith(".")
    total, periods = len(tokens), sum(map(ends, tokens))
    with_, without = Counter(), Counter()
    for w in tokens:
        (with_ if ends(w) else without)[sentences.word_type(w)] += 1
    assert set(got) == {w for w in with_ if any(c.isalpha() for c in w)}
    for w, r in got.items():
        a, b, p = with_[w], without[w], periods / total
        ratio = -2 * (a * math.log(p) + b * math.log(1 - p) - a * math.log(0.99) - b * math.log(0.01))
        letters = len(w.replace(".", ""))
        assert (r["with_"], r["without"]) == (a, b)
        assert r["score"] == pytest.approx(ratio * math.exp(-letters) * (w.count(".") + 1) * letters**-b)


def test_dependence_equals_the_formula(spark):
    rows = [(10, 20, 9, 1000), (50, 50, 50, 400), (5, 300, 1, 1000), (7, 9, 0, 100), (30, 30, 1, 60)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, ab long, n long").select(sentences.dependence("a", "b", "ab", "n")).collect()]
    ll = lambda k, n, p: (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n - k else 0)
    want = [2 * (ll(ab, a, ab / a) + ll(b - ab, n - a, (b - ab) / (n - a)) - ll(ab, a, b / n) - ll(b - ab, n - a, b / n)) for a, b, ab, n in rows]
    assert got == pytest.approx(want)


def test_training_finds_abbreviations_and_starters(model):
    assert {sentences.word_type(a) for a in ABBREVIATIONS} <= model.abbreviations | {"#"}
    assert not model.abbreviations & {*NOUNS, *VERBS}
    assert "however" in model.contexts and model.contexts["the"] & sentences.LOWER


def boundaries(parts):
    ends, at = set(), 0
    for p in parts:
        at += len("".join(p.split()))
        ends.add(at)
    return ends


def test_held_out_boundaries_are_better_than_the_expression(model):
    """On prose that was not trained on: F1 of the ends of sentences, counted in characters that are no blanks."""

    def f1(split):
        rng, hit, told, true = random.Random(77), 0, 0, 0
        for _ in range(40):
            text, want = prose(rng, 25)
            a, b = boundaries(split(text)), boundaries(want)
            hit, told, true = hit + len(a & b), told + len(a), true + len(b)
        return 2 * hit / (told + true)

    trained, plain = f1(model.split), f1(by_marks)
    assert trained > 0.97 and trained > plain + 0.05, (trained, plain)


def plain_split(model, text):
    """Every token looked at."""
    out, start, last = [], 0, None
    for m in re.finditer(r"\S+", text or ""):
        if last is not None and last[0].rstrip(sentences.CLOSING).endswith(tuple(sentences.ENDS)) and model.ends(last[0], m[0]):
            out.append(text[start : last.end()])
            start = m.start()
        last = m
    return [*out, text[start : last.end()].strip()] if last is not None else []


def test_ends_are_found_as_by_looking_at_every_token(model):
    rng = random.Random(6)
    pieces = ["a", "The", "e.g.", "Dr.", "J.", "3.", "x!", 'y?"', "z.)", "...", "…", ".", ")", "?!", " ", "  ", "\n", "\x0b", "\u2003", "\x1c", "it", ",", ":", "«Ça", "È."]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, None, "", " ", ". ", " . A"]:
        assert model.split(t) == plain_split(model, t)


def test_pairs_are_counted_in_the_tasks(spark, monkeypatch):
    """Only pairs after a period need both types; with a bound of 8 counted pairs the sums are the same."""
    texts = [" \"It ends.\" Here, e.g. the No. 7 (one) ends! And: so 3.5 goes... Yes", None, "", "a\xa0b c\x1cd. É", "one", "one"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter()
    for text in texts:
        before = None
        for token in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
            bare = None if before is None else before.rstrip(sentences.CLOSING)
            stop = None if bare is None else bare.endswith(".") and not bare.endswith("..")
            own, first = token.rstrip(sentences.CLOSING), token.lstrip(sentences.OPENING)[:1]
            case = 2 if first.isupper() else 1 if first.islower() else 0
            told = sentences.word_type(before) if stop else None, stop, bare is None or bare[-1:] in {*".!?…:"}, None if bare is None else bare[-1:] in {*"!?"}
            want[*told, sentences.word_type(token), own.endswith(".") and not own.endswith(".."), case] += 1
            before = token
    for bound in (sentences.PAIRS_AT_ONCE, 8):
        monkeypatch.setattr(sentences, "PAIRS_AT_ONCE", bound)
        assert {tuple(r)[:-1]: r["n"] for r in sentences.token_pairs(docs).collect()} == want


def test_splitting_loses_nothing_and_is_linear(model):
    rng = random.Random(3)
    for _ in range(20):
        text, _ = prose(rng, 10)
        assert " ".join(model.split(text)) == text
    assert model.split(None) == model.split(" \n ") == [] and model.split("one") == ["one"]
    for hostile in (")" * 300_000 + "x", "a." * 150_000, "." * 300_000, ". " * 150_000, '"' * 300_000, " " * 300_000 + "x", "x" * 300_000):
        began = time.time()
        model.split(hostile)
        assert time.time() - began < 5


def test_training_on_nothing(spark):
    empty = sentences.train(spark.createDataFrame([], "text string"))
    assert not empty.abbreviations and empty.split("One. Two.") == ["One.", "Two."]


# --- subwords and splitting ---


def plain_pieces(word, vocabulary, inside):
    out, at = [], 0
    while at < len(word):
        fits = [e for e in range(len(word), at, -1) if (inside if at else "") + word[at:e] in vocabulary]
        if not fits:
            return None
        out.append(word[at : fits[0]])
        at = fits[0]
    return out


def test_pieces_are_the_longest_that_fit():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    vocabulary = {*stems, *(f"##{s}" for s in stems[:40]), "a", "##a", "##b"}
    subwords = Subwords(vocabulary, inside="##")
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
        assert subwords.pieces(word) == plain_pieces(word, vocabulary, "##")
        assert subwords.count(word) == len(plain_pieces(word, vocabulary, "##") or [0])
    assert subwords.length("") == 2 and subwords.count("a" * 101) == 1


def test_a_vocabulary_file_covers_any_text():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    subwords = Subwords.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(set(byte_letters().values())) == 256
    assert subwords.pieces("the") == ["the</w>"]
    for word in ("naïve", "東京", "xqzzq", "n0w"):
        got = subwords.pieces(word)
        assert "".join(got) == "".join(byte_letters()[b] for b in word.encode()) + "</w>"


@pytest.mark.parametrize("length", [None, "tokens"])
def test_no_snippet_is_above_the_hard_limit(model, length):
    rng = random.Random(5)
    subwords = Subwords([*"abcdefghijklmnopqrstuvwxyz", "th", "the", "er", "in", "ing"], specials=2)
    measure = subwords.length if length else (lambda t: len(t.split()))
    texts = [prose(rng, rng.randint(0, 40))[0] for _ in range(30)]
    texts += ["w " * 900, "para one\n\npara two\n" + "x " * 90 + "\n\n" + "y" * 300, "", "\n\n\n", "a\n" * 200, "nospace" * 400, "Ein Satz. " * 50 + "z" * 1000]
    for chunk, hard in ((40, 50), (12, 13)):
        splitter = Splitter(chunk, hard, measure, model.split)
        for t in texts:
            parts = splitter(t)
            assert all(measure(p) <= hard for p in parts if len(p) > 1)
            assert "".join("".join(parts).split()) == "".join(t.split())


@pytest.mark.parametrize("lower", [True, False])
def test_each_sentence_is_measured_once(model, lower):
    """Lengths of joined texts are sums; the snippets are those of a length that is measured anew each time."""
    rng = random.Random(8)
    subwords = Subwords([*"abcdefghijklmnopqrstuvwxyz", "th", "the", "er", "in", "ing"], lower=lower)
    texts = [prose(rng, rng.randint(0, 40))[0] for _ in range(30)] + ["x y. " * 300, "a b " * 500 + ". C d", "ΑΣ. ΣΑΣ Σ. Σ", "q\x1fr\x85s. T", None]
    for t in texts:
        seen = []
        counted = lambda x: (seen.append(len(x)), subwords.length(x))[1]
        plain = Splitter(40, 50, counted, model.split)(t)
        assert Splitter(40, 50, subwords.length, model.split)(t) == plain
        assert all(subwords.length(p) == sum(map(subwords.count, re.findall(r"\w+|[^\w\s]", p.lower() if lower else p))) + 2 for p in plain)
    seen: list[str] = []
    subwords.runs = counting_runs(subwords, seen)
    text = prose(rng, 200)[0]
    Splitter(4000, 5000, subwords.length, lambda t: t.split(". "))(text)
    assert len("".join(text.split())) * 0.9 < sum(map(len, seen)) < len("".join(text.split())) * 1.1


def counting_runs(subwords, seen):
    class Runs(dict):
        def __getitem__(self, run):
            seen.append(run)
            return subwords._count_run(run)

    return Runs()


def test_cuts_are_taken_in_their_order():
    assert cut("a b\n\nc d e f", 4) == ["a b", "c d e f"]
    assert cut("a b\nc d\ne f g h i", 4) == ["a b\nc d", "e f g h", "i"]
    assert cut("abcdefgh", 3, len) == ["ab", "cd", "ef", "gh"]


# --- segmentation and ranks ---


def test_segmentation_follows_the_published_rules():
    """Examples and consequences of the rules of Annex 29."""
    told = {
        "Mr. Fox jumped. He ran": ["Mr. ", "Fox jumped. ", "He ran"],
        "c.d is 3.4 and U.S. also": ["c.d is 3.4 and U.S. also"],
        "the resp. leaders are": ["the resp. leaders are"],
        "etc.)’ ‘(the": ["etc.)’ ‘(the"],
        "etc.)’ ‘(The": ["etc.)’ ", "‘(The"],
        "He said “Are you going?” John shook": ["He said “Are you going?” ", "John shook"],
        "one.\ntwo\r\nthree four": ["one.\n", "two\r\n", "three ", "four"],
        "Why?! No. 4, then… and. So": ["Why?! ", "No. 4, then… and. ", "So"],
        "日本語です。次の文": ["日本語です。", "次の文"],
        "a.̈ B": ["a.̈ ", "B"],
        "": [],
        " . ": [],
    }
    for text, want in told.items():
        assert segment.sentences(text) == want, text
    assert segment.words("The quick (“brown”) fox can’t jump 32.3 feet, right?") == ["The", "quick", "brown", "fox", "can’t", "jump", "32.3", "feet", "right"]
    assert segment.words("a_b x-y 3,456.7 e.g. über") == ["a_b", "x", "y", "3,456.7", "e.g", "über"]


def test_segmentation_is_linear():
    for hostile in (". " * 100_000, ".)" * 100_000, "a" * 200_000, "!" * 200_000, ".   " + "( " * 100_000):
        began = time.time()
        segment.sentences(hostile)
        assert time.time() - began < 8


def dense_ranks(sentences_, damping=0.85, tolerance=1e-3):
    vocabulary = sorted({w for s in sentences_ for w in s})
    counts = np.array([[s.count(w) for w in vocabulary] for s in sentences_], float).reshape(len(sentences_), -1)
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    unit = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
    weights = 1 - unit @ unit.T
    np.fill_diagonal(weights, 0)
    n = len(weights)
    sums = weights.sum(axis=0)
    flow = np.divide(weights, sums, out=np.full_like(weights, 1 / n), where=sums > 1e-9 * n)
    rank = np.full(n, 1 / n)
    while True:
        new = (1 - damping) / n + damping * flow @ rank
        if np.abs(new - rank).sum() < tolerance:
            return new
        rank = new


def test_ranks_equal_those_of_the_whole_matrix():
    rng = random.Random(6)
    for n in (1, 2, 5, 40):
        for _ in range(10):
            s = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))] for _ in range(n)]
            graph = summarize.Likeness(s)
            assert summarize.pagerank(graph) == pytest.approx(dense_ranks(s), abs=1e-12)
    same = [["a", "b"]] * 6
    assert summarize.pagerank(summarize.Likeness(same)) == pytest.approx(np.full(6, 1 / 6))


def test_a_text_of_50_000_sentences_is_ranked():
    """A whole matrix of them would have 20 GB."""
    rng = random.Random(7)
    text = " ".join(f"{rng.choice(FIRST)} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(NAMES)} {i}." for i in range(50_000))
    began = time.time()
    got = summarize.summarize_ranked_one(text)
    assert time.time() - began < 60 and len(segment.sentences(got)) == 4


def test_sentences_in_a_column(spark, model):
    df = spark.createDataFrame([("Dr. Miller moves. The river holds.",), (None,)], "text string")
    got = [r[0] for r in df.select(sentences.sentences(F.col("text"), model)).collect()]
    assert got == [["Dr. Miller moves.", "The river holds."], []]


def test_types_are_counted_without_pairs(spark):
    docs = spark.createDataFrame([("Dr. Who met (Dr. Who) at 5. p.m. Well... \u201cWell.\u201d 12.5 who.",), ("dr. no",), (None,), ("",)], "text string")
    want = sentences.token_pairs(docs).groupBy("type", "period").agg(F.sum("n").alias("n"))
    got = sentences.token_types(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, sentences.type_counts(got).collect())) == sorted(map(tuple, sentences.type_counts(want).collect()))


def test_segmentation_stops_at_marks_only(monkeypatch):
    """100,000 letters with ten marks: the classes of a few letters are asked for, not of all."""
    asked = []
    known = segment.sentence_class
    monkeypatch.setattr(segment, "sentence_class", lambda c: asked.append(c) or known(c))
    text = ("word and more " * 714 + "here. ") * 10
    assert len(segment.sentence_breaks(text)) == 0 and len(asked) < 200  # a lower letter follows each
    assert len(segment.sentence_breaks(text.replace("here. ", "here. A "))) == 10


def test_words_of_plain_and_other_stretches_are_those_of_the_whole_text():
    rng = random.Random(11)
    plain, wide = "aB1.:;,'_-( \t\n\r", "éÉ中א́‍­\u0085ー\U0001f1e6’·　ा»"
    for _ in range(4000):
        text = "".join(rng.choices(rng.choice((plain, plain + wide)), k=rng.randint(0, 14)))
        assert segment.words(text) == [m[0] for m in segment._WORD.finditer(text) if segment._WORDLIKE.search(m[0])], repr(text)


def test_snippets_of_a_batch_come_in_parts():
    texts = pd.Series(["One sentence. " * 20_000, None, "Two words.", "More of it. " * 100_000])
    do = Splitter()
    parts = list(split._split_in_parts(texts, do))
    assert len(parts) == 1 and len(list(split._split_in_parts(pd.concat([texts] * 3), do))) == 3
    assert [x for p in parts for x in p] == [do(t) for t in texts]


def test_embedder_remembers_a_bounded_number_of_words():
    embed._token_vector.cache_clear()
    before = [v.tolist() for v in embed.Embedder(dim=4)(["a b a", "c", ""])]
    embed.Embedder(dim=4)([" ".join(f"w{i}" for i in range(embed.REMEMBERED + 100))])
    assert embed._token_vector.cache_info().currsize == embed.REMEMBERED
    assert [v.tolist() for v in embed.Embedder(dim=4)(["a b a", "c", ""])] == before
