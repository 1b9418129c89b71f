"""Word vectors against plain counts and the whole matrix, and against vectors by chance on held-out topics."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tarnwick.operators import word_vectors
from tarnwick.operators.embed import Embedder

TOPICS = 5


def topic_texts(n, seed):
    """Texts of one topic each: its 30 words, in the company of 20 that all topics use. A text has few of its topic's words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        topic = i % TOPICS
        own = [f"t{topic}w{k}" for k in range(30)]
        rows.append((topic, " ".join(rng.choice(own) if rng.random() < 0.6 else f"common{rng.randint(0, 19)}" for _ in range(rng.randint(8, 14)))))
    return rows


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.createDataFrame([(t,) for _, t in topic_texts(600, 1)] + [(None,), ("",), (" . ",)], "text string").repartition(4)
    return word_vectors.train(docs, dim=16)


def test_counts_and_information_equal_plain_ones(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["A b, a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = word_vectors.vocabulary(docs, most=6, least=1)
    place = {r["word"]: r["i"] for r in words.collect()}
    all_words = Counter(w for t in texts for w in t.lower().replace(",", "").split())
    assert sorted(place, key=place.get) == sorted(all_words, key=lambda w: (-all_words[w], w))[:6]
    want = Counter()
    for t in texts:
        t = t.lower().replace(",", "").split()
        for x in range(len(t)):
            for y in range(x + 1, min(len(t), x + 5)):
                if t[x] in place and t[y] in place:
                    want[place[t[x]], place[t[y]]] += 1
                    want[place[t[y]], place[t[x]]] += 1
    pairs = word_vectors.co_occurrences(docs, words)
    assert {(r["i"], r["j"]): r["n"] for r in pairs.collect()} == want
    rows, total = Counter(), sum(want.values())
    for (i, _), n in want.items():
        rows[i] += n
    told = {(r["i"], r["j"]): r["v"] for r in word_vectors.information(pairs).collect()}
    value = {k: math.log(n * total / (rows[k[0]] * rows[k[1]])) for k, n in want.items()}
    assert told == {k: pytest.approx(v) for k, v in value.items() if v > 0}


def test_decomposition_equals_the_whole_one(spark):
    rng = np.random.default_rng(3)
    n, basis = 300, np.linalg.qr(rng.normal(size=(300, 6)))[0]
    whole = basis @ np.diag([50, 40, 30, 20, 10, 5.0]) @ basis.T
    whole[np.abs(whole) < 0.02] = 0
    matrix = spark.createDataFrame([(int(i), int(j), float(whole[i, j])) for i, j in zip(*np.nonzero(whole))], "i int, j int, v double")
    u, values = word_vectors.decompose(matrix, n, 4)
    true_u, true_values, _ = np.linalg.svd(whole)
    assert values == pytest.approx(true_values[:4], rel=1e-3)
    assert np.abs(np.sum(u * true_u[:, :4], axis=0)) == pytest.approx(np.ones(4), abs=1e-2)


def same_topic(vectors, topics, k=5):
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return float((np.array(topics)[near] == np.array(topics)[:, None]).mean())


def test_held_out_neighbours_are_of_the_same_topic(learnt):
    rows = topic_texts(200, 99)
    texts, topics = [t for _, t in rows], [c for c, _ in rows]
    trained = same_topic(np.array(learnt.embedder()(texts)), topics)
    chance = same_topic(np.array(Embedder(dim=16)(texts)), topics)
    assert trained > 0.9 and trained > chance + 0.1, (trained, chance)


def test_whole_texts_count(learnt):
    long = "common1 " * 1000 + "t0w1 " * 50
    a, b, none = learnt.embedder()([long, "common1 " * 1000, "unheard"])
    assert a @ b < 0.999 and np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and not none.any()


def test_nothing_to_learn(spark):
    empty = word_vectors.train(spark.createDataFrame([], "text string"), dim=8)
    assert not np.array(empty.embedder()(["a b"])).any()


def test_pairs_are_counted_by_number(spark):
    """Of words without a vector no pair is grouped, so what is counted is bounded by the vocabulary."""
    docs = spark.createDataFrame([("a b rare a",), ("b a",)], "text string")
    words = spark.createDataFrame([("a", 3, 0), ("b", 2, 1)], "word string, n long, i int")
    out = word_vectors.co_occurrences(docs, words)
    assert {(r["i"], r["j"]): r["n"] for r in out.collect()} == {(0, 1): 3, (1, 0): 3, (0, 0): 2}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Aggregate [a#" not in plan
