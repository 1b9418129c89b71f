from __future__ import annotations

import random

from tarnwick.llm import mixing, packing, quality, token_counts
from tests.llm import brute
from tests.llm.test_operators import sentence


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    texts = ["\n".join(sentence(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 7))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(20)] + [(200 + i, "short text") for i in range(5)] + [(300, None), (301, "")]
    rows += [(400 + i, texts[i] + "\n" + sentence(rng, 20)) for i in range(20, 30)]
    rows += [(500 + i, texts[i].replace("\n", " ", 1)) for i in range(30, 40)]
    docs = spark.createDataFrame([(d, t, "en", "src" + str(d % 3), len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    out, frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        out = out.cache()
        frames.append(out)
    assert all(f.columns == docs.columns for f in frames[:-1])
    got = [sorted((r["doc_id"], r["text"]) for r in f.collect()) for f in frames[:-1]]

    kept = {r["doc_id"] for r in quality.quality(docs).where("kept").collect()}
    want = sorted((d, t) for d, t in rows if d in kept)
    assert got[0] == want and {d for d, _ in want} >= set(range(80)) - {d for d, t in rows if t and len(t.split()) < 50}

    lines = brute.kept_lines(want)
    want = sorted((d, lines[d]) for d, t in want if lines[d].strip())
    assert got[1] == want

    roots = brute.components({d: brute.simhash(t) for d, t in want})
    want = [(d, t) for d, t in want if roots[d] == d]
    assert got[2] == want

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(frames[2]).collect()}
    want = [(d, t) for d, t in want for _ in range(copies[d])]
    assert got[3] == want

    last = frames[4].collect()
    assert sorted(r["doc_id"] for r in last) == sorted(d for d, _ in want)
    import public_tokenizers

    tok = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    lengths = sorted(len(tok.encode(t, add_special_tokens=False).ids) for _, t in want)
    counts = {x: lengths.count(x) for x in set(lengths)}
    bounds = packing.best_boundaries(sorted(counts), [counts[x] for x in sorted(counts)], 16)
    assert sum(r["padding"] for r in last) == sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_pipeline_drops_near_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    rows = []
    for i in range(10):
        base = [f"{x}{i}" for x in sentence(rng, 150).split()]
        edited = list(base)
        for k in (30, 80):
            edited[k] = f"other{k}"
        rows += [(i, " ".join(base)), (100 + i, " ".join(edited))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, str(tmp_path)).collect()) == list(range(10))
