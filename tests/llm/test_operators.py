from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import fm_index, language_id, line_dedup, lz_fingerprint, mixing, packing, pii, quality, simhash, substring_dedup, token_counts
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, tie string, fp string, w string, host string"
ODD = [None, "", " \n\t ", "one", "two words", "a b c", "Wörter — ümläut ñ €", "x " * 3000]


def frame(spark, rows):
    """Rows (doc_id, text) or (doc_id, text, source), with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, 7, "t", "f", "w", "h") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice("the and of ing er on at re th st nd ou le en ti wh".split()) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = ["\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    passage = sentence(rng, 120)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i]) for i in range(8)]
    rows += [(200 + i, sentence(rng, 20) + " " + passage + " " + sentence(rng, 15)) for i in range(12)]
    rows += [(300 + i, texts[i].replace("the", "thx", 1)) for i in range(12)]
    rows += [(400 + i, t) for i, t in enumerate(ODD)]
    rng.shuffle(rows)
    return rows


# --- mixing ---


def test_mix_hits_targets_and_is_repeatable(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(1, 40)), rng.choice(["a", "b", "c", "Z", None])) for i in range(600)] + [(None, "x y", "a"), (7, None, "b"), (7, "same id", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = {}, {}, {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
    total = sum(sizes.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(["Z", "a", "b", "c", None], [3, 1, 2, 3, 1], strict=True))
    free = {s: targets[s] / weights[s] for s in targets if targets[s] < 2 * sizes[s] - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 40
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(frame(spark, rows).repartition(7)).collect()))


def test_mix_by_weight_prefers_heavy_documents(spark):
    rows = [(i, "w " * 10, "s") for i in range(400)]
    docs = frame(spark, rows).withColumn("worth", (F.col("doc_id") % 2) * 3 + 1)
    got = mixing.mix(docs, share=0.5, weight_col="worth").collect()
    heavy = sum(r["copies"] for r in got if r["doc_id"] % 2)
    light = sum(r["copies"] for r in got if not r["doc_id"] % 2)
    assert heavy + light == 200 and 2.5 < heavy / light < 7


def test_mix_stage_repeats_and_drops(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(100)]
    docs = frame(spark, rows)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in want.items() if n}


# --- language ---


def test_language_by_all_evidence(spark):
    sounds = {"en": "the and of ing er on at", "fr": "eau eux é la des ouè que", "de": "sch ung ä ö ü ein ich"}
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(sounds[lang].split()) + rng.choice(sounds[lang].split()) for _ in range(n))
    labelled = spark.createDataFrame([(text(k, 80), k) for k in sounds for _ in range(30)], "text string, lang string")
    pages, truth = [], {}
    for i in range(150):
        lang = list(sounds)[i % 3]
        truth[i] = lang
        body = text(lang, 40) if i % 10 else ""
        pages.append((i, f"https://www.{lang}-site.example.org/p/{i}", f'<html lang="{lang}"><body><script>x</script><p>{body}</p></body></html>', "t"))
    pages += [(900, None, None, "t"), (None, "no url", "<p>", "t"), (901, "http://lone.example.com/", "", "t")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string, host string"), labelled).collect()}
    assert len(got) == len(pages)
    assert sum(got[i]["lang"] == truth[i] for i in truth) >= 148
    assert all(0 < r["confidence"] <= 1 for r in got.values())
    none = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string, x string"), labelled.where("false"))
    assert {r["lang"] for r in none.collect()} == {None}


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit, test = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    pages = test.select(F.col("doc_id").alias("page_id"), F.lit("http://one.example.com/").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"), F.col("lang").alias("truth"))
    got = language_id.identify(pages, fit).join(pages.select("page_id", "truth"), "page_id")
    assert got.where("text_lang = truth").count() / got.count() > 0.95


def test_language_sample_is_bounded_and_has_all_languages(spark):
    rows = spark.range(3000).select(F.when(F.col("id") >= 2990, "xx").otherwise("en").alias("lang"), F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = language_id._least_hashes(rows, {"en": 2990, "xx": 10}, 200).collect()
    en = [r["text"] for r in got if r["lang"] == "en"]
    assert 100 < len(en) <= 200 and len(set(en)) == len(en) and len(got) - len(en) == 10
    assert language_id._least_hashes(rows, {"en": 2990, "xx": 10}, 5000).count() == 2001
    assert language_id._least_hashes(rows.where("false"), {"en": 1}, 200).collect() == []
    many = spark.range(900).select(F.concat(F.lit("l"), F.col("id") % 300).alias("lang"), F.concat(F.lit("abc "), "id").alias("text"))
    langs, logs = language_id.fit(many)
    assert len(langs) == 300 and logs.shape == (300, 1 << 15)


def test_language_fusion_against_plain_python(spark, monkeypatch):
    rng = random.Random(20)
    pages = []
    for i in range(120):
        ll = [-rng.random() * 9 for _ in range(3)]
        domain = f"d{rng.randrange(4) if i % 3 else 0}.org"
        pages.append({"page_id": str(i), "ll": [x - max(ll) for x in ll], "declared": rng.choice(["", "en", "fr", f"x{i}"]), "suffix": rng.choice(["org", "fr"]), "domain": domain, "host": rng.choice(["www.", "a."]) + domain})
    df = spark.createDataFrame([(p["page_id"], p["ll"], p["declared"], p["suffix"], p["domain"], p["host"]) for p in pages], "page_id string, ll array<double>, declared string, suffix string, domain string, host string")
    got = {r["page_id"]: r["score"] for r in language_id.fuse(df, 3).collect()}
    for p, want in zip(pages, brute.fused(pages), strict=True):
        s = np.array(got[p["page_id"]])
        assert s - np.log(np.exp(s - s.max()).sum()) - s.max() == pytest.approx(want, abs=1e-9)


def test_language_of_odd_pages(spark):
    labelled = spark.createDataFrame([("la été à é éé ù naïve où", "fr"), ("the of and this", "en"), (None, "de"), ("x", None)], "text string, lang string")
    url = "http://h.example.org/"
    long = "<p>" + "the of and " * 300_000 + "</p>"
    pages = [(1, url, "<p>&eacute;t&eacute; &agrave; o&ugrave;</p>"), (2, url, long), (2, url, long), (3, url, ""), (None, None, None), (4, url, "<script>" * 100_000), (5, url, "<!--" * 100_000), (6, url, "<" * 300_000)]
    got = language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(pages) and by[1]["text_lang"] == "fr" and by[2]["text_lang"] == by[2]["lang"] == "en"
    assert language_id.identify(spark.createDataFrame(pages[:0], "page_id long, url string, html string"), labelled).collect() == []


# --- quality ---


def naive_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_figures(spark, corpus):
    rng = random.Random(5)
    rows = [*corpus, (900, "a b c d " * 40 + "# * $"), (901, " ".join(rng.choice("ab") for _ in range(300)))]
    rows = [r for r in rows if len(r[1] or "") < 3000]
    for r in quality.quality(frame(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        want = naive_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_rejects_boilerplate_and_keeps_copies(spark):
    rng = random.Random(6)
    menu = [sentence(rng, 25) for _ in range(4)]
    hollow = [(i, "\n".join([*menu, f"only line {i} " + sentence(rng, 5)]), "h") for i in range(40)]
    copy = "\n".join(sentence(rng, 25) for _ in range(5))
    copies = [(100 + i, copy, "h") for i in range(40)]
    clean = [(200 + i, "\n".join([*menu, *(sentence(rng, 25) for _ in range(9))]), "h") for i in range(40)]
    other = [(300, "\n".join([*menu, "alone on its host"]), None)]
    rows = hollow + copies + clean + other
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(frame(spark, rows)).collect()}
    assert not any(kept[i] for i, *_ in hollow)
    assert all(kept[i] for i, *_ in copies + clean + other)
    out = quality.quality_stage(frame(spark, [*rows, rows[0], clean[0]]))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted([i for i, *_ in copies + clean + other] + [200])
    assert out.columns == frame(spark, rows).columns


@pytest.mark.parametrize(("shared", "own"), [(40, 1), (20, 2), (10, 2), (2, 1), (1, 0)])
def test_quality_rejects_documents_of_shared_lines(spark, shared, own):
    rng = random.Random(16)
    menu = [sentence(rng, 55 if shared < 3 else 12) for _ in range(shared)]
    pick = lambda: rng.sample(menu, max(1, shared - 3)) if shared > 3 else menu
    hollow = [(i, "\n".join([*pick(), *(f"own {i} {k} {sentence(rng, 4)}" for k in range(own or i % 20))]), "h") for i in range(200)]
    clean = [(1000 + i, "\n".join(sentence(rng, 12) for _ in range(6)), "h") for i in range(20)]
    copies = [(2000 + i, clean[0][1].upper(), "h") for i in range(100)]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, hollow + clean + copies)).collect()}
    depleted = [i for i, t, _ in hollow if own or len(t.split()) < 2 * 55]
    assert depleted and not any(got[i]["kept"] for i in depleted)
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 0 for i, *_ in clean + copies)


# --- simhash ---


def test_simhash_and_components(spark, corpus):
    rng = random.Random(7)
    base = sentence(rng, 200).split()
    chain = []
    for i in range(60):
        base[rng.randrange(200)] = f"w{i}"
        chain.append((500 + i, " ".join(base)))
    rows = corpus + chain
    prints = {d: brute.simhash(t) for d, t in rows}
    roots = brute.components(prints)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == roots
    out = simhash.near_dedup_stage(frame(spark, [*rows, rows[0]]))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(roots.values()))


def test_links_find_all_close_pairs(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(4)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(df).collect()} == want


def test_near_copies_of_five_words(spark, corpus):
    rng = random.Random(17)
    rows = list(corpus)
    for i in range(25):
        base = [f"{x}{i}" for x in sentence(rng, 150).split()]
        rows.append((500 + i, " ".join(base)))
        for j in range(6):  # 1 to 6 words changed: similarity 0.93 to about 0.66
            words = list(base)
            for k in rng.sample(range(150), j + 1):
                words[k] = f"n{j}{k}"
            rows.append((600 + 10 * i + j, " ".join(words)))
    grams = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in rows for w in [(t or "").lower().split()]}
    root = {d: d for d in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == {d: find(d) for d in grams}
    out = simhash.near_copies_stage(frame(spark, [*rows, rows[0]]))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({find(d) for d in grams})
    assert simhash.near_copies(frame(spark, rows[:0])).collect() == []


# --- line dedup ---


def line_rows(corpus):
    rng = random.Random(9)
    lines = [sentence(rng, 30 if i % 7 == 3 else 6) for i in range(30)]
    long = [sentence(rng, 60) for _ in range(3)]
    made = []
    for i in range(80):
        at = rng.randrange(24)
        body = lines[at : at + rng.randint(1, 6)]
        made.append((600 + i, "\n".join([sentence(rng, 4), *(x.upper() if rng.random() < 0.3 else x + "  " for x in body), "", sentence(rng, 3), *body[:2], *rng.sample(long, i % 2)])))
    return [*corpus, *made, (800, long[0]), (801, " " + long[0]), (802, "\n".join(lines[3:4] * 3)), (803, "\n".join(["a b"] * 9))]


def test_line_dedup(spark, corpus):
    rows = line_rows(corpus)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    want = brute.kept_lines(rows)
    assert got[801]["kept_text"] == "" and got[803]["n_removed"] > 0
    for d, t in rows:
        assert got[d]["kept_text"] == (None if t is None else want[d])
    out = line_dedup.line_dedup_stage(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns and out.where("length(text) <> n_chars").where("text is not null").count() == 0
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: None if t is None else want[d] for d, t in rows if not (t or "").strip() or want[d].strip()}


def test_line_dedup_needs_extension(spark, corpus, monkeypatch):
    """With matches cut to the selected lines themselves, windows around them are not covered."""
    rows = line_rows(corpus)
    met = line_dedup._extend
    monkeypatch.setattr(line_dedup, "_extend", lambda r, f, run: met(r.withColumn("c0", F.lit(None).cast("long")).withColumn("c3", F.lit(None).cast("long")), f, run))
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    want = brute.kept_lines(rows)
    assert sum(got[d] != want[d] for d, t in rows if t is not None) > 10


def test_winnowing_selects_few_and_the_same(spark):
    rng = random.Random(19)
    lines = [sentence(rng, 6) for _ in range(300)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[100:140], "x y"]))]
    slim = frame(spark, rows).select("doc_id", F.lit(1).cast("long").alias("tie"), line_dedup._lines(F.col("text")).alias("lines"))
    got = [[r["p"] for r in line_dedup.minima(slim, 3, 50).where(f"doc_id = {d}").collect()] for d in (1, 2)]
    assert 100 < len(got[0]) < 230 and max(b - a for a, b in zip(sorted(got[0]), sorted(got[0])[1:], strict=False)) <= 2
    assert {p for p in got[0] if 101 <= p < 137} == {p + 100 for p in got[1] if 1 <= p < 37}


def test_line_dedup_ties_and_repeats(spark):
    run = "\n".join(f"line {i} here" for i in range(4))
    rows = [(1, run + "\nfirst"), (1, run + "\nsecond"), (1, run + "\nsecond"), (None, run), (None, None), (2, None)]
    got = sorted((str(r["doc_id"]), str(r["kept_text"])) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([("1", "first"), ("1", "second"), ("1", "second"), ("None", run), ("None", "None"), ("2", "None")])
    got = sorted(r["kept_text"] for r in line_dedup.dedup_lines(frame(spark, rows[:3])).collect())
    assert got in (["first", run + "\nsecond", run + "\nsecond"], sorted([run + "\nfirst", "second", "second"]))


# --- fingerprints ---


def test_lz_parse_and_edits(spark, corpus):
    rng = random.Random(10)
    for _ in range(50):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 200)))
        assert set(lz_fingerprint.parse(data, set())[0]) == brute.lz_phrases(data)
    got = {r["doc_id"]: r for r in lz_fingerprint.fingerprint_and_edit(frame(spark, corpus)).collect()}
    order = sorted(corpus, key=lambda r: -r[0])
    assert len(got) == len(corpus)
    for (d, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after, r = t or "", after or "", got[d]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), brute.sha(edited))
        one, two, nxt = (lz_fingerprint.short(lz_fingerprint.signature(sorted(brute.lz_phrases(x.encode())))) for x in (t, edited, after))
        assert r["fingerprint"] == one.tobytes().hex()
        assert r["edited_fingerprint"] == two.tobytes().hex()
        assert r["near_edited"] == pytest.approx(lz_fingerprint.likeness(one, two))
        assert r["near_next"] == pytest.approx(lz_fingerprint.likeness(one, nxt))


@pytest.mark.parametrize(("size", "grow", "coarse"), [(16, 4096, 64), (4, 2, 3), (3, 4096, 1)])
def test_lz_over_many_ranges(spark, monkeypatch, size, grow, coarse):
    for name, value in (("RANGE_DOCS", size), ("GROW", grow), ("COARSE", coarse)):
        monkeypatch.setattr(lz_fingerprint, name, value)
    rows = [(i * 3, f"text {i} " * (i % 4)) for i in range(200)] + [(None, "no id"), (30, "same id"), (30, "text 10 " * 2)]
    got = lz_fingerprint.fingerprint_and_edit(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i * 3: f"text {i} " * (i % 4) for i in range(200)}
    for r in got:
        d = r["doc_id"]
        if d in text and d not in (30, 33, 0):
            t, after = text[d], text[d - 3]
            assert r["edited_sha256"] == brute.sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2])


def test_lz_of_null_ids_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGE_DOCS", 8)
    texts = [f"null {i} of {i * i}" for i in range(60)]
    rows = [(None, t) for t in texts] + [(5, "five " * 9), (9, "nine " * 9)]
    ties = {r["text"]: r["tie"] for r in frame(spark, rows).select("text", F.xxhash64("text").alias("tie")).collect()}
    got = lz_fingerprint.fingerprint_and_edit(frame(spark, rows)).collect()
    order = [rows[-1][1], rows[-2][1], *sorted(texts, key=ties.get)]
    want = sorted(brute.sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2]) for t, after in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r["edited_sha256"] for r in got) == want


# --- packing ---


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(11)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), 9))
        counts = [rng.randint(1, 9) for _ in lengths]
        padding = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(padding([*c, lengths[-1]]) for k in range(3) for c in combinations(lengths[:-1], k))
        assert padding(packing.best_boundaries(lengths, counts, 3)) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 32)
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 300)) for i in range(500)] + [(None, "a b"), (3, None), (3, None), (1000, "w " * 5000)]
    got = packing.pack(frame(spark, rows), budget=1000, n_buckets=4).collect()
    assert len(got) == len(rows)
    batches: dict = {}
    for r in got:
        assert r["padding"] == r["bound"] - r["length"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    per: dict = {}
    for (bucket, _), rs in batches.items():
        room = 1 if bucket < 0 else max(1, 1000 // max(1, rs[0]["bound"]))
        assert len(rs) <= room and sorted(r["slot"] for r in rs) == list(range(len(rs)))
        per.setdefault(bucket, []).append(len(rs) == room)
    assert all(full.count(False) <= 1 for b, full in per.items())
    assert [r["doc_id"] for r in got if r["bucket"] == -1] == [1000]


def test_long_rows_have_batches_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 4)
    rows = [(1, "w " * 50)] * 2 + [(None, "w " * 50)] * 2 + [(i, "w " * (20 + i)) for i in range(30)] + [(99, "a b")]
    got = packing.pack(frame(spark, rows), budget=10, n_buckets=2).collect()
    assert sorted(r["batch"] for r in got if r["bucket"] == -1) == list(range(34))
    assert all(r["slot"] == 0 and r["padding"] == 0 for r in got if r["bucket"] == -1)
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == len(rows)


# --- tokens ---


def test_token_counts(spark, corpus):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_counts.load(path)
    odd = ["a<|endoftext|>b<|startoftext|>", "İSTANBUL ΣΑΣ straße", "é  \x1c x y", "it's 'Re we'LL", "日本語 漢字 😀👍", "１２ ½ ²", "ﬁ ﬀ", "don’t “quote” — … €5", "<|endoftext", "ŒUVRE Ÿ ǅ"]
    rows = [*corpus, *((700 + i, t) for i, t in enumerate(odd)), (None, "null id"), (2**60 + 1, "large id")]
    got = token_counts.count_tokens(frame(spark, rows), path).collect()
    want = sorted((str(d), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    whole = token_counts.prove_whole(path)
    assert "the" in whole and len(whole) > 30_000


# --- substring dedup ---


def test_fm_index_against_search():
    rng = random.Random(13)
    for _ in range(20):
        parts = [np.array([rng.randrange(4) for _ in range(rng.randint(3, 40))], np.uint64) for _ in range(12)]
        owners = np.array([rng.randrange(6) for _ in parts])
        asked = np.array([rng.randrange(len(parts)) for _ in range(20)])
        limits = owners[asked] + np.array([rng.randrange(2) for _ in asked])
        got = fm_index.matched(parts, owners, 5, asked, limits)
        for i, limit, found in zip(asked, limits, got, strict=True):
            p, want = parts[i], set()
            for s in range(len(p) - 4):
                k = p[s : s + 5].tolist()
                if any(q[j : j + 5].tolist() == k for q, x in zip(parts, owners, strict=True) if x < limit for j in range(len(q) - 4)):
                    want |= set(range(s, s + 5))
            assert {j for a, b in found for j in range(a, b)} == want


def test_least_owner_of_long_ranges():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 3, 40).astype(np.uint64) for _ in range(200)]
    owners = rng.permutation(200)
    index = fm_index.FMIndex(parts, owners)
    n = int(index.first[-1])
    lo = rng.integers(0, n, 500)
    hi = lo + 1 + (rng.random(500) * (n - lo)).astype(np.int64)
    assert index.earliest(lo, hi).tolist() == [index.owner[a:b].min() for a, b in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("most", [2, 256])
def test_substring_dedup(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_AT_ANCHOR", most)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    rows = [*corpus, corpus[0]]
    got = substring_dedup.remove_repeats(frame(spark, [*rows, (None, dict(corpus)[200])])).collect()
    want = brute.without_repeats(corpus, 50)
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]


def test_substring_dedup_goes_by_the_index(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_search", lambda cold, n, window: cold.selectExpr("anchor", "cls", "again as later", "0 as a", "0 as b").where("false"))
    got = substring_dedup.remove_repeats(frame(spark, corpus)).collect()
    assert sum(r["n_removed"] for r in got) == 0


# --- pseudonyms ---


def test_pseudonyms_keep_formats_and_links(spark):
    card, iban = "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00"
    texts = {
        1: f"card {card}, again 4111111111111111; bad 4111111111111112.",
        2: f"iban {iban} and DE89370400440532013000, no: DE88370400440532013000",
        3: "born 1984-02-29, not 1985-02-29; US 02/29/1984 and EU 29.02.1984",
        4: "ssn 123-45-6789 bad 666-45-6789 ip 192.168.0.1 bad 300.1.1.1",
        5: "call +1 (771) 555-1655 or 771-555-1655 or (100) 555-1655",
        6: "mail Jo.Doe+x9@mail3.example.com, and jo@x",
        7: None,
        8: "",
        9: "nothing here 12 345",
    }
    got = {r["doc_id"]: r for r in pii.pseudonyms(frame(spark, list(texts.items())), "k").collect()}
    t = {d: r["safe_text"] for d, r in got.items()}
    a, b = re.findall(r"\d{4}-?\d{4}-?\d{4}-?\d{4}", t[1])[:2]
    assert a.replace("-", "") == b and a.count("-") == 3 and a[0] == "4" and a != card and brute.luhn(b)
    assert t[1].endswith("bad 4111111111111112.")
    x, y = re.findall(r"DE[0-9 ]+\d", t[2])[:2]
    assert x.replace(" ", "") == y != iban.replace(" ", "") and len(x) == len(iban)
    assert int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1 and "DE88370400440532013000" in t[2]
    iso, us, eu = re.search(r"born (\d{4})-(\d\d)-(\d\d)", t[3]), re.search(r"US (\d\d)/(\d\d)/(\d{4})", t[3]), re.search(r"EU (\d\d)\.(\d\d)\.(\d{4})", t[3])
    assert iso.groups() == (us[3], us[1], us[2]) == (eu[3], eu[2], eu[1]) and iso[0] != "born 1984-02-29" and "1985-02-29" in t[3]
    assert "123-45-6789" not in t[4] and "666-45-6789" in t[4] and "192.168.0.1" not in t[4] and "300.1.1.1" in t[4]
    assert re.search(r"ip (\d{1,3}\.){3}\d{1,3} ", t[4])
    p = re.search(r"\+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4})", t[5])
    assert (p[1], p[2]) == (p[3], p[4]) != ("771", "555-1655") and "(100) 555-1655" in t[5]
    assert re.search(r"mail [A-Z][a-z]\.[A-Z][a-z]{2}\+[a-z]\d@mail3\.example\.com", t[6]) and "Jo.Doe+x9" not in t[6] and "jo@x" in t[6]
    assert (t[7], t[8], t[9]) == (None, "", texts[9])
    assert [list(got[i]["found"]) for i in (1, 4, 7)] == [["card", "card"], ["ssn", "ip"], []]
    assert {r["safe_text"] for r in pii.pseudonyms(frame(spark, [(1, texts[1])]), "other key").collect()} != {t[1]}


def test_pseudonyms_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[0-9]' and length(text) < 8000").select("doc_id", "text")
    made = ["born 1/2/1984 or 3.4.1990 or 01/2/1984, 12/11/1850; 31.2.1999", "x@a.b.co.uk. A@b", "josé.garcía@münchen.example.de und " + "q" * 70 + "@long.org, " + "n@" + "l." * 126 + "com", "0.0.0.0 1.2.3.4.5 01.2.3.4 10.1.2.3.4 (1.2.3.4), 1.2.3.4. 10.1.2.34", "ssn 899-99-9999 665-12-3456 667-12-3456 000-11-2222"]
    rng = random.Random(18)
    for _ in range(60):
        n = rng.choice([13, 15, 16, 19])
        body = "".join(rng.choice("0123456789") for _ in range(n - 1))
        card = body + next(c for c in "0123456789" if brute.luhn(body + c))
        made.append(f"{card[:4]} {card[4:]}; +1 {rng.randint(150, 999)}-{rng.randint(150, 999)}-{rng.randint(0, 9999):04} {rng.randint(1, 13)}/{rng.randint(1, 31)}/{rng.randint(1790, 2210)} {rng.randint(0, 300)}.{rng.randint(0, 260)}.1.9 Qx{n}._%{rng.randint(0, 9)}@h-{n}.org")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    rows = pii.pseudonyms(docs, "k").collect()
    assert sum(len(r["found"]) for r in rows) > 200
    for r in rows:
        assert (r["safe_text"], list(r["found"])) == brute.pseudonyms("k", r["text"], pii.PATTERN, pii.PATTERNS)
    safe = {r["text"]: r["safe_text"] for r in rows}[made[0]]
    assert re.fullmatch(r"born \d{1,2}/\d{1,2}/\d{4} or \d{1,2}\.\d{1,2}\.\d{4} or \d\d/\d{1,2}/\d{4}, \d\d/\d\d/\d{4}; 31\.2\.1999", safe) and not re.search(r"[ ./]0\d?[./]", safe.split(" or 0")[0].split(" or ")[0])


def test_no_part_of_an_address_is_left(spark):
    texts = ["josé.garcia@example.com", "q" * 70 + "@x.org", "n@" + "l." * 126 + "com", "10.1.2.3.4", "see 10.1.2.3."]
    got = [r["safe_text"] for r in pii.pseudonyms(frame(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()]
    assert not got[0].startswith("jos") and "garcia" not in got[0] and got[0].endswith("@example.com")
    assert got[1].endswith("@x.org") and "qqqq" not in got[1] and got[2][0] != "n" and got[2][1:] == texts[2][1:]
    assert got[3] == texts[3] and "10.1.2.3" not in got[4] and got[4].endswith(".")


def test_pseudonyms_of_hostile_texts(spark):
    n = 1 << 20
    hostile = ["x@" + "a." * (n // 2) + "com", "a." * (n // 2) + "@", "a" * n + "@b.c", "1" * n, "1-" * (n // 2), "GB12" + " ABCD" * (n // 5), "1." * (n // 2), "1/" * (n // 2), "@" * n, "(" * n, "+1 " * (n // 3)]
    rows = pii.pseudonyms(frame(spark, list(enumerate(hostile))), "k").select("doc_id", F.length("safe_text").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows if r["doc_id"] != 6} == {i: len(t) for i, t in enumerate(hostile) if i != 6}  # 6: addresses, which vary in length


def test_feistel_is_a_permutation(spark):
    df = spark.range(90).select(F.floor(F.col("id") / 9).alias("l"), (F.col("id") % 9).alias("r"))
    got = df.select(pii.feistel("k", F.lit("t"), F.col("l"), F.col("r"), F.lit(10), F.lit(9)).alias("x")).select("x.l", "x.r")
    assert got.distinct().count() == 90 and got.where("l < 0 or l >= 10 or r < 0 or r >= 9").count() == 0
    digits = spark.range(1000).select(pii.permute_digits("k", "t", F.lpad(F.col("id").cast("string"), 3, "0")).alias("d"))
    assert digits.distinct().count() == 1000 and digits.where("length(d) <> 3").count() == 0
    text = spark.range(676).select(pii.permute_text("k", "t", F.concat(F.char(97 + F.floor(F.col("id") / 26)), F.char(97 + F.col("id") % 26))).alias("d"))
    assert text.distinct().count() == 676 and text.where("not d rlike '^[a-z]{2}$'").count() == 0


# --- all ---


CLASHES = ["_row", "_id", "_tie", "_copy", "_nth", "row_key", "copy", "copies", "rows", "at", "all", "starts", "hits", "made", "gone", "kinds", "safe", "rid", "node", "component_id", "n_lines", "text2"]


@pytest.mark.parametrize("name", ["quality", "lines", "near", "prints", "mix", "dedup_lines", "pii"])
def test_clashing_columns_keep_their_values(spark, name):
    rng = random.Random(23)
    rows = [(i, "\n".join(sentence(rng, 20) for _ in range(4)), f"s{i % 3}") for i in range(30)] + [(None, None, None), (31, "", "s1")]
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES], "*")
    run = {
        "quality": quality.quality_stage, "lines": line_dedup.line_dedup_stage, "near": simhash.near_copies_stage, "prints": simhash.near_dedup_stage, "mix": mixing.mix_stage,
        "dedup_lines": line_dedup.dedup_lines, "pii": lambda d: pii.pseudonyms(d, "k"),
    }[name]
    out = run(docs)
    mine = [c for c in CLASHES if not (name == "dedup_lines" and c == "n_lines")]
    assert [c for c in docs.columns if c in mine] == [c for c in out.columns if c in mine]
    got = out.collect()
    assert len(got) > 10
    for r in got:
        assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in mine)
    assert run(docs.where("false")).collect() == []


@pytest.mark.parametrize("name", ["mix", "quality", "simhash", "lines", "lz", "pack", "tokens", "repeats", "pii"])
def test_empty_tables(spark, name):
    import public_tokenizers

    empty = frame(spark, [(1, "x")]).where("false")
    run = {
        "mix": mixing.mix, "quality": quality.quality, "simhash": simhash.near_duplicates, "lines": line_dedup.dedup_lines, "lz": lz_fingerprint.fingerprint_and_edit,
        "pack": packing.pack, "tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")), "repeats": substring_dedup.remove_repeats, "pii": lambda d: pii.pseudonyms(d, "k"),
    }
    assert run[name](empty).collect() == []


# --- rows of one id, pages that repeat their tags ---


def test_packing_deals_rows_of_one_id(spark):
    """A third of the rows has no id, a third the same one; places are whole, and the same whatever the partitions."""
    rng = random.Random(21)
    rows = [(None, "w " * rng.randint(1, 40)) for _ in range(5000)] + [(7, "w " * 12) for _ in range(5000)] + [(100 + i, "w " * rng.randint(1, 60)) for i in range(5000)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    got = packing.pack(docs, budget=400, n_buckets=4).collect()
    assert len(got) == 15_000 and len({(r["bucket"], r["batch"], r["slot"]) for r in got}) == 15_000
    sizes = {}
    for r in got:
        assert r["length"] <= r["bound"] and r["slot"] < 400 // r["bound"]
        sizes.setdefault(r["bucket"], set()).add((r["batch"], r["slot"]))
    for r in got[:4]:
        room = 400 // r["bound"]
        assert sizes[r["bucket"]] == {(i // room, i % room) for i in range(len(sizes[r["bucket"]]))}
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(packing.pack(docs.repartition(7), budget=400, n_buckets=4).collect())


def test_pages_that_repeat_tags_are_read_once(spark):
    hostile = ["<html " * 200_000, "<html" + " " * 500_000 + "lang", "<html " + "lang " * 200_000, '<HTML class="x" LANG = "De-AT"><p>', "<html><html lang=fr>", "<p>"]
    pages = spark.createDataFrame([(i, f"https://h{i}.org", t) for i, t in enumerate(hostile)], "page_id long, url string, html string")
    began = time.time()
    got = [r["declared"] for r in language_id.page_marks(pages).orderBy("page_id").collect()]
    assert got == ["", "", "", "de", "", ""] and time.time() - began < 20
