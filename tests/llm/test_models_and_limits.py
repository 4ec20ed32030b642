"""Models against plain arithmetic; names, nulls and long texts that once crashed or stalled an operator."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from rowtrail.llm import langid, lines, near_dups, rollups, tokenfile, toxicity

# --- language -------------------------------------------------------------------------------------


def plain_identify(rows, model):
    """The posterior of every row by loops: (id, language, confidence, rejected)."""
    n = len(model.languages)
    own, text_logs, known = [], [], []
    for _, text, *_ in rows:
        grams = [g for w in langid.words_of(text or "") for g in langid._grams(w)]
        total = [sum(float(model.logs[g, y]) for g in grams) for y in range(n)]
        logs = [x * min(1.0, langid.TEMPER / len(grams)) for x in total] if grams else [0.0] * n
        p = np.exp(np.array(logs) - max(logs))
        own.append(p / p.sum())
        text_logs.append(logs)
        known.append(bool(grams) and max(total) / len(grams) >= model.least)
    whole = sum((o for o, k in zip(own, known, strict=True) if k), np.zeros(n))
    base = (whole + langid.TABLE_WEIGHT / n) / (whole.sum() + langid.TABLE_WEIGHT)
    out = []
    for at, (i, text, *keys) in enumerate(rows):
        by = []
        for k, key in enumerate(keys):  # declared, suffix, host, domain
            others = [own[j] for j, r in enumerate(rows) if j != at and known[j] and r[2 + k] == key and key is not None]
            by.append(sum(others, np.zeros(n)))
        smooth = lambda s, prior, weight: (s + weight * prior) / (s.sum() + weight)
        host = smooth(by[2], smooth(by[3], base, langid.DOMAIN_WEIGHT), langid.HOST_WEIGHT)
        logs = np.array(text_logs[at]) + np.log(host) + sum(np.log(smooth(s, base, langid.TRUST_WEIGHT) / base) for s in by[:2])
        p = np.exp(logs - logs.max())
        p /= p.sum()
        none = not langid.words_of(text or "")
        rejected = none or not known[at] or p.max() < langid.FLOOR
        out.append((str(i), "und" if rejected else model.languages[int(p.argmax())], round(float(p.max()), 9), rejected))
    return sorted(out)


def test_posterior_by_brute_force(spark):
    rng = random.Random(8)
    words = ["mara", "tiko", "sole", "vint", "zuzu", "12", "!"]
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 3).T + 1e-7)
    model = langid.Model(["aa", "bb", "cc"], logs, float(np.log(1 / langid.BUCKETS)) - 0.6)
    pick = lambda names: rng.choice([*names, None])
    rows = [
        (rng.choice([k, 3, None]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))]), pick(["aa", "xx"]), pick(["aa", "com"]), pick(["h1", "h2", "h3"]), pick(["d1", "d2"]))
        for k in range(120)
    ]
    ev = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string")
    got = sorted((str(r["id"]), r["lang"], round(r["confidence"], 9), r["rejected"]) for r in langid.identify(ev, model).collect())
    want = plain_identify(rows, model)
    assert [(i, y, z) for i, y, _, z in got] == [(i, y, z) for i, y, _, z in want]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, want, strict=True)) < 1e-6


def test_pages_that_never_close_are_read_once():
    began = time.process_time()
    for broken in ("<!--", "<nav ", "<", "<html ", "<script>", "</script"):
        langid.visible(broken * 200_000)
        langid.declared_language(broken * 200_000)
    assert time.process_time() - began < 20
    page = '<HTML class=x lang=pt><head>a</head>b<script>c</SCRIPT >d<nav>e<!-- f --> g <nav> h</nav>i <!-- j'
    assert langid.visible(page).split() == ["b", "d", "i", "<!--", "j"]
    assert langid.declared_language(page) == "pt" and langid.declared_language("<html <html lang=x") == "x" and langid.declared_language("lang=x") is None


def test_hosts_without_names_are_no_shared_evidence(spark):
    urls = ["http://localhost/x", "http://News.Example.com./", "http://10.0.0.7:80/", "http://a.b.co.uk/", "http://x.xn--p1ai/", "http://[::1]:80/", "", None]
    df = spark.createDataFrame([(k, u, "<p>x") for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["id"]: (r["suffix"], r["host"], r["domain"]) for r in langid.page_evidence(df).collect()}
    assert got == {
        0: (None, "localhost", None), 1: ("com", "news.example.com", "example.com"), 2: (None, "10.0.0.7", "10.0.0.7"), 3: ("uk", "a.b.co.uk", "b.co.uk"),
        4: ("xn--p1ai", "x.xn--p1ai", "x.xn--p1ai"), 5: (None, "[::1]", "[::1]"), 6: (None, None, None), 7: (None, None, None),
    }


# --- toxicity -------------------------------------------------------------------------------------


def test_scores_by_a_plain_forward_pass(spark):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 0.2, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), rng.normal(0, 0.5, (toxicity.DIM, 2)).astype(np.float32), np.array([0.3, -0.4]))
    words = ["alpha", "be", "c", "delta-x", "é", "...", "(Gamma)", "x" * 300]
    texts = [None, "", "...", *(" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(60)), "alpha be " * 40_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    for k, text in enumerate(texts):
        means = []
        for word in toxicity.words_of(text or ""):
            bucket, _ = toxicity.grams([word])
            means.append(model.embeddings[bucket].astype(float).mean(0))
        hidden = np.mean(means, 0) * toxicity.SCALE if means else np.zeros(toxicity.DIM)
        logits = hidden @ model.weights.astype(float) + model.bias
        p = np.exp(logits - logits.max())
        assert got[k] == pytest.approx(p[1] / p.sum(), abs=1e-5)


def test_grams_of_a_word_alone_and_among_others():
    words = ["alpha", "be", "c", "é", "x" * 50, "alphabet"]
    bucket, begin = toxicity.grams(words)
    for k, word in enumerate(words):
        alone, _ = toxicity.grams([word])
        end = begin[k + 1] if k + 1 < len(words) else len(bucket)
        assert sorted(bucket[begin[k] : end]) == sorted(alone)
        marked = len(word) + 2
        assert len(alone) == 1 + sum(max(0, marked - n + 1) for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1))


# --- lines, signatures, rollups, token files --------------------------------------------------------


def test_lines_of_tables_with_the_names_used_inside(spark):
    rows = [(1, "a line that stands twice", 5, "i", "l"), (2, "a line that stands twice\nrest", 6, "j", "m"), (None, None, 7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text int, _id string, _lost string")
    got = {r["doc_id"]: (r["text"], r["_text"], r["_id"], r["_lost"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(df).collect()}
    assert got == {1: ("a line that stands twice", 5, "i", "l", 1, 0), 2: ("rest", 6, "j", "m", 2, 1), None: ("", 7, None, None, 1, 0)}


def test_a_large_set_has_the_signature_of_its_parts(monkeypatch):
    sets = [np.sort(np.random.default_rng(k).integers(0, 1 << 63, n).astype(np.uint64)) for k, n in enumerate((3, 900, 1, 250))]
    whole = near_dups.signatures(sets)
    monkeypatch.setattr(near_dups, "SLICE", 100)
    assert (near_dups.signatures(sets) == whole).all()


def test_rollup_in_a_folder_of_its_own(spark, tmp_path):
    change = spark.createDataFrame([(1, "s", "en", "v", 5, "insert", 0)], ", ".join(f"{c} {t}" for c, t in zip(rollups.CHANGES, ["long", "string", "string", "string", "long", "string", "int"], strict=True)))
    first = rollups.TokenRollup(spark, str(tmp_path / "kept"))
    assert first.commit("a", change) and not first.commit("a", change)
    again = rollups.TokenRollup(spark, str(tmp_path / "kept"))
    assert not again.commit("a", change) and [tuple(r) for r in again.totals().collect()] == [("s", "en", "v", 1, 5)]


def test_frequent_words_stay_known(monkeypatch):
    import public_tokenizers

    known, made = tokenfile.WordIds(public_tokenizers.path("word_bpe_49k.json"), "<u2"), defaultdict(int)
    own = known._encoded
    monkeypatch.setattr(known, "_encoded", lambda word: made.__setitem__(word, made[word] + 1) or own(word))
    monkeypatch.setattr(tokenfile, "CACHE", 10)
    for k in range(100):
        assert known[b"hot"] == own(b"hot") and known[b"cold%d" % k] == own(b"cold%d" % k)
    assert made[b"hot"] == 1 and len(known) + len(known.old) <= 21
