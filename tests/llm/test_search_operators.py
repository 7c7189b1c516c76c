"""Decontamination, conversation trie and hard negatives against DuckDB's SQL and brute force."""

import random

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import conversation_trie, decontamination, hard_negatives

from .conftest import same_rows


def written(spark, folder, name, rows, schema, parts=4):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/{name}.parquet")


def views(folder, *names):
    c = duckdb.connect()
    for n in names:
        c.execute(f"create view {n} as select * from '{folder}/{n}.parquet/*.parquet'")
    return c


# -- operator 11

@pytest.fixture(scope="module")
def benchmark_dir(spark, docs, tmp_path_factory):
    g = random.Random(5)
    texts = [r["text"] for r in docs.collect() if r["text"]]
    words = lambda t: [w for w in t.replace("\n", " ").split(" ") if w]
    items = []
    for i in range(40):
        w = words(g.choice(texts))
        k = g.randint(0, max(0, len(w) - 30))
        cut = w[k:k + g.choice((3, 9, 10, 11, 25, 60))]
        items.append((i if i % 9 else None, " ".join(cut).upper() if i % 3 else "  ".join(cut) + "!", 7, "x", 1))
    items += [(1, None, 0, "", 0), (2, "", 0, "", 0), (3, " ... ", 0, "", 0), (4, "ONE, two-three", 0, "", 0), (4, "one two three", 0, "", 0), (5, "never seen words", 0, "", 0), (6, "x", 0, "", 0), (7, "日本", 0, "", 0)]
    items += [items[12]] * 2
    d = str(tmp_path_factory.mktemp("benchmark"))
    docs.write.parquet(f"{d}/documents.parquet")
    written(spark, d, "benchmark", items, "item_id long, text string, doc_id int, segment string, n int")
    return d


def test_decontamination_sql(spark, benchmark_dir):
    c = views(benchmark_dir, "documents", "benchmark")
    got = decontamination.op11(spark, benchmark_dir)
    same_rows(got, c.sql(decontamination.OP11_SQL))
    assert got.where("contaminated").count() > 10 and got.where("not contaminated").count() > 10


def test_decontamination_blocks_and_segments(spark, docs, empty, benchmark_dir):
    """Small segments and blocks of phrases change nothing; spans and items are those of a plain search."""
    items = spark.read.parquet(f"{benchmark_dir}/benchmark.parquet")
    whole = decontamination.decontaminate(spark, docs, items).collect()
    small = decontamination.decontaminate(spark, docs, items, segment_words=300, block=25).collect()
    key = lambda r: repr((r["doc_id"], r["n_words"], r["n_hit"], r["spans"], r["items"]))
    assert sorted(map(key, whole)) == sorted(map(key, small))
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in whole)
    assert all(a["end"] < b["start"] for r in whole for a, b in zip(r["spans"], r["spans"][1:]))
    assert decontamination.decontaminate(spark, empty, items).count() == 0
    none = decontamination.decontaminate(spark, docs, items.limit(0)).collect()
    assert len(none) == len(whole) and not any(r["n_hit"] or r["items"] for r in none)


def brute_near(tokens, phrase, width):
    out = []
    for s, w in enumerate(tokens):
        span = tokens[s:s + width]
        if w in phrase and all(span.count(x) >= phrase.count(x) for x in phrase):
            out.append(s)
    return out


def test_proximity(spark):
    g = random.Random(11)
    docs = [(i, " ".join(g.choice("abcdefgh") for _ in range(g.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "")]
    tests = [(i, " ".join(g.choice("abcdefghz") for _ in range(g.randint(1, 4)))) for i in range(25)]
    index = decontamination.build(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), segment_words=100)
    asked = decontamination.windows(spark.createDataFrame(tests, "item_id long, text string"), 4).cache()
    names = {r["phrase"]: r["item_id"] for r in asked.collect()}
    text = {i: t.split(" ") for i, t in tests}
    of = {(r["segment"], r["ordinal"]): r["doc_id"] for r in index.documents().collect()}
    tokens = {i: (t or "").split() for i, t in docs}
    for width in (4, 7):
        got = sorted({(of[r["segment"], r["ordinal"]], " ".join(text[names[r["phrase"]]]), r["start"]) for r in index.near(asked, width, block=10).collect()})
        want = sorted({(d, " ".join(p), s) for d, t in tokens.items() for p in text.values() for s in brute_near(t, p, width)})
        assert got == want and got
    exact = sorted({(of[r["segment"], r["ordinal"]], " ".join(text[names[r["phrase"]]]), r["start"]) for r in index.phrases(asked).collect()})
    assert exact == sorted({(d, " ".join(p), s) for d, t in tokens.items() for p in text.values() for s in range(len(t)) if t[s:s + len(p)] == p})


def test_postings_round_trip():
    x = np.concatenate((np.arange(300), 2 ** np.arange(33), 2 ** np.arange(1, 33) - 1))
    data, size = decontamination.to_bytes(x)
    assert (decontamination.from_bytes(data) == x).all() and size.sum() == len(data) and size.max() == 5


# -- operator 12

def conversation_rows():
    g = random.Random(7)
    rows = []
    for c in range(-7, 60):
        if c in (20, 35):
            continue    # beginnings that nobody has
        for t in range(g.randint(1, 12)):
            rows.append((c, t if t != 3 else None, g.choice(("user", "assistant", None)), g.choice(("hi", "Grüße", "", None, "ok then")), 1, "y", 2))
    rows += [(c, t, "user", "hello", 1, "y", 2) for c in range(60, 90) for t in range(6)]            # copies
    rows += [(c, t, "user", f"long {t % 7} {t if c % 3 else 0}", 1, "y", 2) for c in range(90, 94) for t in range(200)]
    rows += [(5, 1, "user", "tie", 1, "y", 2), (5, 1, "user", "tie b", 1, "y", 2), (5, 1, "user", "tie", 1, "y", 2)]
    rows += [(None, 0, "user", "nobody's", 1, "y", 2), (95, None, None, None, None, None, None)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, d int, level string, n int"


@pytest.fixture(scope="module")
def conversations_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("conversations"))
    written(spark, d, "conversations", conversation_rows(), CONVERSATIONS, 6)
    return d


@pytest.mark.parametrize("block", [4096, 4])
def test_conversation_trie_sql(spark, conversations_dir, block):
    c = views(conversations_dir, "conversations")
    got = conversation_trie.prefix_trie(spark, spark.read.parquet(f"{conversations_dir}/conversations.parquet"), block=block)
    same_rows(got, c.sql(conversation_trie.OP12_SQL))


def test_one_conversation_over_many_partitions(spark, tmp_path):
    """A conversation that fills all partitions is numbered and hashed as if it were in one."""
    written(spark, str(tmp_path), "conversations", [(10, t, "user", f"t{t % 50}") for t in range(3000)] + [(11, t, "user", f"t{t % 50}") for t in range(40)] + [(3, 0, "a", "b")],
            "conv_id long, turn long, role string, text string", 8)
    got = conversation_trie.op12(spark, str(tmp_path))
    same_rows(got, views(tmp_path, "conversations").sql(conversation_trie.OP12_SQL))


def test_conversation_trie_empty(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_trie.prefix_trie(spark, none).count() == 0
    assert conversation_trie.prefix_trie(spark, spark.createDataFrame([(None, 1, "a", "b", 1, "c", 1)], CONVERSATIONS)).count() == 0


# -- operator 13

def vector_rows():
    g = np.random.default_rng(3)
    out = []
    for i in range(900):
        v = g.normal(size=8) * g.choice((0.01, 0.2, 1.0, 3.0))
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % 5), "k", 1.0))
    for i in range(900, 960):
        out.append((i, out[i - 600][1] if i % 2 else out[7][1], int(i % 5), "k", 1.0))          # copies
    out += [(100, [0.0] * 8, 1, "k", 1.0), (200, [0.0] * 8, 2, "k", 1.0), (300, [0.5, -0.25], 3, "k", 1.0), (301, [0.5, 0.25], 3, "k", 1.0), (302, [0.5, 0.75], 4, "k", 1.0),
            (1100, [], 1, "k", 1.0), (1101, [], 1, "k", 1.0), (1102, [], 2, "k", 1.0)]
    out += [(400, None, 1, "k", 1.0), (500, [1.0] * 8, None, "k", 1.0), (600, [float("nan")] + [1.0] * 7, 1, "k", 1.0), (700, [None] + [1.0] * 7, 1, "k", 1.0),
            (800, [float("inf")] + [1.0] * 7, 1, "k", 1.0), (None, out[3][1], 2, "k", 1.0), (None, out[4][1], 3, "k", 1.0), (0, out[9][1], 0, "k", 1.0), (0, out[9][1], 0, "k", 1.0)]
    # scores beyond 2^50, exact only as whole numbers
    out += [(1000 + i, [float(3e5 + i), float(2e5 - 3 * i), 1.0], int(i % 3), "k", 1.0) for i in range(30)]
    return out


VECTORS = "vec_id long, embedding array<double>, label int, band string, score double"


@pytest.fixture(scope="module")
def vectors_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("vectors"))
    written(spark, d, "embeddings", vector_rows(), VECTORS, 5)
    return d


def test_hard_negatives_sql(spark, vectors_dir):
    got = hard_negatives.op13(spark, vectors_dir).cache()
    same_rows(got, views(vectors_dir, "embeddings").sql(hard_negatives.OP13_SQL))
    assert got.count() > 100


def test_hard_negatives_blocks_and_buckets(spark, vectors_dir, monkeypatch):
    """Blocks of a few anchors and small buckets find the same rows."""
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    emb = hard_negatives.shifted(spark.read.parquet(f"{vectors_dir}/embeddings.parquet"))
    got = hard_negatives.mine(spark, emb, block_bytes=400)
    same_rows(got, views(vectors_dir, "embeddings").sql(hard_negatives.OP13_SQL))


def test_coordinate_lists_prune(spark):
    """Feasible ranges keep every row over the threshold and leave out most others."""
    g = np.random.default_rng(1)
    x = np.floor(256 * g.normal(size=(2000, 16)))
    x[:40] = np.floor(x[40] * 0.9 + g.normal(size=(40, 16)))
    b = hard_negatives.Bucket(np.arange(2000), np.arange(2000), x)
    unit = x[[40, 41]] / np.linalg.norm(x[[40, 41]], axis=1)[:, None]
    focus = np.argsort(-np.abs(unit), 1)[:, :3]
    for t in (0.95, 0.99):
        for u, c in zip(unit, b.candidates(unit, focus, np.array([t, t]))):
            true = set(np.flatnonzero(b.unit @ u >= t).tolist())
            assert c is not None and true <= set(c.tolist()) and len(c) < 800


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(spark, none).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1, "k", 1.0), (1, [1.0, 2.0], 2, "k", 1.0)], VECTORS)
    assert hard_negatives.mine(spark, alone).count() == 0
