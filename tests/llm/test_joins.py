"""Jaccard join, suffix dedup, embedding near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import embedding_dedup, jaccard_join, suffix_dedup
from ledgerlens.llm.common import connected_components
from ledgerlens.llm.textarrays import Texts, shingle_hashes, sorted_unique

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k, num, den):
    u, sets = Union(), [(d, shingles(t, k)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                u.join(a, b)
    return Counter((d, len(s), None if d is None else u.find(d) if s else d) for d, s in sets)


@pytest.mark.parametrize("k, num, den, block", [(4, 85, 100, 512), (5, 80, 100, 512), (4, 85, 100, 3), (2, 50, 100, 2)])
def test_links_equal_brute_force(spark, docs, k, num, den, block):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], k, num, den)
    got = jaccard_join.link_documents(spark, docs, k, num, den, block)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_links_of_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert Counter(tuple(r) for r in jaccard_join.link_documents(spark, docs).collect()) == want


def test_links_empty(spark, empty):
    assert jaccard_join.link_documents(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trie(seed):
    g = random.Random(seed)
    base = [sorted(g.sample(range(80), g.randint(1, 60))) for _ in range(6)]
    sets = []
    for i in range(60):
        s = set(g.choice(base))
        for _ in range(g.randint(0, 6)):
            s ^= {g.randrange(90)}
        sets.append(np.array(sorted(s or {0}), np.int64))
    u = Union()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            n = len(np.intersect1d(x, y))
            if 100 * n >= 80 * (len(x) + len(y) - n):
                u.join(i, j)
    label = jaccard_join.Trie(sets).join(80, 100)
    find = [u.find(i) for i in range(len(sets))]
    assert len(set(zip(label.tolist(), find))) == len(set(label.tolist())) == len(set(find))


def test_components(spark):
    g = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(g.randrange(100, 400), g.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up if x != 7 or True} | {}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, length=100):
    """Rows in order of doc_id (null first), then a hash of the text; later strings lose to earlier ones."""
    seen, out = set(), []
    for d, t, _ in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[2])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_cut_equals_brute_force(spark, docs, tables, hot, monkeypatch):
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    whole = suffix_dedup.drop_repeats
    monkeypatch.setattr(suffix_dedup, "drop_repeats", lambda s, d: whole(s, d, hot=hot))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op7(spark, tables[0]).collect())
    want = brute_cut(rows)
    assert got == want


def test_cut_empty(spark, empty):
    every, cut = suffix_dedup.drop_repeats(spark, empty)
    assert every.count() == 0 and cut.count() == 0


def test_multikey_sort():
    g = random.Random(2)
    data = np.frombuffer("".join(g.choice("ab") for _ in range(3000)).encode() + b"x" * 200, np.uint8)
    starts = np.array([g.randrange(3000) for _ in range(2500)])
    left, group = suffix_dedup.multikey_sort(data, starts, 13)
    raw = data.tobytes()
    want = defaultdict(set)
    for i, s in enumerate(starts.tolist()):
        want[raw[s:s + 13]].add(i)
    got = defaultdict(set)
    for i, k in zip(left.tolist(), group.tolist()):
        got[k].add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_merged():
    doc, start = np.array([2, 1, 1, 1]), np.array([5, 300, 10, 110])
    assert [x.tolist() for x in suffix_dedup.merged(doc, start, 100)] == [[1, 1, 2], [10, 300, 5], [210, 400, 105]]
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in suffix_dedup.merged(none, none, 100))


def test_windows_met_only_by_themselves(spark):
    """A text of one repeated character: windows meet at many suffixes of their own text."""
    docs = spark.createDataFrame([(1, "ab" * 70), (2, "x" * 100), (3, "q" * 101), (4, "ab" * 60 + "c" * 130)], "doc_id long, text string")
    every, cut = suffix_dedup.drop_repeats(spark, docs)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in cut.collect()}
    want = {d: (g, s) for (d, n, g, s, _), c in brute_cut([(r["doc_id"], r["text"], 0) for r in docs.collect()]).items() if g}
    assert got == want and every.count() == 4


def test_sliding():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 8, 61):
        assert (suffix_dedup.sliding(x, w, np.minimum) == [x[i:i + w].min() for i in range(200 - w + 1)]).all()


def test_word_and_shingle_hashes():
    texts = ["Hello  wörld foo\nbar", None, "", " ", "a b", "foo bar foo bar foo bar", "x" * 5, "日本 ß\x0bß"]
    t = Texts.of(pa.array(texts))
    s, e, d = t.words()
    assert [(bytes(t.data[a:b]).decode(), int(k)) for a, b, k in zip(s, e, d)] == [(w, i) for i, x in enumerate(texts) for w in WORD.findall(x or "")]
    h = Texts.span_hash(t.prefix_hash(), s, e)
    assert len(set(h.tolist())) == len({bytes(t.data[a:b]) for a, b in zip(s, e)})
    for k in (1, 2, 4):
        hashes, docs = sorted_unique(*shingle_hashes(h, d, t.n, k))
        assert np.bincount(docs, minlength=t.n).tolist() == [len(shingles(x, k)) if x else 0 for x in [None if x is None else x for x in texts]]


def vectors():
    g = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(250):
            rows.append((i, g.standard_normal(32).tolist(), label))
            i += 1
        center = g.standard_normal(32)
        for s in [0.12] * 120 + [0.27] * 40:
            rows.append((i, (center + s * g.standard_normal(32)).tolist(), label))
            i += 1
        for _ in range(20):
            a = g.standard_normal(32)
            for s in (0, 0.1):
                rows.append((i, (a + s * g.standard_normal(32)).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, [2 * x for x in rows[0][1]], 0), (i + 3, rows[0][1][:16], 0)]
    rows += [(i + 4, None, 0), (i + 5, [0.0] * 32, 0), (i + 6, [float("nan")] + [1.0] * 31, 0), (i + 7, [float("inf")] * 32, 0), (i + 8, [None] + [1.0] * 31, 1), (i + 9, rows[1][1], None), (i + 10, [], 1)]
    rows += [(None, rows[1][1], 0), rows[2], rows[2]]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    ok = [v is not None and lab is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for _, v, lab in rows]
    unit = [np.array(v) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok)]
    n, u = [0] * len(rows), Union()
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                n[a] += 1
                n[b] += 1
                u.join(a, b)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[u.find(i)] = min(low.get(u.find(i), v), v)
    want = Counter((v, n[i], low.get(u.find(i)), v is not None and v == low.get(u.find(i))) for i, (v, _, _) in enumerate(rows))
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark, df).collect())
    found = sum(x[1] * c for x, c in got.items())
    assert found >= 0.99 * sum(n)
    assert all(k in want for k in got) if found == sum(n) else True
    assert sum((got - want).values()) <= 0.01 * len(rows)


def test_vectors_empty(spark):
    assert embedding_dedup.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def families(g, sizes, inside, between, dim=64):
    """Rows of tight families, and no links but ``inside`` and ``between`` them."""
    base, second = np.linalg.qr(g.standard_normal((dim, 2)))[0].T
    c = between / inside
    rows = []
    for center, size in zip((base, c * base + np.sqrt(1 - c * c) * second), sizes):
        e = g.standard_normal((size, dim))
        e -= np.outer(e @ base, base) + np.outer(e @ second, second)
        e /= np.linalg.norm(e, axis=1)[:, None]
        rows += (np.sqrt(inside) * center + np.sqrt(1 - inside) * e).tolist()
    return [(i, v, 0) for i, v in enumerate(rows)]


@pytest.mark.parametrize("size, reach", [(14, 128), (40, 16)])
def test_linked_families(spark, size, reach):
    rows = families(np.random.default_rng(5), (size, size), 0.99, 0.942)
    x = np.array([v for _, v, _ in rows])
    n = (x @ x.T >= 0.93).sum(1) - 1
    assert n.min() == 2 * size - 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark, df, reach=reach).collect())
    assert got == [(i, int(n[i]), 0, i == 0) for i in range(len(rows))]


def test_audit_counts_nodes(spark):
    g = np.random.default_rng(6)
    rows = families(g, (600, 0), 0.99, 0.94)
    for a in g.standard_normal((100, 64)):
        rows += [(len(rows) + k, (a + k * 0.1 * g.standard_normal(64)).tolist(), 0) for k in (0, 1)]
    nodes = [(i, 0, (np.array(v) / np.linalg.norm(v)).tobytes(), 1) for i, v, _ in rows]
    df = spark.createDataFrame(nodes, "node long, label int, unit binary, mult long")
    found = spark.createDataFrame([(i, 599) for i in range(600)], "node long, n long")
    # all links of the large group, none of the pairs
    assert embedding_dedup.audit(spark, df, found, 0.93, 2048) == 0


def test_orders_grow():
    few, many = (embedding_dedup.orders_for(n, 128, 0.93, 12) for n in (1000, 10_000_000))
    assert few == 12 and many > 24


def test_low_recall_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame(families(np.random.default_rng(7), (3, 3), 0.99, 0.5), "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "SEARCHES", 1)
    with pytest.raises(RuntimeError, match="below"):
        embedding_dedup.near_duplicates(spark, df, recall=1.01)


def test_copy_beside_own_text(spark):
    g = random.Random(8)
    a, b = (" ".join(f"{g.getrandbits(40):x}" for _ in range(30)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    every, cut = suffix_dedup.drop_repeats(spark, df)
    assert sorted((r["doc_id"], r["n_bytes"], r["copy"]) for r in every.collect()) == sorted([(1, len(a), False), (5, len(a), True), (5, len(b), False)])
    assert cut.collect() == []
