"""Packing round trips; the pipeline stage by stage against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import line_dedup, mixing, packing, registry, site_quality

from .test_joins import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packs(rows, texts, tokenizer, capacity=2048):
    """Every id of every document in one piece, sequences gapless and full enough."""
    want = Counter()
    for d, t in texts:
        ids = whole_ids(tokenizer, t)
        want[d, len(ids)] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    assert set(pieces) == set(want)
    ids_of = defaultdict(list)
    for d, t in texts:
        ids = np.array(whole_ids(tokenizer, t), "<u4")
        ids_of[d, len(ids)].append(ids)
    for k, own in pieces.items():
        got = Counter((r["start"], r["length"], r["ids_crc32"]) for r in own)
        starts = sorted({(r["start"], r["length"]) for r in own})
        at = 0
        for s, n in starts:
            assert s == at
            at += n
        assert at == k[1]
        assert got == Counter((s, n, zlib.crc32(ids[s:s + n].tobytes())) for ids in ids_of[k] for s, n in starts)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return seqs


def test_packs_of_fixture(spark, docs, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packs(packing.pack(spark, docs).collect(), texts, tokenizer)
    check_packs(packing.pack(spark, docs, group_tokens=3000).collect(), texts, tokenizer)


def test_odd_texts(spark, tokenizer):
    texts = [(i, t) for i, t in enumerate(["<|startoftext|> a <|endoftext|>b", "it's I'VE 'S ''s can't", "É é ﬁ ΣΑΣ İ", "a b c\u0085d", "x\x1cy\x1f", "12345 ²½ 日本語", "😀!!", "﻿a​b", "A.B,c!?", "ß ſ K Å"])]
    check_packs(packing.pack(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts, tokenizer)


def test_little_padding(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seqs = check_packs(packing.pack(spark, docs).collect(), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], tokenizer)
    assert sum(n for s in seqs.values() for _, n in s) > 0.99 * 2048 * len(seqs)


def test_sequences(spark, docs, tokenizer):
    pieces = packing.pack(spark, docs, with_ids=True)
    got = packing.sequences(pieces).collect()
    real = sum(len(whole_ids(tokenizer, r["text"])) for r in docs.collect())
    for r in got:
        assert len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0
    total = Counter(x for r in got for x in r["ids"])
    want = Counter(x for r in docs.collect() for x in whole_ids(tokenizer, r["text"]))
    assert sum(want.values()) == real
    total.pop(0, None)
    want.pop(0, None)
    assert total == want


def test_cut_lengths():
    for n in [*range(1, 5000), 100_000]:
        cuts = packing.cut_lengths(n, 2048, 128)
        assert sum(cuts) == n and all(2048 // (2048 // c) == c or c < 128 for c in cuts)


def test_first_fit():
    g = np.random.default_rng(0)
    pdf = pd.DataFrame({"length": g.integers(1, 300, 500), "piece": np.arange(500), "grp": 3})
    out = packing.first_fit(pdf, 2048)
    used = out.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) == -(-pdf["length"].sum() // 2048)


def test_packing_empty(spark, empty):
    assert packing.pack(spark, empty).count() == 0


def test_stages(spark, docs, empty, tables, tokenizer):
    d, c = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mix", "pack"]
    stage = dict(corpus_pipeline.STAGES)
    table = lambda df: Counter(map(tuple, df.collect()))
    # quality: the rows of the table that the classifier keeps, as they are
    one = stage["quality"](spark, docs, d).cache()
    assert one.columns == docs.columns and not table(one) - table(docs) and 0 < one.count() < docs.count()
    again = site_quality.classify(spark, docs.select("doc_id", "text", "source", "lang"), spark.read.parquet(f"{d}/labels.parquet")).where("kept")
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == Counter((r["doc_id"], r["text"]) for r in again.collect())
    # lines
    two = stage["lines"](spark, one, d).cache()
    kept = Counter((r["doc_id"], r["kept_text"] if r["text"] is not None else None) for r in line_dedup.drop_repeated_lines(spark, one).collect())
    assert Counter((r["doc_id"], r["text"]) for r in two.collect()) == kept and two.columns == docs.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in two.collect())
    # near duplicates: one document of each group
    three = stage["near_duplicates"](spark, two, d).cache()
    rows = [(r["doc_id"], r["text"]) for r in two.collect() if r["doc_id"] is not None]
    comp = {i: c for i, _, c in brute_components([(i, t) for i, (_, t) in enumerate(rows)], 5, 80, 100)}
    members = defaultdict(list)
    for i, row in enumerate(rows):
        members[comp[i]].append(row)
    got = Counter((r["doc_id"], r["text"]) for r in three.collect())
    for group in members.values():
        kept = sum(min(got[r], group.count(r)) for r in set(group))
        first = [r for r in group if r[0] == min(d for d, _ in group)]
        if any(t and t.split() for _, t in group):      # one row of the group, of its smallest doc_id
            assert kept == 1 and sum(got[r] for r in set(first)) == 1
        else:
            assert kept == len(group)
    got = Counter(r["doc_id"] for r in three.collect())
    assert got[None] == sum(r["doc_id"] is None for r in two.collect()) and not table(three) - table(two)
    # mix
    four = stage["mix"](spark, three, d).cache()
    words = Counter()
    for r in four.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    assert words == Counter({(r["doc_id"], r["source"]): r["n"] for r in mixing.mix(spark, three).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r["n"]})
    assert four.columns == docs.columns
    # pack
    five = stage["pack"](spark, four, d)
    check_packs(five.collect(), [(r["doc_id"], r["text"]) for r in four.collect()], tokenizer)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, d).count() == 0, name


def test_stages_keep_clashing_columns(spark, docs, tables):
    """Columns named like helpers of the stages pass through unchanged."""
    names = ["Kept", "__bins", "__row", "__host", "__path", "__e", "__p", "__h", "__nth", "__doc", "__drops", "N_Lines", "row", "others", "c0", "th", "piece"]
    df = docs.drop("kept").where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    for i, n in enumerate(names):
        df = df.withColumn(n, F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")))
    df = df.cache()
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, df, tables[0])
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes), name
        rows = out.collect()
        assert rows and all(r[n] == f"{i}-{r['doc_id']}" for r in rows for i, n in enumerate(names)), name
    assert corpus_pipeline.pack(spark, df, tables[0]).count() > 0


def test_rows_without_doc_id_spread(spark):
    """Equal rows and the pieces of one text fall into as many groups as their tokens ask for."""
    df = spark.createDataFrame([(None, "one two three four five " * 60)] * 1000 + [(7, "many words " * 20_000)], "doc_id long, text string").repartition(4)
    out = packing.pack(spark, df, group_tokens=50_000).withColumn("grp", F.shiftright("sequence_id", 32)).groupBy("grp").agg(F.sum("length").alias("n")).collect()
    tokens = sum(r["n"] for r in out)
    assert len(out) == -(-tokens // 50_000) and max(r["n"] for r in out) < 2 * 50_000


def test_mixed_rows_keep_their_columns(spark):
    """Rows equal in doc_id, source and text keep their other columns, on every run."""
    rows = [(1, "a", "x y z " * 20, k) for k in range(40)] + [(i, "b", f"w{i} " * 50, 0) for i in range(2, 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, k int")
    runs = [Counter(map(tuple, mixing.mixed_texts(spark, df.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len({r[3] for r in runs[0]}) > 1
    words = Counter()
    for r, n in runs[0].items():
        words[r[0], r[1]] += n * len(r[2].split())
    assert words == Counter({(r["doc_id"], r["source"]): r["n"] for r in mixing.mix(spark, df).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r["n"]})


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_registry():
    names = [n for n in registry.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registry.QUERIES
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_near_duplicates_keep_unique_rows(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (5, c), (5, b), (7, c), (8, ""), (8, None), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert Counter(map(tuple, got.collect())) == Counter([(1, a), (5, b), (5, c), (8, ""), (8, None), (None, a), (None, a)])


def test_pieces_leave_by_slices_of_text(monkeypatch):
    """A Python worker holds the pieces of some texts, not of a whole Arrow batch."""
    from types import SimpleNamespace

    import pyarrow as pa

    kind = SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))
    docs = SimpleNamespace(schema={"doc_id": kind}, select=lambda *c: docs, mapInArrow=lambda f, schema: f)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "TEXT_BYTES", 4000)
    texts = [f"word{i} and others " * 100 for i in range(30)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(packing.piece_table(docs, packing.vocabulary_path(), 2048, 128, 1, True)(iter([batch])))
    assert len(out) >= 10 and max(len(set(b.column("doc_id").to_pylist())) for b in out) <= 4
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["piece"] for r in rows] == list(range(len(rows)))
    assert sorted({r["doc_id"] for r in rows}) == list(range(32))
    assert all(sum(r["length"] for r in rows if r["doc_id"] == d) == next(r["doc_tokens"] for r in rows if r["doc_id"] == d) for d in range(32))
