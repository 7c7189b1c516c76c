"""Mixing, sharding, line dedup."""

import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup, mixing, sharding

from .conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_equals_sql(spark, tables):
    d, c = tables
    same_rows(mixing.op1(spark, d), c.sql(mixing.op1_sql()))


def test_mix_equals_sql_with_many_shards(spark, docs, tables):
    _, c = tables
    got = mixing.mix(spark, docs, block=4, shard_words=300).select("doc_id", "size", "source_size", "target", "taken", "passes", "span_start", "span_end")
    same_rows(got, c.sql(mixing.op1_sql(4, 300)))


def test_mix_law(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(spark, docs, weights=(5, 2, 1)).collect()
    total = sum(r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 64)
    again = mixing.mix(spark, docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    g = random.Random(seed)
    votes = [(h, p, float(g.choice([0, 1, g.randint(1, 50), g.randint(1, 10_000)]))) for h in range(3) for p in range(g.randint(1, 30))]
    seats = {0: 0, 1: g.randint(1, 10), 2: g.randint(50, 400)}
    df = spark.createDataFrame([(h, p, v, seats[h]) for h, p, v in votes], "h int, p int, v double, seats long")
    got = {(r["h"], r["p"]): r["quota"] for r in mixing.sainte_lague(df, ["h"], "v", "seats", "p").collect()}
    for h in range(3):
        own = {p: v for hh, p, v in votes if hh == h}
        won = Counter()
        heap = [(-v, p, 0) for p, v in own.items() if v]
        heapq.heapify(heap)
        for _ in range(seats[h] if heap else 0):
            _, p, k = heapq.heappop(heap)
            won[p] += 1
            heapq.heappush(heap, (-own[p] / (2 * k + 3), p, k + 1))
        assert {p: got[h, p] for p in own} == {p: won[p] for p in own}


def test_mixed_texts(spark, docs):
    opts = {"block": 4, "shard_words": 300}
    plan = mixing.mix(spark, docs, **opts).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect()
    out = mixing.mixed_texts(spark, docs, **opts)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    assert got == Counter({(r["doc_id"], r["source"]): r["n"] for r in plan if r["n"]})


def test_mix_empty(spark, empty):
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed_texts(spark, empty).count() == 0


def test_mix_many_sources(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(spark, docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(spark, docs).collect()), key=repr) == want


def check_shards(rows, shards, texts=None):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    return [load[s] for s in range(shards)]


def test_shards(spark, docs):
    got = sharding.shard_records(spark, docs).collect()
    assert len(got) == docs.count()
    check_shards(got, 8)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_even_and_groups_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_records(spark, docs, piece_rows=20).collect()
    load = check_shards(got, 8)
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    by = defaultdict(set)
    for r in got:
        by[r["key"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_hot_group_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text in a third of rows")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    load = check_shards(sharding.shard_records(spark, docs).collect(), 8)
    assert max(load) - min(load) <= 0.1 * sum(load) / 8
    same = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("equal").alias("text"))
    load = check_shards(sharding.shard_records(spark, same).collect(), 8)
    assert min(load) > 0


def test_splitters_and_empty(spark, empty, docs, tmp_path):
    assert sharding.shard_records(spark, empty).count() == 0
    bounds = [-50, -3, 0, 7, 7000]
    keys = [-60, -50, -4, -3, 0, 6, 7, 8, 7000, 9000]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.range_of(F.col("k"), bounds).alias("r")).collect()
    assert [r["r"] for r in got] == [sum(b <= k for b in bounds) for k in keys]
    sharding.write_shards(spark, docs.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard", "slot").distinct().count() == docs.count()


def test_lines_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(up)
    rank = lambda d: -(10**9) if d is None else d
    holds = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holds[key(x)].add(rank(d))
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holds[key(x)]) >= 3 and max(holds[key(x)]) > rank(d))]
        want[d, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    out = line_dedup.drop_repeated_lines(spark, docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()) == want
    assert any(k[2] for k in want)


def test_lines_empty(spark, empty):
    assert line_dedup.drop_repeated_lines(spark, empty).count() == 0


def test_line_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    same_rows(line_dedup.op10(spark, d), c.sql(line_dedup.OP10_SQL))


def test_shards_of_rows_without_doc_id(spark):
    """A text that fills more than a shard is cut whatever its doc_ids are."""
    rows = [(None, "the same fifteen")] * 2000 + [(i, f"text number {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    load = check_shards(sharding.shard_records(spark, docs, piece_rows=50).collect(), 8)
    assert max(load) <= 1.02 * min(load)


def test_written_shards_keep_columns_of_equal_rows(spark, tmp_path):
    rows = [(None if i % 2 else 7, "same text", i) for i in range(300)] + [(i, f"t{i}", i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    sharding.write_shards(spark, docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["k"] for r in back) == sorted(r[2] for r in rows) and len({(r["shard"], r["slot"]) for r in back}) == len(rows)


def test_stored_tables_go_with_their_scope(spark):
    import os

    from ledgerlens.llm.common import Stored, stored
    from ledgerlens.session import scratch_scope

    with scratch_scope(spark) as scope:
        t, kept = Stored(spark, spark.range(5).toDF("x"), "scoped"), Stored(spark, spark.range(3).toDF("x"), "kept")
        stored(spark, t.df.where("x > 2"), "scoped")
        paths = list(scope.paths)
        scope.keep(kept.path)
    assert [os.path.exists(p.replace("file:", "")) for p in paths] == [False, True, False]
    assert kept.df.count() == 3
    kept.drop()
