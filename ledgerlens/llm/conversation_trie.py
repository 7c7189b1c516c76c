"""Operator 12, conversation prefix trie: centroid decomposition of the parent-edge forest.
Components are split recursively at their centroid-to-top paths, component totals are aggregated, and added along these
paths, so that the rollup takes a number of rounds that is logarithmic in the number of turns, however deep the trie.

1. Order: turns are range-partitioned and sorted by conversation and turn; every task numbers its rows and sums a
   polynomial hash of them, and what a task lacks of a conversation that began before is carried over from the
   partitions' ends (one number pair a partition), so no conversation is gathered.
2. Prefixes: the hash of a conversation's first d turns names a node; taking over another conversation's beginning is
   arithmetic on these hashes. Nodes are the groups of equal hashes: smallest member, members, weight. The weight is
   the number of turns of all members from the node on, so a node's weight is the sum over its subtree of members.
3. Decomposition: the component of a top is its subtree. Its centroid is the deepest node whose weight has the same
   power of two as the top's; two children can't both have it, so those nodes form one path from the top to the
   centroid. Taking the path away splits the component into the subtrees that hang from it, each of a smaller power of two,
   which are split in the same way. Nodes learn their path's top by pointer doubling along the path.
4. Rollup: powers of two in ascending order. A path's nodes get the totals of the components hanging from them, then
   sums from the centroid to the top; the top's total is its component's, and goes to the parent.

Defined results: a null conv_id is no conversation; null role and text are empty; turns with an equal number go by the md5
of role and text, and repeated rows are turns of their own; conversations without turns are members of the root; an
empty table has no nodes; other input columns are not read.

Scale: all grouping by prefix has map-side sums, so a first turn that many conversations share is collapsed before the
exchange. Long paths are summed in blocks of ``BLOCK`` nodes. The members that end at a node pass a
task as a sorted stream (a SHA-256 can't be split), never as one list. Equal prefixes are told by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, ship, stored, table
from ledgerlens.llm.textarrays import mix64

HEADS = 9
EVERY = 5
BLOCK = 4096

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)      # odd, so that powers have inverses modulo 2^64
_DEPTH = np.uint64(0x9E3779B97F4A7C15)


def powers(lane: int, e: np.ndarray) -> np.ndarray:
    """The lane's base to each whole number, modulo 2^64."""
    out = np.ones(len(e), np.uint64)
    for sign in (1, -1):
        left, base = np.where(np.sign(e) == sign, np.abs(e), 0), pow(_BASES[lane], sign, 2**64)
        while left.any():
            out = np.where(left & 1, out * np.uint64(base), out)
            left, base = left >> 1, base * base % 2**64
    return out


def longs(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, bytes): x is a 128-bit hash of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    x = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", x.alias("x"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(spark: SparkSession, turns: DataFrame) -> Stored:
    """(conv_id, i, p0, p1, q0, q1, bytes): the turns of each conversation from 1 on, with the hash sums of the first i turns (p) and i - 1 (q)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, count, sums, first = None, 0, [0, 0], None

        def rows(kind: int, conv, i, p, q, size) -> pa.RecordBatch:
            cols = [np.full(len(conv), kind), np.full(len(conv), part), conv, i, *[a.view(np.int64) for a in (*p, *q)], size]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "part", "conv_id", "i", "p0", "p1", "q0", "q1", "bytes"])

        def end(kind: int, conv: int, n: int, s: list[int]) -> pa.RecordBatch:
            one = [np.array([v], np.uint64) for v in s]
            return rows(kind, np.array([conv]), np.array([n]), one, one, np.array([0]))

        for b in batches:
            if not b.num_rows:
                continue
            conv, size = longs(b, "conv_id", "bytes")
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint64).reshape(-1, 2)
            start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            runs = np.diff(np.append(start, len(conv)))
            old = now is not None and conv[0] == now
            if now is not None and not old and first is None:
                first = (now, count, sums)
            i = np.arange(len(conv)) - np.repeat(start, runs) + 1 + np.repeat(np.where(np.arange(len(start)) == 0, count if old else 0, 0), runs)
            p, q = [], []
            for lane in (0, 1):
                c = x[:, lane] * powers(lane, i)
                total = np.cumsum(c)
                base = total[start] - c[start]
                base[:1] -= np.uint64(sums[lane] if old else 0)
                p.append(total - np.repeat(base, runs))
                q.append(p[-1] - c)
            if len(start) > 1 and first is None:
                k = start[1] - 1
                first = (int(conv[0]), int(i[k]), [int(p[0][k]), int(p[1][k])])
            now, count, sums = int(conv[-1]), int(i[-1]), [int(p[0][-1]), int(p[1][-1])]
            yield rows(0, conv, i, p, q, size)
        if now is not None:
            yield end(1, *(first or (now, count, sums)))
            yield end(2, now, count, sums)

    key = ["conv_id", "turn", "x"]
    kept = Stored(spark, turns, "turns")
    dealt = kept.df.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*key, "row").sortWithinPartitions(*key, "row")
    out = Stored(spark, dealt.mapInArrow(run, "kind long, part long, conv_id long, i long, p0 long, p1 long, q0 long, q1 long, bytes long"), "numbered")
    kept.drop()
    ends: dict[int, dict[int, tuple[int, int, list[int]]]] = {}
    # two rows a partition
    for r in out.df.where("kind > 0").collect():
        ends.setdefault(r["part"], {})[r["kind"]] = (r["conv_id"], r["i"], [r["p0"] % 2**64, r["p1"] % 2**64])
    carry: dict[int, tuple[int, int, list[int]]] = {}
    before = None
    for part in sorted(ends):
        first, last = ends[part][1], ends[part][2]
        if before and before[0] == first[0]:
            carry[part] = before
            if first[0] == last[0]:
                last = (last[0], last[1] + before[1], [(before[2][k] + pow(_BASES[k], before[1], 2**64) * last[2][k]) % 2**64 for k in (0, 1)])
        before = last

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv, i, size = longs(b, "part", "conv_id", "i", "bytes")
            cols = {n: longs(b, n)[0].view(np.uint64).copy() for n in ("p0", "p1", "q0", "q1")}
            for k in np.unique(part).tolist():
                if k in carry:
                    at = np.flatnonzero((part == k) & (conv == carry[k][0]))
                    i[at] += carry[k][1]
                    for n, v in cols.items():
                        lane = int(n[1])
                        v[at] = np.uint64(carry[k][2][lane]) + v[at] * np.uint64(pow(_BASES[lane], carry[k][1], 2**64))
            out = [conv, i, *[v.view(np.int64) for v in cols.values()], size]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["conv_id", "i", *cols, "bytes"])

    fixed = Stored(spark, out.df.where("kind = 0").mapInArrow(fix, "conv_id long, i long, p0 long, p1 long, q0 long, q1 long, bytes long"), "fixed")
    out.drop()
    return fixed


def rebuilt(spark: SparkSession, conversations: DataFrame, heads: int = HEADS, every: int = EVERY) -> Stored:
    """(conv_id, d, n, k0, k1, j0, j1, bytes): every turn of every rebuilt conversation, d from 1 to n, with the
    keys of the node it reaches and of that node's parent, and a row of depth 0 for each conversation."""
    rows = numbered(spark, turn_rows(conversations))
    head = F.when(F.col("i") < heads, F.struct("i", "p0", "p1", "q0", "q1", "bytes"))
    per = stored(spark, rows.df.groupBy("conv_id").agg(F.max("i").alias("own"), F.sort_array(F.collect_list(head)).alias("head")), "heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = per.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"), F.col("head").alias("base_head"))
    per = (per.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
           .withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))).cast("int")))
    at = lambda a, k, p: F.coalesce(F.get(a, F.col(k) - 1)[p], F.lit(0))
    per = per.select("conv_id", "h", "taken", "base_head", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"),
                     *[at("head", "h", p).alias("o" + p[1]) for p in ("p0", "p1")], *[at("base_head", "taken", p).alias("b" + p[1]) for p in ("p0", "p1")])
    per = stored(spark, per, "conversations")
    zero = F.lit(0).cast("long")
    nothing = [zero.alias(c) for c in ("shift", "o0", "o1", "b0", "b1")]
    taken = (per.where("taken > 0").select("conv_id", "n", F.explode(F.slice("base_head", F.lit(1), F.col("taken"))).alias("t"))
             .select("conv_id", "n", "t.i", "t.p0", "t.p1", "t.q0", "t.q1", "t.bytes", *nothing))
    own = (rows.df.join(per.drop("base_head"), "conv_id").where("i > h")
           .select("conv_id", "n", "i", "p0", "p1", "q0", "q1", "bytes", (F.col("taken") - F.col("h")).cast("long").alias("shift"), "o0", "o1", "b0", "b1"))
    root = per.select("conv_id", "n", *[zero.alias(c) for c in ("i", "p0", "p1", "q0", "q1", "bytes")], *nothing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, shift = longs(b, "i", "shift")
            d = i + shift
            keys = []
            for prefix, depth in (("p", d), ("q", d - 1)):
                for lane in (0, 1):
                    s, o, at = (longs(b, f"{c}{lane}")[0].view(np.uint64) for c in (prefix, "o", "b"))
                    whole = at + powers(lane, shift) * (s - o)
                    keys.append(mix64(whole ^ mix64(depth.astype(np.uint64) * _DEPTH)).view(np.int64))
            top = pa.array(d == 0)
            parent = [pa.array(k, pa.int64(), mask=d == 0) for k in keys[2:]]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(d, pa.int64()), b.column("n"), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()),
                                              *parent, b.column("bytes"), top], names=["conv_id", "d", "n", "k0", "k1", "j0", "j1", "bytes", "top"])

    names = ["conv_id", "n", "i", "p0", "p1", "q0", "q1", "bytes", "shift", "o0", "o1", "b0", "b1"]
    every_turn = own.select(*names).union(taken.select(*names)).union(root.select(*names)).select(*[F.col(c).cast("long").alias(c) for c in names])
    out = Stored(spark, every_turn.mapInArrow(run, "conv_id long, d long, n long, k0 long, k1 long, j0 long, j1 long, bytes long, top boolean"), "rebuilt")
    rows.drop()
    return out


def trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent, n_convs, bytes, weight, level, plevel, k0, k1, n_children): the nodes; (conv_id, depth) names one,
    (parent, depth - 1) its parent; level and plevel are the powers of two in its weight and its parent's."""
    grouped = turns.groupBy("k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") - F.col("d") + 1).alias("weight"),
        F.min("j0").alias("j0"), F.min("j1").alias("j1"), F.min("bytes").alias("bytes"))
    level = (F.length(F.bin("weight")) - 1).cast("int")
    nodes = stored(spark, grouped.withColumn("level", level), "grouped")
    parents = nodes.select(F.col("k0").alias("j0"), F.col("k1").alias("j1"), F.col("conv_id").alias("parent"), F.col("level").alias("plevel"))
    children = nodes.groupBy("j0", "j1").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"j0": "k0", "j1": "k1"})
    return stored(spark, nodes.join(children, ["k0", "k1"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, ["j0", "j1"], "left"), "trie")


def tops(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, top, top_depth) of the nodes that are not their path's top themselves."""
    on = [F.col("top") == F.col("at"), F.col("top_depth") == F.col("at_depth")]
    left = Stored(spark, nodes.where("plevel = level").select("conv_id", "depth", F.col("parent").alias("top"), (F.col("depth") - 1).alias("top_depth")), "pointers")
    done: list[Stored] = []
    while True:
        # a pointer to a node that has none points to the top; the others take the pointer they meet
        ahead = left.df.select(F.col("conv_id").alias("at"), F.col("depth").alias("at_depth"), F.col("top").alias("next"), F.col("top_depth").alias("next_depth"))
        met = Stored(spark, left.df.join(ahead.unionByName(_settled(spark, done)), on, "left"), "met")
        done.append(Stored(spark, met.df.where("at is null").select("conv_id", "depth", "top", "top_depth"), "settled"))
        more = Stored(spark, met.df.where("at is not null").select("conv_id", "depth", F.col("next").alias("top"), F.col("next_depth").alias("top_depth")), "pointers")
        met.drop()
        left.drop()
        left = more
        if not left.df.limit(1).count():
            return spark.read.schema(done[0].schema).parquet(*[s.path for s in done])


def _settled(spark: SparkSession, done: list[Stored]) -> DataFrame:
    names = ["at long", "at_depth long", "next long", "next_depth long"]
    if not done:
        return spark.createDataFrame([], ", ".join(names))
    return spark.read.schema(done[0].schema).parquet(*[s.path for s in done]).toDF(*[n.split()[0] for n in names])


def rollup(spark: SparkSession, nodes: DataFrame, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, a column for each of ``values``): the sum of each SQL expression over the subtree of every node."""
    names = list(values)
    own = nodes.select("conv_id", "depth", "parent", "level", "plevel", *[F.expr(v).cast("long").alias(k) for k, v in values.items()])
    own = own.join(tops(spark, nodes), ["conv_id", "depth"], "left")
    own = Stored(spark, own.withColumn("is_top", F.col("top").isNull()).withColumn("top_depth", F.coalesce("top_depth", "depth"))
                 .withColumn("top", F.coalesce("top", "conv_id")).sortWithinPartitions("level"), "paths")
    facts = own.df.groupBy("level").agg(F.max(F.col("depth") - F.col("top_depth")).alias("longest")).orderBy("level").collect()     # at most 63 rows
    totals: list[Stored] = []
    ups: list[Stored] = []
    path = ["top", "top_depth"]
    for level, longest in facts:
        cur = own.df.where(F.col("level") == level)
        if ups:
            hung = spark.read.schema(ups[0].schema).parquet(*[u.path for u in ups]).where(F.col("plevel") == level)
            hung = hung.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(n).alias(f"{n}_hung") for n in names])
            cur = cur.join(hung, ["conv_id", "depth"], "left").select(
                "conv_id", "depth", "parent", "plevel", "is_top", *path, *[(F.col(n) + F.coalesce(f"{n}_hung", F.lit(0))).alias(n) for n in names])
        if longest > 0:
            # from the centroid up, inside blocks of depths, then over the path's blocks below
            blocks = F.floor(F.col("depth") / block) if longest > block else F.lit(0)
            cur = cur.withColumn("block", blocks.cast("long"))
            up = Window.partitionBy(*path, "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
            summed = cur.select("*", *[F.sum(n).over(up).alias(f"{n}_sum") for n in names])
            if longest > block:
                under = Window.partitionBy(*path).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
                below = cur.groupBy(*path, "block").agg(*[F.sum(n).alias(n) for n in names])
                below = below.select(*path, "block", *[F.coalesce(F.sum(n).over(under), F.lit(0)).alias(f"{n}_below") for n in names])
                summed = summed.join(below, [*path, "block"]).select("*", *[(F.col(f"{n}_sum") + F.col(f"{n}_below")).alias(f"{n}_all") for n in names])
            else:
                summed = summed.select("*", *[F.col(f"{n}_sum").alias(f"{n}_all") for n in names])
            cur = summed.select("conv_id", "depth", "parent", "plevel", "is_top", *[F.col(f"{n}_all").alias(n) for n in names])
        totals.append(Stored(spark, cur.select("conv_id", "depth", "parent", "plevel", "is_top", *names), "totals"))
        lifted = totals[-1].df.where("is_top and parent is not null").groupBy("parent", (F.col("depth") - 1).alias("at"), "plevel").agg(*[F.sum(n).alias(n) for n in names])
        ups.append(Stored(spark, lifted.sortWithinPartitions("plevel"), "hanging"))
    for s in (own, *ups):
        s.drop()
    if not totals:
        return spark.createDataFrame([], ", ".join(["conv_id long", "depth long", *[f"{n} long" for n in names]]))
    return spark.read.schema(totals[0].schema).parquet(*[t.path for t in totals]).select("conv_id", "depth", *names)


def ends(turns: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256) of the nodes at which conversations end: the hash of their ids in order, comma-joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
            a, b, c = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["k0", "k1", "ends_sha256"])

        for b in batches:
            k0, k1, conv = longs(b, "k0", "k1", "conv_id")
            done = []
            start = np.flatnonzero(np.concatenate(([True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])))) if len(k0) else []
            for a, e in zip(start, [*start[1:], len(k0)]):
                key, text = (int(k0[a]), int(k1[a])), ",".join(map(str, conv[a:e].tolist()))
                if key == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(text.encode())
            if done:
                yield out(done)
        if now is not None:
            yield out([(*now, state.hexdigest())])

    last = turns.where("d = n").select("k0", "k1", "conv_id")
    return last.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "conv_id").mapInArrow(run, "k0 long, k1 long, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, heads: int = HEADS, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    ship(spark)
    turns = rebuilt(spark, conversations, heads, every)
    nodes = trie(spark, turns.df)
    sums = rollup(spark, nodes, {"n_leaves": "case when n_children = 0 then 1 else 0 end", "saved_tokens": "(n_convs - 1) * bytes"}, block)
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends(turns.df), ["k0", "k1"], "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, table(spark, sf_dir, "conversations"))


def op12_sql() -> str:
    """DuckDB's SQL. It has no crc32, so the checksum's table is a recursive rule and the digits are folded one by one."""
    return """
WITH RECURSIVE crc(i, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS own FROM t GROUP BY c),
h(c, s, v) AS (
  SELECT c, c::VARCHAR, 4294967295::BIGINT FROM l
  UNION ALL SELECT c, s[2:], xor(v >> 8, t[xor(v & 255, ascii(s[1]))::INTEGER + 1]) FROM h, tab WHERE s <> ''),
f AS (SELECT l.c, coalesce(b.own[:h], []) || l.own[h + 1:] AS s
      FROM l JOIN (SELECT c, (xor(v, 4294967295) % 9)::INTEGER AS h FROM h WHERE s = '') USING (c) LEFT JOIN l b ON b.c = l.c - l.c % 5),
p AS (SELECT c, d, s[:d] AS prefix, len(s) = d AS stops FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM f)),
n AS (SELECT d, prefix, min(c) AS c, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (stops) AS ends FROM p GROUP BY d, prefix),
m AS (SELECT p.c AS member, p.d, n.c FROM p JOIN n USING (d, prefix)),
k AS (SELECT n.c, n.d, n_convs, ends, (n_convs - 1) * strlen(coalesce(n.prefix[n.d].text, '')) AS saved, m.c AS parent FROM n LEFT JOIN m ON m.member = n.c AND m.d = n.d - 1),
ch AS (SELECT parent AS c, d - 1 AS d, count(*) AS n_children FROM k WHERE parent IS NOT NULL GROUP BY ALL),
w AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (c, d)),
r AS (SELECT m.c, m.d, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM w JOIN m ON m.member = w.c AND m.d <= w.d GROUP BY m.c, m.d)
SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN r USING (c, d)
"""


OP12_SQL = op12_sql()
