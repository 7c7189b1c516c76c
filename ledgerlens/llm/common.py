"""Helpers shared by the training-data operators: reading tables, writing
intermediate tables to the shared folder, shipping the package to Python
workers, connected components over an edge table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import ensure_checkpoint_dir, own_scratch
from ledgerlens.session import ship as ship

#: Word separators of every operator here: space and the ASCII controls 9 to 13.
WORD_RE = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session."""
    return ensure_checkpoint_dir(spark).rstrip("/")


class Stored:
    """A written intermediate table. ``drop()`` once nothing reads it any more; the open ``session.scratch_scope`` drops
    it at the latest."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self.spark, self.schema = spark, df.schema
        self.path = own_scratch(f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}")
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lineage cut that outlives executors."""
    return Stored(spark, df, tag).df


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that an operator is about to add (compared as Spark does, by any case)."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def with_fields(df: DataFrame, new: dict[str, str]) -> T.StructType:
    """The schema of ``df`` followed by new fields (name: type)."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` in a sorted partition, whole. Memory holds one batch and one run."""
    carry: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t[key].combine_chunks()
        change = pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False) if len(k) > 1 else np.zeros(0, bool)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(k)]
        for a, e in zip(cuts, cuts[1:]):
            now = k[a].as_py()
            if carry and now != last:
                yield pa.concat_tables(carry).combine_chunks()
                carry = []
            carry.append(t.slice(a, e - a))
            last = now
    if carry:
        yield pa.concat_tables(carry).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows of a sorted partition, each run of equal ``key`` in one of them."""
    parts: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        parts.append(pa.Table.from_batches([b]))
        if sum(p.num_rows for p in parts) < rows:
            continue
        t = pa.concat_tables(parts).combine_chunks()
        k = t[key].combine_chunks()
        change = np.flatnonzero(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        parts = [t.slice(cut)]
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def connected_components(spark: SparkSession, edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b: long): the smallest node
    reachable. Alternating large-star and small-star steps: each round rewrites the edge
    table with map-side combined minima, so the largest star centre is never gathered in a
    task, and rounds grow with the logarithm of the number of nodes."""
    cur = Stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), tag)
    for _ in range(max_rounds):
        e = cur.df
        # large star: each node links its larger neighbours to its smallest neighbour (or itself)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = Stored(spark, large, tag)
        # small star: each node links its smaller neighbours and itself to the smallest of them
        s = large.df
        low = s.groupBy("a").agg(F.min("b").alias("m"))
        joined = s.join(low, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        nxt = Stored(spark, small, tag)
        # a fixed point is a forest of stars: no node is both a centre and a leaf
        # and each leaf has one centre
        n = nxt.df
        leafs = n.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        loose = leafs.where("n > 1").limit(1).count() or n.join(n.select(F.col("a").alias("c")), n.b == F.col("c"), "left_semi").limit(1).count()
        cur.drop()
        large.drop()
        cur = nxt
        if not loose:
            break
    else:
        raise RuntimeError("connected components did not settle")
    e = cur.df
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
