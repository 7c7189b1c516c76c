"""Operator 3, embedding near-dedup: NN-descent. A neighbour graph is refined through
joins of neighbours of neighbours, lists that are full of links are enlarged, recall is
audited against brute force on a sample, and the edges over the threshold are kept.

1. Nodes: equal vectors of a label are one node with a multiplicity. Vectors that are null,
   zero, or hold null or non-finite components, and those without a label, link with nothing.
2. First graph: in each of several seeded orders (``ORDERS``, or more where a label is so large that a pair at the threshold
   would be missed by all of them more often than ``MISS``) by the signs of random projections, every
   node meets the ``REACH`` nodes that follow it and keeps its ``LIST`` best.
3. Rounds: each node's neighbours (its list, and of those that list it as many) meet
   each other; every node keeps the best of what it met, until no list changes. Two nodes linked
   at cosine t to a third are at 2 t^2 - 1 at least, so lists hold nothing below that.
4. Links join nodes to components. A list that links fill up may have lost others, so it is enlarged: inside
   its component the members meet in tiles, which return counts of links, not pairs; for what leaves the component
   the search is made again with lists that hold nodes of other components only, and components that links
   then join are one, until no link leaves a component.
5. Audit: the links of a bounded sample of nodes are counted against all nodes. Where the nodes that have links, or those
   of them with about as many, find less than ``RECALL`` of theirs on average, the search goes on with new orders;
   after ``SEARCHES`` searches that is an error.

Defined results: one row per input row; rows of one vec_id are vectors of their own; a null vec_id
counts as a vector but never names a component; vectors of different lengths don't compare; an empty
table gives an empty table; other input columns are not read.

Scale: orders are range-partitioned and sorted, so that no bucket and no hot group is
ever gathered; lists, tiles and the audit's sample have fixed sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, connected_components, groups, ship, stored, table

THRESHOLD = 0.93
ORDERS = 12
REACH = 128
LIST = 10
TILE = 256
AUDIT = 2048
RECALL = 0.97
SEARCHES = 4
MISS = 0.01
#: Nodes of the audit's sample with about as many links are judged by themselves from so many on.
AUDIT_CLASS = 64
PLANES = 40


def unit_vectors(emb: DataFrame) -> DataFrame:
    """(vec_id, label, node, unit): node is a hash of label and vector, unit the vector
    over its norm in double precision; both null where the vector links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, unit = [], []
            labels = b.column("label").to_pylist()
            for label, vec in zip(labels, b.column("embedding")):
                values = vec.values if vec.is_valid else None
                n = u = None
                if label is not None and values is not None and len(values) and not values.null_count:
                    v = values.to_numpy().astype(np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(v).all() and top > 0:
                        v = v / top
                        u = (v / np.sqrt(v @ v)).tobytes()
                        n = int.from_bytes(hashlib.blake2b(repr(label).encode() + b"|" + values.to_numpy().tobytes(), digest_size=8).digest(), "little", signed=True)
                node.append(n)
                unit.append(u)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(node, pa.int64()), pa.array(unit, pa.binary())], names=["vec_id", "label", "node", "unit"])

    kinds = {f.name: f.dataType.simpleString() for f in emb.schema.fields}
    return emb.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, node long, unit binary")


def planes(order: int, dim: int) -> np.ndarray:
    return np.random.default_rng([7, order, dim]).standard_normal((dim, PLANES))


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in col])


def placed(nodes: DataFrame, orders: range) -> DataFrame:
    """Every node in every order: (grp, code, node, part, unit); grp holds the order, label and length."""
    kept = ["node", "part", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x.as_buffer()) // 8 for x in b.column("unit")])
            label = b.column("label").cast(pa.string()).to_pylist()
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                x = matrix(b.column("unit").take(pa.array(at)))
                for o in orders:
                    code = (x @ planes(o, dim) > 0) @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
                    grp = [f"{o}|{dim}|{label[i]}" for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(code, pa.int64()), *[b.column(c).take(pa.array(at)) for c in kept]], names=["grp", "code", *kept])

    return nodes.select("label", *kept).mapInArrow(run, "grp string, code long, node long, part long, unit binary")


def _best(sims: np.ndarray, keep: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``keep`` highest entries of each row, none below ``floor``."""
    if sims.shape[1] > keep:
        cols = np.argpartition(-sims, keep - 1, 1)[:, :keep]
    else:
        cols = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    rows = np.repeat(np.arange(len(sims)), cols.shape[1])
    cols = cols.reshape(-1)
    ok = sims[rows, cols] >= floor
    return rows[ok], cols[ok]


def orders_for(n: int, reach: int, threshold: float, least: int) -> int:
    """Orders in which a pair at the threshold agrees, but for ``MISS``, at least once on the planes that
    leave ``reach`` of ``n`` nodes."""
    bits = min(max(0.0, math.log2(max(n, 1) / reach)), PLANES)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(least, math.ceil(math.log(MISS) / math.log1p(-meet))) if meet < 1 else least


def first_graph(nodes: DataFrame, orders: range, partitions: int, reach: int, keep: int, floor: float) -> DataFrame:
    """(u, v, sim): each node's best among those of other parts that follow it in each order."""
    def meet(run: pa.Table) -> Iterator[pa.RecordBatch]:
        grp, ids, part = run["grp"].to_pylist(), run["node"].to_numpy(), run["part"].to_numpy()
        edge = [0, *[i for i in range(1, len(grp)) if grp[i] != grp[i - 1]], len(grp)]
        for a, e in zip(edge, edge[1:]):
            x = matrix(run["unit"].slice(a, e - a))
            for i in range(0, e - a, 64):
                rows, cols = slice(i, min(i + 64, e - a)), slice(i, min(i + 64 + reach, e - a))
                sims = x[rows] @ x[cols].T
                gap = np.arange(cols.stop - i)[None] - np.arange(rows.stop - i)[:, None]
                own = part[a:e]
                sims[(gap <= 0) | (gap > reach) | (own[rows][:, None] == own[cols][None])] = -2
                r, c = _best(sims, keep, floor)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + i + r], pa.int64()), pa.array(ids[a + i + c], pa.int64()), pa.array(sims[r, c])], names=["u", "v", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if carry is not None:
                t = pa.concat_tables([carry, t])
            t = t.combine_chunks()
            yield from meet(t)   # the carried rows meet again; equal edges merge below
            carry = t.slice(max(0, t.num_rows - reach))

    return (placed(nodes, orders).repartitionByRange(partitions, "grp", "code", "node").sortWithinPartitions("grp", "code", "node")
            .mapInArrow(run, "u long, v long, sim double"))


def lists(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best neighbours of every node, of edges taken both ways."""
    both = edges.select("u", "v", "sim").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).where("u <> v")
    both = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), F.xxhash64("u", "v"), "v"))
    return both.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def around(graph: DataFrame, keep: int) -> DataFrame:
    """(u, v): each node with itself, its list, and as many that list it."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v", "u"), "v"))
    back = back.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")
    own = graph.select("u", F.col("u").alias("v")).distinct()
    return graph.select("u", "v").union(back).union(own).distinct()


def local_join(graph: DataFrame, nodes: DataFrame, keep: int, floor: float, inside: DataFrame | None = None) -> DataFrame:
    """(u, v, sim) of nodes of different parts that share a neighbour: each node's list, and as many that list it, meet,
    with the same of the lists ``inside`` its part."""
    members = around(graph, keep)
    if inside is not None:
        # only where a list has something to tell
        near = around(inside, keep)
        members = members.union(near.join(members.select("u").distinct(), "u", "left_semi").select("u", "v")).distinct()
    members = members.join(nodes.select(F.col("node").alias("v"), "part", "unit"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "u"):
            if g.num_rows < 3:
                continue
            ids, part, x = g["v"].to_numpy(), g["part"].to_numpy(), matrix(g["unit"])
            sims = x @ x.T
            sims[part[:, None] == part[None]] = -2
            r, c = _best(sims, keep, floor)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(sims[r, c])], names=["u", "v", "sim"])

    return members.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, v long, sim double")


def link_counts(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, n) from (node, component, unit, mult): links of each node inside its component,
    counted tile by tile."""
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).alias("g"))
    m = members.join(size, "component").withColumn("s", F.pmod(F.xxhash64("node"), F.col("g")).cast("long"))
    m = (m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
         .withColumn("tile", F.concat_ws("|", "component", F.least("s", "o"), F.greatest("s", "o"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "tile"):
            s, o, x, mult, ids = t["s"].to_numpy(), t["o"].to_numpy(), matrix(t["unit"]), t["mult"].to_numpy(), t["node"].to_numpy()
            if (s == o).all():
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                n = hit @ mult
            else:
                a, b = np.flatnonzero(s < o), np.flatnonzero(s > o)
                hit = x[a] @ x[b].T >= threshold
                n = np.zeros(len(ids), np.int64)
                n[a], n[b] = hit @ mult[b], hit.T @ mult[a]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    parts = m.select("tile", "node", "s", "o", "unit", "mult").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "node long, n long")
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def audit(spark: SparkSession, nodes: DataFrame, found: DataFrame, threshold: float, sample: int) -> float:
    """The mean share of its true links that a linked node of a bounded sample found, or the lowest such
    mean of the nodes with about as many links (by powers of two)."""
    picked = nodes.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(sample).select("node", "label", "unit").toArrow()
    if not picked.num_rows:
        return 1.0
    ids = picked["node"].to_numpy()
    label = np.array(picked["label"].cast(pa.string()).to_pylist(), object)
    unit = [np.frombuffer(v.as_buffer(), np.float64) for v in picked["unit"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        size = np.array([len(u) for u in unit])
        for b in batches:
            own = np.array(b.column("label").cast(pa.string()).to_pylist(), object)
            dims = np.array([len(v.as_buffer()) // 8 for v in b.column("unit")])
            other, mult = b.column("node").to_numpy(), b.column("mult").to_numpy()
            for d in np.unique(dims).tolist():
                for lab in set(own[dims == d]):
                    s, r = np.flatnonzero((size == d) & (label == lab)), np.flatnonzero((dims == d) & (own == lab))
                    if len(s):
                        hit = (np.stack([unit[i] for i in s]) @ matrix(b.column("unit").take(pa.array(r))).T >= threshold) & (ids[s][:, None] != other[r][None])
                        total[s] += hit @ mult[r]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(total[some], pa.int64())], names=["node", "true"])

    true = nodes.select("node", "label", "unit", "mult").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    got = true.where(F.col("true") > 0).join(found, "node", "left").select(F.floor(F.log2("true")).alias("size"), (F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("share"))
    rows = got.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share")).collect()     # at most 64 rows
    if not rows:
        return 1.0
    return min([sum(r["share"] for r in rows) / sum(r["n"] for r in rows), *[r["share"] / r["n"] for r in rows if r["n"] >= AUDIT_CLASS]])


def refined(spark: SparkSession, graph: DataFrame, nodes: DataFrame, keep: int, floor: float, inside: DataFrame | None = None) -> DataFrame:
    """The lists after rounds that go on until none changes."""
    while True:
        nxt = stored(spark, lists(local_join(graph, nodes, keep, floor, inside).union(graph), keep), "graph")
        changed = nxt.join(graph, ["u", "v"], "left_anti").limit(1).count()
        graph = nxt
        if not changed:
            return graph


def ends_of_links(graph: DataFrame, threshold: float) -> DataFrame:
    return graph.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))


def joined(spark: SparkSession, nodes: DataFrame, graph: DataFrame, links: DataFrame, orders: range, partitions: int, reach: int,
           keep: int, floor: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The links with those that leave the components of full lists, and the components (node, component)."""
    parts = Stored(spark, connected_components(spark, links), "parts").df
    full = ends_of_links(graph, threshold).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= keep)
    if not full.limit(1).count():
        return links, parts
    while True:
        apart = stored(spark, nodes.drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "apart")
        cross = stored(spark, lists(first_graph(apart, orders, partitions, reach, keep, floor), keep), "graph")
        more = ends_of_links(refined(spark, cross, apart, keep, floor, graph), threshold)
        if not more.limit(1).count():
            return links, parts
        links = stored(spark, links.union(more).distinct(), "ends")
        parts = Stored(spark, connected_components(spark, links), "parts").df


def near_duplicates(spark: SparkSession, emb: DataFrame, threshold: float = THRESHOLD, orders: int = ORDERS, keep: int = LIST,
                    reach: int = REACH, recall: float = RECALL) -> DataFrame:
    """One row per row of ``emb``: vec_id, n_links, component_id, kept."""
    ship(spark)
    vectors = stored(spark, unit_vectors(emb), "vectors")
    nodes = stored(spark, vectors.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("low")).withColumn("part", F.col("node")), "nodes")
    n = nodes.count()
    largest = nodes.groupBy("label", F.octet_length("unit")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    orders = orders_for(largest, reach, threshold, orders)
    floor = 2 * threshold ** 2 - 1
    graph = links = None
    for search in range(SEARCHES):
        span, tasks = range(search * orders, (search + 1) * orders), max(1, n * orders // 20_000)
        fresh = first_graph(nodes, span, tasks, reach, keep, floor)
        graph = stored(spark, lists(fresh if graph is None else fresh.union(graph), keep), "graph")
        graph = refined(spark, graph, nodes, keep, floor)
        ends = ends_of_links(graph, threshold)
        links, parts = joined(spark, nodes, graph, ends if links is None else links.union(ends).distinct(), span, tasks, reach, keep, floor, threshold)
        found = stored(spark, link_counts(parts.join(nodes.select("node", "unit", "mult"), "node"), threshold, TILE), "links")
        share = audit(spark, nodes, found, threshold, AUDIT)
        if share >= recall:
            break
    else:
        raise RuntimeError(f"embedding near-dedup found {share:.4f} of the links of audited nodes, below {recall}")
    whole = parts.join(nodes.select("node", "low"), "node")
    low = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    ends = parts.join(low, "component").join(found, "node").select(F.col("node").alias("__n"), "n", "component_id")
    rows = vectors.join(nodes.select(F.col("node").alias("__m"), "mult", "low"), F.col("node") == F.col("__m"), "left").join(ends, F.col("node") == F.col("__n"), "left")
    component = F.coalesce("component_id", "low", "vec_id")
    return rows.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).cast("long").alias("n_links"),
                       component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))
