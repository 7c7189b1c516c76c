"""Gradient-boosted trees over binned rows (M11): the method and parameters of MLlib's ``GBTClassifier`` in one short job per level.

Log loss on labels -1 and 1, regression trees on its negative gradient (variance, all features, at most ``maxBins`` bins, one row
per leaf at least), the first tree at weight 1, the others at ``stepSize``. Unlike MLlib, cuts come from all rows, as the forest's do
(``forest.thresholds_of``).

The binned rows are cached as one block per partition with the margin that the trees so far give them. A level's job sends every
partition the nodes found so far, gets its (count, gradient) sums per node, feature and bin, and the driver picks the splits:
what it holds doesn't grow with the rows. Only the smaller child of a split is counted; the other's sums are what is left of
their parent's. Features share columns of at most 1,024 joint codes, whose sums hold those of each. The margins
are brought up after every tree; a lost block is made again from the rows and the trees.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship
from .forest import ROWS, STEP_VALUES, _chunks, _u8, binned, left_children, matrix, thresholds_of

#: Rows that a chunk of the binned rows holds, and those of a partition at most.
CHUNK_ROWS = 10_000
PART_ROWS = 400_000
#: Trees after which the margins are taken from the rows again, so that their lineage stays short.
RESTART = 25
#: Codes that features share, and partitions whose sums the driver adds by itself.
MOST_CODES = 1_024
FEW_PARTS = 64
#: Decrease of squared error per row below which a split is rounding.
LEAST_GAIN = 1e-12

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]        # feature (-1: leaf), cut, value (of leaves, weighted); nodes level by level


class _Columns:
    """Features packed into columns of joint codes: ``groups`` holds (features, bins of each) per column."""

    def __init__(self, bins: list[int]):
        self.groups: list[tuple[list[int], list[int]]] = []
        size = 0
        for j in sorted((j for j, n in enumerate(bins) if n > 1), key=lambda j: (bins[j], j)):
            if self.groups and size * bins[j] <= MOST_CODES:
                self.groups[-1][0].append(j)
                self.groups[-1][1].append(bins[j])
                size *= bins[j]
            else:
                self.groups.append(([j], [bins[j]]))
                size = bins[j]
        self.sizes = [int(np.prod(b)) for _, b in self.groups]
        #: (column, codes of which a bin is made, bins) of each feature
        self.place = {j: (c, int(np.prod(n[i + 1:])), n[i]) for c, (features, n) in enumerate(self.groups) for i, j in enumerate(features)}
        #: (feature, first, bins) of each feature's sums
        self.slots, first = [], 0
        for features, n in self.groups:
            for j, b in zip(features, n, strict=True):
                self.slots.append((j, first, b))
                first += b
        self.width = first

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(column, row) of bins by feature ``x`` (feature, row)."""
        out = np.zeros((len(self.groups), x.shape[1]), dtype=np.uint16)
        for c, (features, n) in enumerate(self.groups):
            for j, b in zip(features, n, strict=True):
                out[c] *= b
                out[c] += x[j]
        return out

    def walker(self, feature: np.ndarray, cut: np.ndarray) -> Callable:
        """The function of (codes, rows) that gives the node without a split which each of these rows ends at."""
        most, depth, split = max(self.sizes, default=1), depth_of(feature), feature >= 0
        column, right = np.zeros(len(feature), dtype=np.int64), np.zeros((len(feature), most), dtype=np.uint8)
        for v in np.flatnonzero(split):
            c, stride, b = self.place[int(feature[v])]
            column[v], right[v] = c, np.arange(most) // stride % b > cut[v]
        left, right = np.where(split, left_children(feature), np.arange(len(feature))), right.reshape(-1)     # a leaf leads to itself

        def run(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
            first, flat, node = column * codes.shape[1], codes.reshape(-1), np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                at = first.take(node)
                at += rows
                code = flat.take(at)
                np.multiply(node, most, out=at)
                at += code
                node = left.take(node)
                node += right.take(at)
            return node
        return run

    def none(self, n: int) -> list[np.ndarray]:
        """Sums of no rows for ``add``: per column (count or sum of values, node, code)."""
        return [np.zeros((2, n * size)) for size in self.sizes]

    def add(self, sums: list[np.ndarray], codes: np.ndarray, rows: np.ndarray, node: np.ndarray, values: np.ndarray) -> None:
        for c, size in enumerate(self.sizes):
            at = node * size
            at += codes[c].take(rows)
            sums[c][0] += np.bincount(at, minlength=sums[c].shape[1])
            sums[c][1] += np.bincount(at, weights=values, minlength=sums[c].shape[1])

    def by_feature(self, sums: list[np.ndarray], n: int) -> np.ndarray:
        """(count or sum of values, node, bin of a feature)."""
        out, first = np.empty((2, n, self.width)), 0
        for x, (_, bins) in zip(sums, self.groups, strict=True):
            x = x.reshape(2, n, *bins)
            for k, b in enumerate(bins):
                out[:, :, first:first + b] = x.sum(axis=tuple(a for a in range(2, x.ndim) if a != k + 2))
                first += b
        return out


def walked(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node without a split that each row of ``x`` (feature, row) ends at; ``depth``: of the deepest node. A leaf leads to itself."""
    n, flat, split = x.shape[1], x.reshape(-1), feature >= 0
    rows, first = np.arange(n), np.where(split, feature, 0) * n
    left, most = np.where(split, left_children(feature), np.arange(len(feature))), np.where(split, cut, 255).astype(np.uint8)
    node = np.zeros(n, dtype=np.int64)
    for _ in range(depth):
        at = first.take(node)
        at += rows
        right = flat.take(at) > most.take(node)
        node = left.take(node)
        node += right
    return node


def depth_of(feature: np.ndarray) -> int:
    """Depth of the deepest node."""
    depth, n, end = 0, 1, 0
    while n:                                                  # nodes of this level, which end at ``end``
        end += n
        n = 2 * int((feature[end - n:end] >= 0).sum())
        depth += n > 0
    return depth


def margin(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for feature, cut, value in trees:
        out += value.take(walked(x, feature, cut, depth_of(feature)))
    return out


def gradient(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Negative gradient of the log loss 2 log(1 + exp(-2 y margin)), labels -1 and 1."""
    return 4 * y / (1 + np.exp(2 * y * at))


def _blocks(width: int, columns: _Columns) -> Callable:
    """One block of a partition's chunks: joint codes, label, margin of no trees."""
    def run(rows: Iterator) -> Iterator[tuple]:
        held = sorted((r["chunk"], r["n"], r["x"], r["code"]) for r in rows)
        if held:
            x = np.ascontiguousarray(np.concatenate([_u8(b).reshape(n, width) for _, n, b, _ in held]).T)
            y = np.concatenate([_u8(c) for *_, c in held])
            yield columns.codes(x), y * np.int8(2) - np.int8(1), np.zeros(len(y))
    return run


def _advanced(columns: _Columns, trees: list[Tree]) -> Callable:
    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        walks = [(columns.walker(feature, cut), value) for feature, cut, value in trees]
        for codes, y, at in blocks:
            after = at.copy()
            for rows in _steps(len(y)):
                for walk, value in walks:
                    after[rows[0]:rows[-1] + 1] += value.take(walk(codes, rows))
            yield codes, y, after
    return run


def _steps(n: int) -> Iterator[np.ndarray]:
    """The rows of a block, as many at a time as leave numpy's temporary arrays in a core's cache."""
    for i in range(0, n, STEP_VALUES):
        yield np.arange(i, min(i + STEP_VALUES, n))


def _level(blocks: RDD, first: bool, columns: _Columns, feature: np.ndarray, cut: np.ndarray, nodes: list[int]) -> np.ndarray:
    """Sums of all rows per node of ``nodes``, of the tree that grows; the first tree follows the labels."""
    def count(parts: Iterator[tuple]) -> Iterator[np.ndarray]:
        place = np.full(len(feature), -1)
        place[nodes] = np.arange(len(nodes))
        walk, total = columns.walker(feature, cut), columns.none(len(nodes))
        for codes, y, at in parts:
            for rows in _steps(len(y)):
                node = place.take(walk(codes, rows))
                if (node < 0).any():
                    here = np.flatnonzero(node >= 0)
                    rows, node = rows.take(here), node.take(here)
                label = y.take(rows)
                columns.add(total, codes, rows, node, label.astype(float) if first else gradient(label, at.take(rows)))
        yield columns.by_feature(total, len(nodes))

    return blocks.mapPartitions(count).treeReduce(np.add, depth=1 if blocks.getNumPartitions() <= FEW_PARTS else 2)


def node_splits(sums: np.ndarray, columns: _Columns) -> list[tuple]:
    """Per node (feature, cut, gain, (count, sum) left, (count, sum)) of the largest decrease of squared error; gain 0 without one.
    Of equal ones the smallest feature and cut."""
    out = []
    for i in range(sums.shape[1]):
        _, first, bins = columns.slots[0]
        n, s = (float(sums[k, i, first:first + bins].sum()) for k in (0, 1))
        best = (0, 0, 0.0, (0.0, 0.0))
        for j, first, bins in sorted(columns.slots):
            below = sums[:, i, first:first + bins].cumsum(axis=1)[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = below[1] ** 2 / below[0] + (s - below[1]) ** 2 / (n - below[0]) - s * s / n
            gain = np.where((below[0] > 0) & (below[0] < n), gain, 0.0)
            k = int(gain.argmax())
            if gain[k] > max(best[2], LEAST_GAIN * n):
                best = (j, k, float(gain[k]), (float(below[0, k]), float(below[1, k])))
        out.append((*best, (n, s)))
    return out


def grow_tree(level: Callable, columns: _Columns, max_depth: int, weight: float, gains: np.ndarray, whole: tuple[float, float]) -> Tree:
    """One tree, a call of ``level`` per level; ``gains`` per feature are added up. ``whole``: what a tree without features says."""
    feature, cut, stats = [-1], [0], [whole]
    nodes = [0] if columns.slots else []
    asked, others = nodes, []                                  # nodes to be counted, and (node, parent's sums, sibling) of those that follow
    for _ in range(max_depth):
        if not nodes:
            break
        counted = level(np.array(feature), np.array(cut), asked)
        sums = {v: counted[:, i] for i, v in enumerate(asked)}
        sums |= {v: all_ - sums[sibling] for v, all_, sibling in others}
        found = node_splits(np.stack([sums[v] for v in nodes], axis=1), columns)
        children: list[int] = []
        asked, others = [], []
        for v, (j, k, gain, left, all_) in zip(nodes, found, strict=True):
            stats[v] = all_
            if not gain > 0:
                continue
            feature[v], cut[v] = j, k
            gains[j] += gain
            pair = [len(feature), len(feature) + 1]
            for c in (left, (all_[0] - left[0], all_[1] - left[1])):
                feature.append(-1)
                cut.append(0)
                stats.append(c)
            if any(stats[c][0] > 1 for c in pair):             # a node of one row has no cut
                few, many = sorted(pair, key=lambda c: stats[c][0])
                asked.append(few)
                others.append((many, sums[v], few))
                children += [c for c in pair if stats[c][0] > 1]
        nodes = children
    value = np.array([weight * s / n if n else 0.0 for n, s in stats])
    return np.array(feature), np.array(cut), value


class _BoostedParams(HasFeaturesCol, HasLabelCol):
    maxIter = Param(Params._dummy(), "maxIter", "number of trees", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "weight of a tree after the first", typeConverter=TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the deepest leaf", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", typeConverter=TypeConverters.toInt)


class TableBoostedModel(Model, _BoostedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Cuts, trees and importance are parameters: 100 trees of depth 5 have 6,300 nodes at most."""

    trees = Param(Params._dummy(), "trees", "cuts per feature and (feature, cut, value) per tree, as JSON", typeConverter=TypeConverters.toString)
    importance = Param(Params._dummy(), "importance", "share of the decrease of squared error per feature", typeConverter=TypeConverters.toListFloat)

    @property
    def getNumTrees(self) -> int:
        return len(json.loads(self.getOrDefault(self.trees))["trees"])

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.importance))

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        out = df.withColumn("_margin", _scorer(json.loads(self.getOrDefault(self.trees)))(vector_to_array(self.getFeaturesCol())))
        m = F.col("_margin")
        p = 1 / (1 + F.exp(-2 * m))
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-m, m)), "probability": array_to_vector(F.array(1 - p, p)),
                                "prediction": (m > 0).cast("double")}).drop("_margin")


class TableBoosted(Estimator, _BoostedParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", maxIter=100, stepSize=0.1, maxDepth=5, maxBins=32):
        super().__init__()
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=5, maxBins=32)
        self._set(**self._input_kwargs)

    def setMaxIter(self, value: int) -> TableBoosted:
        return self._set(maxIter=value)

    def _fit(self, df: DataFrame) -> TableBoostedModel:
        get = self.getOrDefault
        spark, label = df.sparkSession, F.col(self.getLabelCol()).cast("double")
        ship(spark)
        known = F.when(label.isin(0.0, 1.0), label.cast("int")).otherwise(F.raise_error(F.lit("the boosted trees take labels 0 and 1")).cast("int"))
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("v"), known.alias("code"))
        width = len(rows.head()["v"])
        thresholds = thresholds_of(rows, width, get("maxBins"))
        columns = _Columns([len(t) + 1 for t in thresholds])
        path = scratch_path(spark, "boosted_rows")
        rows.mapInArrow(_chunks(thresholds, CHUNK_ROWS), ROWS).write.parquet(path)
        stored = spark.read.schema(ROWS).parquet(path)
        n = stored.agg(F.sum("n")).head()[0]
        parts = max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))
        blocks = stored.repartition(parts).rdd.mapPartitions(_blocks(width, columns)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n_1 = blocks.map(lambda b: int((b[1] > 0).sum())).sum()
            trees, gains = self._grow(blocks, columns, width, n - n_1, n_1)
        finally:
            blocks.unpersist()
        model = TableBoostedModel()
        model._setDefault(featuresCol="features", labelCol="label")
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), maxIter=get("maxIter"), stepSize=get("stepSize"), maxDepth=get("maxDepth"),
                   maxBins=get("maxBins"), importance=(gains / gains.sum() if gains.sum() > 0 else gains).tolist(),
                   trees=json.dumps({"thresholds": thresholds, "trees": [[a.tolist() for a in t] for t in trees]}))
        return model

    def _grow(self, base: RDD, columns: _Columns, width: int, n_0: int, n_1: int) -> tuple[list[Tree], np.ndarray]:
        get = self.getOrDefault
        trees: list[Tree] = []
        gains, blocks, stale = np.zeros(width), base, base
        try:
            for k in range(get("maxIter")):
                level = lambda f, c, nodes: _level(blocks, k == 0, columns, f, c, nodes)  # noqa: E731, B023
                # of a tree that is one leaf for want of features or depth; all trees before it are so too
                at = np.array([sum(v[0] for *_, v in trees)])
                whole = (n_1 - n_0) if k == 0 else float((n_1 * gradient(1, at) + n_0 * gradient(-1, at))[0])
                trees.append(grow_tree(level, columns, get("maxDepth"), get("stepSize") if k else 1.0, gains, (n_0 + n_1, whole)))
                # the old margins go once a level's job has stored the new ones; those follow from the rows and some trees when a block is lost
                if stale is not base:
                    stale.unpersist()
                stale = blocks
                if k + 1 < get("maxIter"):
                    after = base.mapPartitions(_advanced(columns, trees[:])) if (k + 1) % RESTART == 0 else blocks.mapPartitions(_advanced(columns, trees[-1:]))
                    blocks = after.persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            for old in (stale, blocks):
                if old is not base:
                    old.unpersist()
        return trees, gains


def _scorer(kept: dict):
    thresholds = kept["thresholds"]
    trees = [(np.array(f), np.array(c), np.array(v)) for f, c, v in kept["trees"]]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            yield pa.array(margin(np.ascontiguousarray(binned(matrix(p, len(thresholds)), thresholds).T), trees))
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def node_table(spark: SparkSession, model: TableBoostedModel) -> DataFrame:
    """The nodes, one row each: (tree, node, feature, threshold, left_child, right_child, value). A leaf is its own child."""
    kept = json.loads(model.getOrDefault(model.trees))
    rows = []
    for t, (feature, cut, value) in enumerate(kept["trees"]):
        for i, (f, left) in enumerate(zip(feature, left_children(np.array(feature)).tolist(), strict=True)):
            rows.append((t, i, f, kept["thresholds"][f][cut[i]], left, left + 1, None) if f >= 0 else (t, i, None, None, i, i, value[i]))
    return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left_child int, right_child int, value double")
