"""Random forest whose nodes are a table (M10): no task holds a whole tree of a large table, the driver holds none.

MLlib's forest keeps every node in the driver and a table of all bins per node in its tasks; trees of depth 30
have nodes in proportion to the rows. This one has the same method and parameters (bootstrap by Poisson(1) counts, gini,
``ceil(sqrt)`` features drawn per node, at most ``maxBins`` bins per feature, one row per leaf at least) and grows in two steps:

* The top. Nodes of more than ``taskRows`` rows are split level by level: tasks count (bin, class) per node and drawn
  feature over their rows, Spark adds the counts up per tree, and a task per tree picks the splits. The driver keeps these top
  nodes only, about 100 trees x rows / ``taskRows``.
* The subtrees. The rows below are dealt by (tree, node), and one task per group of at most ``taskRows`` rows (by
  bootstrap counts) grows the rest and writes it as one row of the node table.

Unlike MLlib, cuts come from all rows: all values of a feature with up to ``maxBins``, else sketched quantiles. Bootstrap counts and
drawn features follow from the seed, the tree and the stored chunk or node, so a repeated task gives the same.

A scoring task bins its rows and goes through the node table subtree by subtree, so it holds one subtree beside its rows.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship

#: Rows that a chunk of the binned table holds.
CHUNK_ROWS = 50_000
#: Nodes that a task draws features for at a time, and those of more than ``SMALL_NODE`` rows that it counts at a time.
NODE_SLICE = 16_384
WIDE_SLICE = 64
#: Values that one step of numpy goes over at most (as 8 bytes each they stay in a core's cache), and levels after which a subtree's rows are laid side by side.
STEP_VALUES = 32_768
ORDER_LEVELS = 4
#: Levels that rows go down a tree before those at its leaves are left behind.
WALK_LEVELS = 4
#: Rows up to which a node's cuts are found by sorting its rows, and from which its counts are taken by itself.
SMALL_NODE, LARGE_NODE = 32, 512
#: Rows up to which a node's rows are sorted by comparators over all nodes at once.
NETWORK = 8
#: Rows that a scoring task takes through the node table at a time.
SCORE_ROWS = 1_000_000
#: Partitions that the subtrees' rows are dealt to at most.
MOST_PARTS = 4_000
#: Gain below which a split is rounding.
LEAST_GAIN = 1e-12
LEAF, BELOW, OPEN = -1, -2, -3        # top nodes: a leaf, a subtree's root, still to be split

ROWS = "chunk long, n int, x binary, code binary"
COUNTS = "tree int, counts binary"
SPLITS = "tree int, node int, feature int, cut int, gain double, left_counts array<double>, all_counts array<double>"
BAGGED = "tree int, root int, n int, x binary, times binary, code binary"
SUBTREES = "tree int, root int, feature binary, cut binary, leaf_values binary, importance array<double>"


# ------------------------------- numpy helpers of the tasks -------------------------------

def matrix(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned(x: np.ndarray, thresholds: list[list[float]]) -> np.ndarray:
    """Per value the number of thresholds below it: it goes left of ``cut`` if that is at most ``cut``."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, t in enumerate(thresholds):
        out[:, j] = np.searchsorted(np.asarray(t), x[:, j], side="left")
    return out


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without a split that each row ends at."""
    node = np.zeros(len(x), dtype=np.int64)
    if not len(feature) or feature[0] < 0:
        return node
    # a word per node, (left child, feature, cut); one without a split leads to itself: no bin is above 255
    split = feature >= 0
    word = np.where(split, left, np.arange(len(feature))).astype(np.int64) << 24
    word |= np.where(split, feature, 0).astype(np.int64) << 8
    word |= np.where(split, cut, 255)
    flat = np.ascontiguousarray(x).reshape(-1)
    for i in range(0, len(x), STEP_VALUES):
        rows = np.arange(i, min(i + STEP_VALUES, len(x)))
        first, w = rows * x.shape[1], np.full(len(rows), word[0])
        while len(rows):
            for _ in range(WALK_LEVELS):
                at = w >> 8
                at &= 0xFFFF
                at += first
                right = flat.take(at) > (w & 0xFF)
                w >>= 24
                w += right
                here, w = w, word.take(w)
            node[rows] = here
            going = np.flatnonzero((w & 0xFF) < 255)
            if len(going) < len(rows):
                rows, first, w = rows.take(going), first.take(going), w.take(going)
    return node


def left_children(feature: np.ndarray) -> np.ndarray:
    """Nodes lie level by level, so the n-th split's children are the nodes 2n + 1 and 2n + 2."""
    return 2 * np.cumsum(feature >= 0) - 1


def histogram(x, rows, node, times, code, drawn, n_bins: int, n_codes: int) -> np.ndarray:
    """Bootstrap counts by (node, drawn feature, bin, class)."""
    n, m = drawn.shape
    cells = n_bins * n_codes
    out = np.zeros(n * m * cells)
    flat, by_feature, kind = x.reshape(-1), np.ascontiguousarray(drawn.T), _cells(cells)
    step = max(STEP_VALUES // m, len(out) // m, 1)
    for i in range(0, len(rows), step):
        r, a = rows[i:i + step], node[i:i + step]
        # (feature, row): what is the same for all features is added along the rows
        at = by_feature.take(a, axis=1)
        at += r * x.shape[1]
        cell = flat.take(at).astype(kind, copy=False)
        cell *= kind(n_codes)
        cell += code.take(r).astype(kind, copy=False)
        np.add(cell, (np.arange(m) * cells)[:, None], out=at)
        at += a * (m * cells)
        out += np.bincount(at.ravel(), weights=np.tile(times.take(r).astype(float), m), minlength=len(out))
    return out.reshape(n, m, n_bins, n_codes)


def _cells(n: int) -> type:
    """The smallest type for numbers below ``n``."""
    return np.uint8 if n <= 256 else np.uint16


def running_sums(counts: np.ndarray) -> np.ndarray:
    """``counts`` summed up along the first axis, in place."""
    for i in range(1, len(counts)):
        counts[i] += counts[i - 1]
    return counts


def first_best(l0, l1, t0, t1, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the largest decrease of gini x weight with its feature and cut; of equal ones the smallest feature, then cut. Weights on the left
    and ``valid`` by (cut, feature, node), ``t0`` and ``t1`` by node."""
    r0, r1 = t0 - l0, t1 - l1
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = _purity(l0, l1)
        kept += _purity(r0, r1)
    kept = np.ascontiguousarray(np.where(valid, kept, -np.inf).transpose(2, 1, 0)).reshape(len(t0), -1)
    at = kept.argmax(1)
    gain = kept[np.arange(len(at)), at] - (t0 * t0 + t1 * t1) / (t0 + t1)
    return np.where(gain > LEAST_GAIN * (t0 + t1), gain, 0.0), *np.divmod(at, len(valid))


def _purity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a * a + b * b) / (a + b), which leaves nothing of ``a`` and ``b``."""
    all_ = a + b
    a *= a
    b *= b
    a += b
    a /= all_
    return a


def best_splits(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node (drawn feature, cut, gain x weight, counts left) of the largest decrease of gini; gain 0 without one.
    ``weights``: (class, label) weight of a row."""
    below = running_sums(counts.transpose(2, 3, 1, 0).copy(order="C"))      # by (bin, class, feature, node)
    total = np.ascontiguousarray(below[-1, :, 0].T)                         # the same for every drawn feature
    below = below[:-1].transpose(1, 0, 2, 3)
    n_left = sum(below[1:], below[0])
    valid = n_left > 0
    valid &= n_left < total.sum(-1)
    t0, t1 = weighed(total, weights)
    l0, l1 = (_by_label(below, weights, y) for y in (0, 1))
    gain, k, cut = first_best(l0, l1, t0, t1, valid)
    return k, cut, gain, below[:, cut, k, np.arange(len(k))].T


def _by_label(counts, weights: np.ndarray, y: int) -> np.ndarray:
    """The weights of a label, of counts by class."""
    own = [c * w for c, w in zip(counts, weights[:, y], strict=True) if w]
    return sum(own[1:], own[0]) if own else np.zeros(counts[0].shape)


def weighed(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of labels 0 and 1."""
    return tuple(sum(counts[..., c] * w for c, w in enumerate(weights[:, y]) if w) + np.zeros(counts.shape[:-1]) for y in (0, 1))


def draw(rng: np.random.Generator, n: int, width: int, m: int) -> np.ndarray:
    return np.sort(rng.random((n, width)).argpartition(m - 1, axis=1)[:, :m], axis=1) if m < width else np.tile(np.arange(width), (n, 1))


def share(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted share of label 1."""
    w0, w1 = weighed(counts, weights)
    return w1 / (w0 + w1)


@functools.cache
def network(n: int) -> list[tuple[int, int]]:
    """Comparators that sort ``n`` values (Batcher's odd-even merge sort)."""
    out, p = [], 1
    while p < n:
        k = p
        while k:
            out += [(a, a + k) for j in range(k % p, n - k, 2 * k) for a in range(j, min(j + k, n - k)) if a // (2 * p) == (a + k) // (2 * p)]
            k //= 2
        p *= 2
    return out


def sorted_splits(x, rows, first, size, times, code, drawn, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` of nodes of few rows, ``rows[first:first + size]``: their rows sorted by bin, without empty bins between."""
    n_codes, most = len(weights), int(size.max())
    i = np.arange(most)[:, None]
    r = rows.take(np.minimum(first + i, first + size - 1))
    # by (row, feature, node): bin, class, count; behind the node's rows the last bin without a count
    key = x.reshape(-1).take((r * x.shape[1])[:, None] + drawn.T).astype(np.uint32)
    key <<= 16
    row = (code.take(r).astype(np.uint32) << 8) | times.take(r)
    if size.min() < most:
        behind = i >= size
        row[behind] = 0
        key |= np.where(behind, np.uint32(0xFFFF0000), np.uint32(0))[:, None]
    key |= row[:, None]
    if most <= NETWORK:
        low = np.empty(key.shape[1:], dtype=np.uint32)
        for a, b in network(most):
            np.minimum(key[a], key[b], out=low)
            np.maximum(key[a], key[b], out=key[b])
            key[a] = low
    else:
        key = key.reshape(most, -1).T.copy(order="C")
        key.sort(axis=-1)
        key = key.T.copy(order="C").reshape(most, -1, len(size))
    bins = key >> 16
    valid = bins[:-1] < bins[1:]
    if size.min() < most:
        valid &= (i[:-1] < size - 1)[:, None]
    times, code = key[:-1] & 0xFF, (key[:-1] & 0xFFFF) >> 8
    counts = [running_sums((times * (code == c)).astype(float)) for c in range(n_codes)]
    all_ = [((row & 0xFF) * ((row >> 8) == c)).sum(0).astype(float) for c in range(n_codes)]
    t0, t1 = (_by_label(all_, weights, y) for y in (0, 1))
    l0, l1 = (_by_label(counts, weights, y) for y in (0, 1))
    gain, k, place = first_best(l0, l1, t0, t1, valid)
    n = np.arange(len(size))
    return k, bins[place, k, n].astype(np.int64), gain, np.stack([c[place, k, n] for c in counts], axis=1)


def large_histogram(x, rows, times, code, drawn, n_bins: int, n_codes: int) -> np.ndarray:
    """``histogram`` of one node of many rows."""
    m, cells = len(drawn), n_bins * n_codes
    out, start, kind = np.zeros(m * cells), (np.arange(m) * cells)[:, None], _cells(cells)
    flat, step = x.reshape(-1), max(STEP_VALUES // m, 1)
    for i in range(0, len(rows), step):
        r = rows[i:i + step]
        cell = flat.take(r * x.shape[1] + drawn[:, None]).astype(kind, copy=False)      # (feature, row)
        cell *= kind(n_codes)
        cell += code.take(r).astype(kind, copy=False)
        out += np.bincount((cell + start).ravel(), weights=np.tile(times.take(r).astype(float), m), minlength=len(out))
    return out.reshape(m, n_bins, n_codes)


def node_splits(x, _columns, rows, first, size, times, code, drawn, weights: np.ndarray, n_bins: int):
    """``best_splits`` of nodes with their rows side by side: node i has ``rows[first[i]:first[i] + size[i]]``. ``_columns`` isn't read."""
    n, n_codes = len(size), len(weights)
    k, cut, gain, left = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros((n, n_codes))

    def put(at: np.ndarray, found: tuple) -> None:
        k[at], cut[at], gain[at], left[at] = found

    small = size <= (SMALL_NODE if n_codes <= 3 else 0)
    low = 1                                                          # a node of one row has no cut
    for high in (2, 3, 4, 6, 8, 12, 16, 24, 32):
        at = np.flatnonzero(small & (size > low) & (size <= high))
        step = max(1, STEP_VALUES // (drawn.shape[1] * high))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            put(part, sorted_splits(x, rows, first[part], size[part], times, code, drawn[part], weights))
        low = high
    wide = np.flatnonzero(~small)
    for i in range(0, len(wide), WIDE_SLICE):
        at = wide[i:i + WIDE_SLICE]
        found = np.empty((len(at), drawn.shape[1], n_bins, n_codes))
        large = size[at] >= LARGE_NODE
        for j in np.flatnonzero(large):
            found[j] = large_histogram(x, rows[first[at[j]]:first[at[j]] + size[at[j]]], times, code, drawn[at[j]], n_bins, n_codes)
        some = at[~large]
        if len(some):
            own = np.repeat(np.arange(len(some)), size[some])
            r = rows[np.arange(len(own)) + np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some])]
            found[~large] = histogram(x, r, own, times, code, drawn[some], n_bins, n_codes)
        put(at, best_splits(found, weights))
    return k, cut, gain, left


def grow(x, times, code, weights, depth: int, max_depth: int, m: int, n_bins: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, leaf values, importance) of the subtree over these rows, whose root lies at ``depth``."""
    n_codes, width = len(weights), x.shape[1]
    importance = np.zeros(width)
    features, cuts, values = [], [], []
    rows, size = np.arange(len(x)), np.array([len(x)])              # rows lie node by node
    counts = np.bincount(code, weights=times, minlength=n_codes)[None, :].astype(float)
    level = 0
    while len(counts):
        level += 1
        if level >= ORDER_LEVELS:
            # a node's rows are put side by side
            x, times, code, rows, level = x.take(rows, axis=0), times.take(rows), code.take(rows), np.arange(len(rows)), 0
        feature, cut = np.full(len(counts), LEAF, dtype=np.int16), np.zeros(len(counts), dtype=np.uint8)
        left_counts = np.zeros_like(counts)
        mixed = ((counts @ weights) > 0).all(-1) if depth < max_depth else np.zeros(len(counts), dtype=bool)
        todo = np.flatnonzero(mixed)
        first = np.cumsum(size) - size
        for i in range(0, len(todo), NODE_SLICE):
            part = todo[i:i + NODE_SLICE]
            drawn = draw(rng, len(part), width, m)
            k, c, gain, left = node_splits(x, None, rows, first[part], size[part], times, code, drawn, weights, n_bins)
            ok = gain > 0
            f = drawn[np.arange(len(part)), k]
            feature[part[ok]], cut[part[ok]], left_counts[part[ok]] = f[ok], c[ok], left[ok]
            np.add.at(importance, f[ok], gain[ok])
        split = feature >= 0
        features.append(feature)
        cuts.append(cut)
        values.append(share(counts[~split], weights))
        rows, size = rows[np.repeat(split, size)], size[split]
        own = np.repeat(np.arange(len(size)), size)
        at = rows * width
        at += feature[split].astype(np.int64).take(own)
        right = x.reshape(-1).take(at) > cut[split].take(own)
        # each node's rows, those that go left before the others
        n_right = np.add.reduceat(right, np.cumsum(size) - size, dtype=np.int64) if len(size) else size
        dealt, n_left = np.empty_like(rows), size - n_right
        for goes, n, before in ((~right, n_left, np.cumsum(n_right) - n_right), (right, n_right, np.cumsum(n_left))):
            to = np.repeat(before, n)
            to += np.arange(len(to))
            dealt[to] = rows.take(np.flatnonzero(goes))
        rows, size = dealt, np.stack([n_left, n_right], axis=1).reshape(-1)
        counts = np.stack([left_counts[split], counts[split] - left_counts[split]], axis=1).reshape(-1, n_codes)
        depth += 1
    # the leaves' values in the order of their nodes
    return np.concatenate(features), np.concatenate(cuts), np.concatenate(values), importance


class _Bits:
    """Rows as bytes for the shuffle: features of two bins take a bit."""

    def __init__(self, thresholds: list[list[float]]):
        n = np.array([len(t) for t in thresholds])
        self.one, self.many, self.width = np.flatnonzero(n == 1), np.flatnonzero(n > 1), len(n)

    def pack(self, x: np.ndarray) -> bytes:
        return np.hstack([np.packbits(x[:, self.one], axis=1), x[:, self.many]]).tobytes()

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        b = -(-len(self.one) // 8)
        raw = np.frombuffer(blob, dtype=np.uint8).reshape(n, b + len(self.many))
        out = np.zeros((n, self.width), dtype=np.uint8)
        out[:, self.one] = np.unpackbits(raw[:, :b], axis=1)[:, :len(self.one)]
        out[:, self.many] = raw[:, b:]
        return out


def _u8(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint8)


def _batch(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], list(schema))


_ARROW = {"tree": pa.int32(), "root": pa.int32(), "n": pa.int32(), "chunk": pa.int64(), "x": pa.binary(), "code": pa.binary(), "times": pa.binary(),
          "counts": pa.binary(), "node": pa.int32(), "feature": pa.int32(), "cut": pa.int32(), "gain": pa.float64(), "left_counts": pa.list_(pa.float64()),
          "all_counts": pa.list_(pa.float64())}


def _as(ddl: str) -> dict:
    return {c: _ARROW[c] for c in (p.split()[0] for p in ddl.split(", "))}


# ------------------------------- the Spark steps -------------------------------

def thresholds_of(rows: DataFrame, width: int, max_bins: int) -> list[list[float]]:
    """Cuts per slot of the vector ``v``: midpoints of all its values if there are at most ``max_bins``, else quantiles."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * width
        for b in batches:
            x = matrix(b.column("v"), width)
            for j in range(width):
                if seen[j] is not None:
                    u = np.union1d(seen[j], x[:, j])
                    seen[j] = u if len(u) <= max_bins else None
        flat = [(j, v) for j, u in enumerate(seen) for v in ([None] if u is None else u.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in flat], pa.int32()), pa.array([v for _, v in flat], pa.float64())], ["slot", "value"])

    found = rows.select("v").mapInArrow(values, "slot int, value double").distinct()
    several = found.groupBy("slot").agg(F.bool_or(F.col("value").isNull()).alias("many"), F.count("value").alias("n"))
    few = several.where(~F.col("many") & (F.col("n") <= max_bins)).select("slot")
    out: list[list[float]] = [[] for _ in range(width)]
    done = {r["slot"] for r in few.collect()}                    # one row per slot
    for r in found.join(F.broadcast(few), "slot").groupBy("slot").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
        u = np.array(r["v"])
        out[r["slot"]] = [float(t) for t in (u[:-1] + u[1:]) / 2]
    rest = [j for j in range(width) if j not in done]
    if rest:
        probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        row = rows.agg(*[F.percentile_approx(F.get("v", F.lit(j)), probs, F.lit(10_000)).alias(f"q{j}") for j in rest],
                       *[F.max(F.get("v", F.lit(j))).alias(f"m{j}") for j in rest]).head()
        for j in rest:
            out[j] = sorted({float(t) for t in row[f"q{j}"]} - {float(row[f"m{j}"])})
    return out


def _chunks(thresholds: list[list[float]], most: int = CHUNK_ROWS) -> Callable:
    width = len(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out(k: int) -> pa.RecordBatch:
            x, code = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return _batch(_as(ROWS), [(first + k, len(x), x.tobytes(), code.tobytes())])

        k = 0
        for b in batches:
            held.append((binned(matrix(b.column("v"), width), thresholds), b.column("code").to_numpy(zero_copy_only=False).astype(np.uint8)))
            n += b.num_rows
            if n >= most:
                yield out(k)
                k, held, n = k + 1, [], 0
        if n:
            yield out(k)
    return run


def _bag(seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    return np.minimum(np.random.default_rng((seed, tree, chunk)).poisson(1.0, n), 255).astype(np.uint8)


def _stored(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("chunk")[i].as_py(), _u8(b.column("x")[i].as_buffer()).reshape(-1, width), _u8(b.column("code")[i].as_buffer())


class _Top:
    """Top nodes of one tree as arrays."""

    def __init__(self, state: int):
        self.feature, self.cut, self.left, self.depth, self.value = [state], [0], [0], [0], [0.0]

    def add(self, state: int, depth: int, value: float) -> None:
        for a, v in ((self.feature, state), (self.cut, 0), (self.left, 0), (self.depth, depth), (self.value, value)):
            a.append(v)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def at(self, state: int) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f == state]


def _drawn(seed: int, tree: int, nodes: list[int], width: int, m: int) -> np.ndarray:
    return np.concatenate([draw(np.random.default_rng((seed, tree, v, 1)), 1, width, m) for v in nodes])


def _level(stored: DataFrame, tops: list[_Top], seed: int, width: int, m: int, n_bins: int, weights: np.ndarray) -> list:
    """The splits of all open top nodes, one row each."""
    work = {t: (top.arrays(), top.at(OPEN)) for t, top in enumerate(tops) if top.at(OPEN)}
    n_codes = len(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for chunk, x, code in _stored(batches, width):
            for t, ((feature, cut, left), nodes) in work.items():
                place = np.full(len(feature), -1)
                place[nodes] = np.arange(len(nodes))
                times, at = _bag(seed, t, chunk, len(x)), place[walk(x, feature, cut, left)]
                rows = np.flatnonzero((times > 0) & (at >= 0))
                h = histogram(x, rows, at[rows], times, code, _drawn(seed, t, nodes, width, m), n_bins, n_codes)
                sums[t] = sums[t] + h if t in sums else h
        for t, h in sums.items():
            yield _batch(_as(COUNTS), [(t, h.tobytes())])

    def pick(key: tuple, parts: pa.Table) -> pa.Table:
        t = key[0].as_py()
        nodes = work[t][1]
        total = sum(np.frombuffer(b.as_buffer(), dtype=float) for b in parts.column("counts")).reshape(len(nodes), m, n_bins, n_codes)
        k, cut, gain, left = best_splits(total, weights)
        f = _drawn(seed, t, nodes, width, m)[np.arange(len(nodes)), k]
        rows = [(t, v, int(f[i]), int(cut[i]), float(gain[i]), left[i].tolist(), total[i, 0].sum(0).tolist()) for i, v in enumerate(nodes)]
        return pa.Table.from_batches([_batch(_as(SPLITS), rows)])

    return stored.mapInArrow(count, COUNTS).groupBy("tree").applyInArrow(pick, SPLITS).collect()


def grow_top(stored: DataFrame, n_rows: int, n_trees: int, seed: int, width: int, m: int, n_bins: int, weights: np.ndarray,
             max_depth: int, task_rows: int) -> tuple[list[_Top], np.ndarray]:
    """Top nodes of every tree down to nodes of at most ``task_rows`` rows, and (tree, feature) gains."""
    tops = [_Top(OPEN if n_rows > task_rows and max_depth > 0 else BELOW) for _ in range(n_trees)]
    gains = np.zeros((n_trees, width))
    while any(top.at(OPEN) for top in tops):
        for r in sorted(_level(stored, tops, seed, width, m, n_bins, weights), key=lambda r: (r["tree"], r["node"])):
            top, v = tops[r["tree"]], r["node"]
            counts, left = np.array(r["all_counts"]), np.array(r["left_counts"])
            depth = top.depth[v] + 1
            if not r["gain"] > 0:
                top.feature[v], top.value[v] = LEAF, float(share(counts, weights))
                continue
            gains[r["tree"], r["feature"]] += r["gain"]
            top.feature[v], top.cut[v], top.left[v] = r["feature"], r["cut"], len(top.feature)
            for c in (left, counts - left):
                leaf = depth >= max_depth or not ((c @ weights) > 0).all()
                top.add(LEAF if leaf else OPEN if c.sum() > task_rows else BELOW, depth, float(share(c, weights)))
    return tops, gains


def grow_subtrees(stored: DataFrame, tops: list[_Top], seed: int, thresholds: list[list[float]], m: int, n_bins: int, weights: np.ndarray,
                  max_depth: int) -> DataFrame:
    """One row per subtree below the top nodes."""
    width, bits = len(thresholds), _Bits(thresholds)
    work = {t: (top.arrays(), top.at(BELOW)) for t, top in enumerate(tops) if top.at(BELOW)}
    depths = {(t, v): tops[t].depth[v] for t, (_, roots) in work.items() for v in roots}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, x, code in _stored(batches, width):
            for t, ((feature, cut, left), roots) in work.items():
                times, at = _bag(seed, t, chunk, len(x)), walk(x, feature, cut, left)
                rows = np.flatnonzero((times > 0) & (feature[at] == BELOW))
                rows = rows[np.argsort(at[rows], kind="stable")]
                ends = np.searchsorted(at[rows], roots, side="right")
                out = [(t, v, len(r), bits.pack(x[r]), times[r].tobytes(), code[r].tobytes())
                       for v, r in zip(roots, np.split(rows, ends[:-1]), strict=True) if len(r)]
                if out:
                    yield _batch(_as(BAGGED), out)

    def subtree(key: tuple, parts: pa.Table) -> pa.Table:
        t, v = key[0].as_py(), key[1].as_py()
        # neither the draws nor the sums of counts depend on the parts' order
        x = np.concatenate([bits.unpack(b.as_buffer(), n.as_py()) for b, n in zip(parts.column("x"), parts.column("n"), strict=True)])
        times, code = (np.concatenate([_u8(b.as_buffer()) for b in parts.column(c)]) for c in ("times", "code"))
        feature, cut, values, importance = grow(x, times, code, weights, depths[t, v], max_depth, m, n_bins, np.random.default_rng((seed, t, v, 2)))
        return pa.table({"tree": pa.array([t], pa.int32()), "root": pa.array([v], pa.int32()), "feature": pa.array([feature.tobytes()], pa.binary()),
                         "cut": pa.array([cut.tobytes()], pa.binary()), "leaf_values": pa.array([values.tobytes()], pa.binary()),
                         "importance": pa.array([importance.tolist()], pa.list_(pa.float64()))})

    # about as many partitions as subtrees: they differ in size
    n = max(1, min(len(depths), MOST_PARTS))
    return stored.mapInArrow(deal, BAGGED).repartition(n, "tree", "root").groupBy("tree", "root").applyInArrow(subtree, SUBTREES)


# ------------------------------- estimator and model -------------------------------

class _ForestParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of the deepest leaf", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", typeConverter=TypeConverters.toInt)
    taskRows = Param(Params._dummy(), "taskRows", "rows that one task grows a subtree of", typeConverter=TypeConverters.toInt)


class TableForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Top nodes, cuts and importance are parameters; the subtrees are a table at ``nodes``, which a saved model brings along."""

    nodes = Param(Params._dummy(), "nodes", "path of the table of subtrees", typeConverter=TypeConverters.toString)
    top = Param(Params._dummy(), "top", "cuts per feature and top nodes per tree, as JSON", typeConverter=TypeConverters.toString)
    importance = Param(Params._dummy(), "importance", "share of the decrease of gini per feature", typeConverter=TypeConverters.toListFloat)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.importance))

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        p = _scorer(json.loads(self.getOrDefault(self.top)), node_files(df, self.getOrDefault(self.nodes)))
        n = float(self.getNumTrees)
        out = df.withColumn("_forest_p", p(vector_to_array(self.getFeaturesCol())))
        share_1 = F.col("_forest_p")
        return out.withColumns({"rawPrediction": array_to_vector(F.array((1 - share_1) * n, share_1 * n)),
                                "probability": array_to_vector(F.array(1 - share_1, share_1)),
                                "prediction": (share_1 > 0.5).cast("double")}).drop("_forest_p")

    def write(self) -> DefaultParamsWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _ForestReader(cls)


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        spark = self.sparkSession
        spark.read.schema(SUBTREES).parquet(self.instance.getOrDefault("nodes")).write.partitionBy("tree").parquet(f"{path}/nodes")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> TableForestModel:
        return super().load(path)._set(nodes=f"{path}/nodes")


class TableForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", weightCol=None, numTrees=100, maxDepth=30, maxBins=32, seed=42, taskRows=400_000):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, maxBins=32, seed=42, taskRows=400_000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setNumTrees(self, value: int) -> TableForest:
        return self._set(numTrees=value)

    def _fit(self, df: DataFrame) -> TableForestModel:
        get = self.getOrDefault
        spark, label = df.sparkSession, F.col(self.getLabelCol()).cast("double")
        ship(spark)
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("v"), label.alias("y"), weight.alias("w"))
        kinds = sorted((r["y"], r["w"], r["n"]) for r in rows.groupBy("y", "w").agg(F.count(F.lit(1)).alias("n")).limit(257).collect())
        if not kinds or len(kinds) > 256 or any(y not in (0.0, 1.0) for y, _, _ in kinds):
            raise ValueError("the forest takes rows of labels 0 and 1 whose weight is that of a class")
        weights = np.array([[w if y == c else 0.0 for c in (0.0, 1.0)] for y, w, _ in kinds])
        code = F.coalesce(*[F.when((F.col("y") == y) & (F.col("w") == w), F.lit(i)) for i, (y, w, _) in enumerate(kinds)])
        width = len(rows.head()["v"])
        thresholds = thresholds_of(rows, width, get("maxBins"))
        n_bins = max(2, *[len(t) + 1 for t in thresholds])
        m = int(np.ceil(np.sqrt(width)))
        path = scratch_path(spark, "forest_rows")
        rows.select("v", code.cast("int").alias("code")).mapInArrow(_chunks(thresholds), ROWS).write.parquet(path)
        # a chunk is a row of some MB: files are split by chunks
        stored = spark.read.schema(ROWS).parquet(path)
        stored = stored.repartition(max(stored.rdd.getNumPartitions(), -(-sum(n for _, _, n in kinds) // CHUNK_ROWS)))
        tops, gains = grow_top(stored, sum(n for _, _, n in kinds), get("numTrees"), get("seed"), width, m, n_bins, weights, get("maxDepth"), get("taskRows"))
        nodes = scratch_path(spark, "forest_nodes")
        grow_subtrees(stored, tops, get("seed"), thresholds, m, n_bins, weights, get("maxDepth")).write.partitionBy("tree").parquet(nodes)
        sums = spark.read.schema(SUBTREES).parquet(nodes).select("tree", F.posexplode("importance").alias("slot", "gain")).groupBy("tree", "slot").agg(
            F.sum("gain").alias("gain"))
        grown = sums.collect()                                   # trees x features
        for r in grown:
            gains[r["tree"], r["slot"]] += r["gain"]
        for t in set(range(len(tops))) - {r["tree"] for r in grown}:
            if tops[t].feature == [BELOW]:                       # a bootstrap of few rows may hold none
                tops[t].feature, tops[t].value = [LEAF], [float(share(np.array([n for _, _, n in kinds], dtype=float), weights))]
        per_tree = gains / np.maximum(gains.sum(1, keepdims=True), np.finfo(float).tiny)
        total = per_tree.sum(0)
        top = {"thresholds": thresholds, "depth": get("maxDepth"), "trees": [[x.feature, x.cut, x.left, x.value] for x in tops]}
        model = TableForestModel()
        model._setDefault(featuresCol="features", labelCol="label")
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), numTrees=get("numTrees"), maxDepth=get("maxDepth"), maxBins=get("maxBins"), seed=get("seed"),
                   taskRows=get("taskRows"), nodes=nodes, top=json.dumps(top), importance=(total / total.sum() if total.sum() > 0 else total).tolist())
        return model


def node_files(df: DataFrame, path: str, schema: str = SUBTREES) -> dict[int, list[str]]:
    """The files of each tree of a table that is stored by tree."""
    out: dict[int, list[str]] = {}
    for f in sorted(df.sparkSession.read.schema(schema).parquet(path).inputFiles()):
        out.setdefault(int(re.search(r"/tree=(\d+)/", f)[1]), []).append(f)
    return out


def subtrees(files: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(root, feature, cut, leaf values), one subtree at a time."""
    for f in files:
        fs, at = pa.fs.FileSystem.from_uri(f)
        with fs.open_input_file(at) as h:
            for b in pq.ParquetFile(h).iter_batches(batch_size=1, columns=["root", "feature", "cut", "leaf_values"]):
                feature, cut, values = (np.frombuffer(b.column(c)[0].as_buffer(), dtype=t) for c, t in (("feature", np.int16), ("cut", np.uint8), ("leaf_values", float)))
                yield b.column("root")[0].as_py(), feature, cut, values


def _scored(x: np.ndarray, trees: list, files: dict[int, list[str]]) -> np.ndarray:
    total = np.zeros(len(x))
    for t, (feature, cut, left, value) in enumerate(trees):
        feature, value = np.array(feature), np.array(value)
        at = walk(x, feature, np.array(cut), np.array(left))
        order = np.argsort(at, kind="stable") if len(feature) > 1 else np.arange(len(x))
        total += np.where(feature[at] == LEAF, value[at], 0.0)
        for root, f, c, leaf_values in subtrees(files.get(t, [])):
            a, b = np.searchsorted(at[order], [root, root + 1])
            rows = order[a:b]
            if len(rows):
                end = walk(x[rows], f, c, left_children(f))
                total[rows] += leaf_values[(np.cumsum(f < 0) - 1)[end]]
    return total / len(trees)


def _scorer(top: dict, files: dict[int, list[str]]):
    thresholds, trees = top["thresholds"], top["trees"]

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, n = [], 0
        for p in parts:
            held.append(binned(matrix(p, len(thresholds)), thresholds))
            n += len(p)
            if n >= SCORE_ROWS:
                yield pa.array(_scored(np.concatenate(held), trees, files))
                held, n = [], 0
        if held:
            yield pa.array(_scored(np.concatenate(held), trees, files))
    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def node_table(df: DataFrame, model: TableForestModel) -> DataFrame:
    """The nodes, one row each: (tree, node, feature, threshold, left_child, right_child, value). A leaf is its own child;
    a subtree's root has the number of its top node, its other nodes follow the top nodes and the tree's subtrees before it."""
    ship(df.sparkSession)
    top = json.loads(model.getOrDefault(model.top))
    thresholds, width = top["thresholds"], max(map(len, top["thresholds"])) or 1
    cuts = np.array([[*t, *[np.nan] * (width - len(t))] for t in thresholds])
    spark, schema = df.sparkSession, "tree int, node int, feature int, threshold double, left_child int, right_child int, value double"
    above = [(t, i, f, thresholds[f][cut[i]], left[i], left[i] + 1, None) if f >= 0 else (t, i, None, None, i, i, value[i])
             for t, (feature, cut, left, value) in enumerate(top["trees"]) for i, f in enumerate(feature) if f != BELOW]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                root, first = b.column("root")[i].as_py(), b.column("first")[i].as_py()
                f, c, v = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=t) for k, t in (("feature", np.int16), ("cut", np.uint8), ("leaf_values", float)))
                number = lambda k: np.where(k == 0, root, first + k).astype(np.int32)  # noqa: E731, B023
                leaf, node = f < 0, number(np.arange(len(f)))
                left = left_children(f)
                value = v[np.maximum(np.cumsum(leaf) - 1, 0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(f), b.column("tree")[i].as_py()), pa.int32()), pa.array(node), pa.array(f.astype(np.int32), mask=leaf),
                     pa.array(cuts[np.maximum(f, 0), np.minimum(c, width - 1)], mask=leaf), pa.array(np.where(leaf, node, number(left))),
                     pa.array(np.where(leaf, node, number(left + 1))), pa.array(value, mask=~leaf)],
                    ["tree", "node", "feature", "threshold", "left_child", "right_child", "value"])

    stored = spark.read.schema(SUBTREES).parquet(model.getOrDefault(model.nodes))
    sizes = spark.createDataFrame([(t, len(x[0])) for t, x in enumerate(top["trees"])], "tree int, above int")
    before = Window.partitionBy("tree").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    first = stored.select("tree", "root", F.length("cut").alias("n")).join(F.broadcast(sizes), "tree").select(      # one row per subtree
        "tree", "root", (F.col("above") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    below = stored.drop("importance").join(first, ["tree", "root"]).mapInArrow(rows, schema)
    return spark.createDataFrame(above, schema).unionByName(below)
