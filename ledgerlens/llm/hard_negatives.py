"""Operator 13, hard-negative mining: LEMP-style coordinate pruning. Vectors lie in length
buckets with sorted coordinate lists; an anchor's score threshold gives, for each of its focus
coordinates, a range of values that a partner can have, and only rows in all of these ranges are verified.

1. Rows: components become floor(256 * x); rows that take part are written by length of the vector,
   label and length band (norms within a factor ``BAND``), longest first.
2. Anchors come in blocks of at most ``BLOCK_BYTES``. A block's first threshold of each anchor is its k-th best
   partner inside the block itself, which is a lower bound.
3. Every task reads its rows as buckets of at most ``BUCKET`` rows of one label and band. A bucket whose longest
   vector can't reach an anchor's threshold is left out; else the threshold is a cosine, the angle around the anchor
   gives the feasible range of each of its ``FOCUS`` largest coordinates, the ranges are looked up in the sorted lists
   and intersected, and what is left is scored exactly. Ranges that leave most rows cost more than
   they save, so such anchors are scored against the whole bucket. Thresholds rise as better partners are found.
4. Two searches: positives (same label, the ``POSITIVES`` best), then negatives (other labels, the ``NEGATIVES`` best of
   score ``LOW``/100 to ``HIGH``/100 of the positive's).

Defined results: rows are compared by row, not by vec_id, so rows that share a vec_id are other rows of each other;
a null vec_id is no anchor and comes last among ties; vectors of different lengths don't compare, empty ones score 0; 256 * x beyond
the doubles counts as not finite; a score beyond 64 bits is an error; an empty table gives an empty table; other columns are not read.

Scale: the rows are sorted once; each block of anchors is one map over them without a shuffle of vectors. A task returns at
most k rows of an anchor or pair, which Spark cuts to k before and after the exchange. Nothing is gathered by label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, ship, table

SCALE = 256
BAND = 0.9
BUCKET = 4096
FOCUS = 3
#: Where the ranges together are expected to leave more than this part of a bucket, the bucket is scored as a whole.
DENSE = 0.2
BLOCK_BYTES = 4 << 20
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Scores below this are exact in doubles, and as integers leave room for the place in a bucket.
EXACT = float(1 << 50)
EVERY = 100
SHIFT_EVERY, SHIFT_LABELS = 7, 10
NO_ID = np.iinfo(np.int64).max


def rows(emb: DataFrame) -> DataFrame:
    """(vec_id, label, dim, band, vec) of the rows that take part; vec holds whole numbers as doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            valid = np.asarray(lists.is_valid()) & np.asarray(b.column("label").is_valid())
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.cast(pa.float64())
            gone = np.asarray(flat.is_null())
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * flat.fill_null(0.0).to_numpy(zero_copy_only=False))
            wrong = np.concatenate(([0], np.cumsum(gone | ~np.isfinite(x))))
            keep = np.flatnonzero(valid & (wrong[off[1:]] == wrong[off[:-1]]))
            norm = np.array([math.hypot(*x[off[i]:off[i + 1]]) for i in keep])
            band = np.full(len(keep), np.iinfo(np.int32).max)
            band[norm > 0] = np.floor(np.log(norm[norm > 0]) / math.log(BAND)).astype(np.int64)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(at), b.column("label").take(at), pa.array(off[keep + 1] - off[keep], pa.int32()), pa.array(band, pa.int32()),
                 pa.array([x[off[i]:off[i + 1]].tobytes() for i in keep], pa.binary())], names=["vec_id", "label", "dim", "band", "vec"])

    return emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(
        run, "vec_id long, label long, dim int, band int, vec binary")


def best(slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each slot, by score, then vec_id."""
    if score.dtype == object:
        score = np.unique(score, return_inverse=True)[1]
    order = np.lexsort((vec_id, -score, slot))
    s = slot[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order[np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s)))) < k]


class Bucket:
    """Rows of one label and length band, by vec_id, with a sorted list per coordinate (made when first asked for)."""

    def __init__(self, vec_id: np.ndarray, row: np.ndarray, x: np.ndarray):
        order = np.argsort(vec_id, kind="stable")
        self.vec_id, self.row, self.x = vec_id[order], row[order], x[order]
        self.norm = np.array([math.hypot(*v) for v in self.x])
        self.longest = float(self.norm.max())
        self.unit = self.x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows in the order of coordinate f, its sorted values, the place of each row in them)."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.lists[f] = order, self.unit[order, f], place
        return self.lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> list[np.ndarray | None]:
        """For each anchor the rows that lie in the feasible ranges of all its focus coordinates; None stands for all."""
        n, m = len(self.x), len(unit)
        lo, hi = np.zeros((m, focus.shape[1]), np.int64), np.full((m, focus.shape[1]), n, np.int64)
        angle = np.arccos(np.clip(cosine, -1, 1))
        for f in np.unique(focus[cosine > -1]).tolist():
            _, values, _ = self.coordinate(f)
            i, j = np.nonzero((focus == f) & (cosine > -1)[:, None])
            mid = np.arccos(np.clip(unit[i, f], -1, 1))
            lo[i, j] = np.searchsorted(values, np.cos(np.minimum(mid + angle[i], np.pi)) - 1e-9, "left")
            hi[i, j] = np.searchsorted(values, np.cos(np.maximum(mid - angle[i], 0.0)) + 1e-9, "right")
        size = np.maximum(hi - lo, 0)
        out: list[np.ndarray | None] = [None] * m
        for a in np.flatnonzero((size / max(n, 1)).prod(1) <= DENSE).tolist():
            first = int(size[a].argmin())
            found = self.coordinate(int(focus[a, first]))[0][lo[a, first]:hi[a, first]]
            for j, f in enumerate(focus[a].tolist()):
                if j != first and size[a, j] < n:
                    place = self.coordinate(f)[2][found]
                    found = found[(place >= lo[a, j]) & (place < hi[a, j])]
            out[a] = np.sort(found)
        return out


def inner(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; beyond ``EXACT`` with Python's integers."""
    if bound < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = lambda y: np.array([[int(v) for v in r] for r in y], object).reshape(y.shape)
    return whole(a) @ whole(x).T


class Anchors:
    """A block of anchors of one dimension, and slots (one or several for each anchor) with the scores they accept."""

    def __init__(self, row: np.ndarray, label: np.ndarray, x: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, other: bool, keep: int):
        self.row, self.label, self.x, self.other, self.keep = row, label, x, other, keep
        self.of, self.low, self.high = of, low, high
        self.norm = np.array([math.hypot(*v) for v in x])
        self.unit = x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), 1, kind="stable")[:, :FOCUS]
        self.clear()

    def clear(self) -> None:
        z = np.zeros(0, np.int64)
        self.slot, self.score, self.vec_id, self.found = z, z, z, z

    def floors(self) -> np.ndarray:
        """The lowest score each anchor can still use."""
        out = np.full(len(self.row), np.inf)
        np.minimum.at(out, self.of, self.low.astype(np.float64))
        return out

    def meet(self, b: Bucket, label: int) -> None:
        floor = self.floors()
        reach = self.norm * b.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(floor > 0, np.where(reach > 0, floor / reach, np.inf), -1.0)
        use = np.flatnonzero(((self.label != label) if self.other else (self.label == label)) & (cosine <= 1 + 1e-9) & (floor < np.inf))
        if not len(use):
            return
        bound = float(reach.max())
        some = b.candidates(self.unit[use], self.focus[use], np.clip(cosine[use], -1, 1))
        dense = np.array([i for i, c in zip(use.tolist(), some) if c is None], np.int64)
        step = max(1, (1 << 18) // max(1, len(b.x)))
        every = np.arange(len(b.x))
        found = [self.take(b, dense[i:i + step], every, bound) for i in range(0, len(dense), step)]
        found += [self.take(b, np.array([i]), c, bound) for i, c in zip(use.tolist(), some) if c is not None and len(c)]
        if found:
            self.add(*map(np.concatenate, zip(*found)))

    def take(self, b: Bucket, anchors: np.ndarray, cand: np.ndarray, bound: float) -> tuple[np.ndarray, ...]:
        """(slot, score, vec_id, row): the best of the candidates (by place, so by vec_id) for each slot of the anchors."""
        at = np.full(len(self.row), -1)
        at[anchors] = np.arange(len(anchors))
        slots = np.flatnonzero(at[self.of] >= 0)
        s = inner(self.x[anchors], b.x[cand], bound)[at[self.of[slots]]]
        ok = (s >= self.low[slots][:, None]) & (s <= self.high[slots][:, None]) & (self.row[self.of[slots]][:, None] != b.row[cand][None])
        n = len(cand)
        if bound < EXACT and n > self.keep:
            key = np.where(ok, s * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
            top = np.argpartition(key, n - self.keep, 1)[:, n - self.keep:]
            i, j = np.repeat(np.arange(len(slots)), self.keep), top.reshape(-1)
            hit = ok[i, j]
            i, j = i[hit], j[hit]
        else:
            i, j = np.nonzero(ok)
        return slots[i], s[i, j], b.vec_id[cand[j]], b.row[cand[j]]

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        slot, score = np.concatenate((self.slot, slot)), np.concatenate((self.score, score))
        vec_id, row = np.concatenate((self.vec_id, vec_id)), np.concatenate((self.found, row))
        top = best(slot, score, vec_id, self.keep)
        self.slot, self.score, self.vec_id, self.found = slot[top], score[top], vec_id[top], row[top]
        if len(self.slot) and float(max(abs(self.score.max()), abs(self.score.min()))) < EXACT:
            self.raise_floors()

    def raise_floors(self) -> None:
        """A slot that has ``keep`` partners takes nothing below the last of them."""
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.low)) >= self.keep)
        if len(full):
            # slots are sorted, the last of a slot is its worst
            last = np.searchsorted(self.slot, full, "right") - 1
            self.low = self.low.copy()
            self.low[full] = np.maximum(self.low[full], self.score[last])


def numbers(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in col])


def search(spark: SparkSession, data: DataFrame, blocks: dict[int, Anchors], keep: int) -> DataFrame:
    """(dim, slot, vec_id, row, score): the ``keep`` best of every slot over all rows."""
    for a in blocks.values():
        # the block's own rows give the first thresholds, and come again with all rows
        for label in np.unique(a.label).tolist():
            mine = np.flatnonzero(a.label == label)
            for i in range(0, len(mine), BUCKET):
                part = mine[i:i + BUCKET]
                a.meet(Bucket(np.full(len(part), NO_ID), a.row[part], a.x[part]), label)
        a.clear()
    sent = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, Anchors] = dict(sent.value)
        for d, a in mine.items():
            mine[d] = Anchors(a.row, a.label, a.x, a.of, a.low, a.high, a.other, a.keep)
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "label", "band")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for s, e in zip(cut, cut[1:]):
                dim, label = int(key[0, s]), int(key[1, s])
                if dim not in mine:
                    continue
                for i in range(s, e, BUCKET):
                    part = b.slice(i, min(BUCKET, e - i))
                    ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                    mine[dim].meet(Bucket(ids, part.column("row").to_numpy(), numbers(part.column("vec"))), label)
        for d, a in mine.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a.slot), d), pa.int32()), pa.array(a.slot, pa.int64()), pa.array(a.vec_id, pa.int64(), mask=a.vec_id == NO_ID),
                 pa.array(a.found, pa.int64()), pa.array(a.score.tolist(), pa.int64())], names=["dim", "slot", "vec_id", "row", "score"])

    found = data.select("dim", "label", "band", "row", "vec_id", "vec").mapInArrow(run, "dim int, slot long, vec_id long, row long, score long")
    by = Window.partitionBy("dim", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= keep)


def mine(spark: SparkSession, emb: DataFrame, anchors_every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    ship(spark)
    taken = Stored(spark, rows(emb), "vectors")
    order = ["dim", "label", "band", "vec_id"]
    data = Stored(spark, taken.df.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row"), "buckets")
    taken.drop()
    picked = data.df.where(F.col("vec_id") % anchors_every == 0)
    size = picked.agg(F.sum(F.length("vec") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    picked = picked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
    out: list[Stored] = []
    for k in range(n):
        block = picked.where(F.col("block") == k).select("dim", "row", "vec_id", "label", "vec").orderBy("dim", "row").toArrow()
        if not block.num_rows:
            continue
        dims = block["dim"].to_numpy()
        one, ids = {}, {}
        for d in np.unique(dims).tolist():
            t = block.filter(pa.array(dims == d))
            ids[d] = t["vec_id"].to_numpy()
            m = t.num_rows
            lowest = np.full(m, -np.inf)
            one[d] = Anchors(t["row"].to_numpy(), t["label"].to_numpy(), numbers(t["vec"].combine_chunks()), np.arange(m), lowest, -lowest, False, positives)
        # at most `positives` rows of each anchor of the block
        pos = search(spark, data.df, one, positives).orderBy("dim", "slot", "rank").toArrow()
        two, pairs = {}, []
        for d, a in one.items():
            t = pos.filter(pa.array(pos["dim"].to_numpy() == d))
            if not t.num_rows:
                continue
            of, ps = t["slot"].to_numpy(), t["score"].to_numpy()
            pid = t["vec_id"]
            exact = float(np.abs(ps).max()) < EXACT
            least = np.array([-(-low * int(p) // high) for p in ps.tolist()], np.int64 if exact else object)
            two[d] = Anchors(a.row, a.label, a.x, of, least, ps if exact else ps.astype(object), True, negatives)
            pairs.append(pa.table({"dim": pa.array(np.full(len(of), d), pa.int32()), "slot": pa.array(np.arange(len(of)), pa.int64()),
                                   "anchor_id": pa.array(ids[d][of], pa.int64()), "positive_id": pid, "positive_score": pa.array(ps, pa.int64())}))
        if not two:
            continue
        named = spark.createDataFrame(pa.concat_tables(pairs), "dim int, slot long, anchor_id long, positive_id long, positive_score long")
        hits = search(spark, data.df, two, negatives)
        # the pairs of a block: at most `positives` rows for each of its anchors
        res = hits.join(F.broadcast(named), ["dim", "slot"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(Stored(spark, res, "negatives"))
    data.drop()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out[0].schema).parquet(*[s.path for s in out])


def shifted(emb: DataFrame) -> DataFrame:
    """The labels of the query: every seventh row has the next of ten."""
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % SHIFT_LABELS).otherwise(F.col("label"))
    return emb.select("vec_id", label.alias("label"), "embedding")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark, shifted(table(spark, sf_dir, "embeddings")))


OP13_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, e.r, e.vec_id, e.label, coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM a JOIN e ON a.r <> e.r AND len(a.v) = len(e.v)),
p AS (SELECT ar, anchor_id, al, r, vec_id AS positive_id, score AS positive_score FROM s WHERE label = al
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r)::INTEGER AS rank
      FROM p JOIN s USING (ar, anchor_id) WHERE s.label <> p.al AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
