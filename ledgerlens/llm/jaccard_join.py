"""Operator 5, n-gram Jaccard join: a prefix-tree join. Sets of word n-grams, globally
ordered, are stored in a trie; a traversal carries the partial overlaps of all probes
together and prunes subtrees by bounds on what is left.

1. Sets. A text's set is its distinct k-word shingles (64-bit hashes), a shorter text's its
   whole sequence. Texts with equal sets (two more 64-bit digests and the size) are one class; only its
   smallest doc_id goes on, so copies never meet each other.
2. Order. Shingles are ordered by how often they occur, rare first, then by hash. The counts come from a
   sketch of fixed size over all documents; any order is right, a good one keeps what follows short.
3. Blocks. Two sets with Jaccard t share one of the first n - ceil(t n) + 1 shingles of each in
   that order. Documents that share such a shingle form a block; a frequent shingle's block
   is dealt to tiles of about ``BLOCK`` documents, in which every two documents still meet.
4. Candidates. Two members are candidates if their sizes and parity sketches fit (two sets differ in at least as many
   shingles as their sketches in bits, so no link is lost). Blocks return edges that span their candidates' components, not
   pairs; the components over all blocks are the groups that a link can't leave.
5. Trie. Each group's whole sets are joined in a trie, large groups' in tiles of two slices of ``BLOCK`` sets. A trie returns
   edges that span its local components.
6. Components by large-star / small-star over those edges.

Defined results: without words (or null text) n_shingles is 0 and the document links with nothing;
rows that share a doc_id share a component (those with words); a null doc_id links with nothing and has a null component;
an empty table gives an empty table; other input columns are not read.

Scale: texts are read by column, and moved once, for documents that share a rare shingle with another. Shingles
move as 20-byte postings of the ordered prefix (15 % of a set at 0.85); the sketch is 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import connected_components, groups, ship, stored, table, whole_groups
from ledgerlens.llm.textarrays import Texts, mix64, shingle_hashes, sorted_unique

WORDS = 5
NUM, DEN = 80, 100
SKETCH_BITS = 18
SKETCH_PARTS = 64
BLOCK = 512
POSTINGS_PER_TASK = 500_000
#: Up to so many longs (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(arr: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, hashes, texts) of slices of texts; hashes ascend within a text."""
    for i, j, t in Texts.of(arr).slices():
        t = t.lower_ascii()
        starts, ends, doc = t.words()
        h = Texts.span_hash(t.prefix_hash(), starts, ends)
        yield i, j, *sorted_unique(*shingle_hashes(h, doc, t.n, k))


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's parity sketch: a power of two from 64, at least half its size."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) - 1)


def parity_sketches(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per set, whether an odd number of its hashes falls on each bit (by the hash modulo the number of bits)."""
    bits = sketch_bits(n)
    base = np.cumsum(bits) - bits
    odd = np.bincount(base[d] + (h & (bits[d] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    off = np.concatenate(([0], np.cumsum(bits >> 3))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])


def digests(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (doc_id, n, d1, d2 and its parity sketch as counts; part null) and, per task, its
    share of the sketch of all shingles (part, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for i, j, h, d in shingle_sets(b.column("text"), k):
                sketch += np.bincount(h >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch))
                n = np.bincount(d, minlength=j - i)
                at = np.concatenate(([0], np.cumsum(n)))
                sums = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(salt)))))
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                                                  pa.nulls(j - i, pa.int32()), parity_sketches(h, d, n)], names=["doc_id", "n", "d1", "d2", "part", "counts"])
        parts = np.minimum(sketch, 2**31 - 1).astype("<i4").reshape(SKETCH_PARTS, -1)
        m = SKETCH_PARTS
        kind = pa.int64()
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, kind), pa.nulls(m, kind), pa.nulls(m, kind),
                                          pa.array(range(m), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "n", "d1", "d2", "part", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, part int, counts binary")


def read_sketch(made: DataFrame) -> np.ndarray:
    """The summed sketch: 2^SKETCH_BITS counts, whatever the input's size."""
    def add(pdf):
        total = sum(np.frombuffer(c, "<i4").astype(np.int64) for c in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[np.minimum(total, 2**31 - 1).astype("<i4").tobytes()])

    got = made.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").toArrow().sort_by("part")
    if not got.num_rows:
        return np.zeros(1 << SKETCH_BITS, np.int32)
    return np.concatenate([np.frombuffer(c.as_buffer(), "<i4") for c in got["counts"]])


def ordered(h: np.ndarray, d: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Positions of (h, d), which ascend by text and hash, in the global order within each text."""
    count = np.minimum(sketch[h >> np.uint64(64 - SKETCH_BITS)], (1 << 24) - 1).astype(np.uint64)
    order = np.argsort((count << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
    return order[np.argsort(d[order], kind="stable")]


def postings(docs: DataFrame, sketch: np.ndarray, k: int, num: int, den: int, block: int) -> DataFrame:
    """(tile, doc_id, n): the shingles of each document's prefix, frequent ones by tile."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    noise = float(sketch.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = held.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, h, d in shingle_sets(b.column("text"), k):
                n = np.bincount(d, minlength=j - i)
                order = ordered(h, d, sketch)
                h, d = h[order], d[order]
                place = np.arange(len(h)) - (np.cumsum(n) - n)[d]
                # a set that no other size can match within the threshold has no postings
                some = (place < prefix_size(n, num, den)[d]) & (den * n >= num * (n + 1))[d]
                h, d = h[some], d[some]
                g = np.maximum(1, np.ceil((sketch[h >> np.uint64(64 - SKETCH_BITS)] - noise) / block)).astype(np.int64)
                own = ids[i:j][d].astype(np.int64)
                s = (mix64(own.astype(np.uint64) + np.uint64(77)) % g.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(h)), g)
                o = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
                tile = np.where(g[at] == 1, h[at], mix64(h[at] + np.minimum(o, s[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(o, s[at]).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
                yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(own[at]), pa.array(n[d][at].astype(np.int64))], names=["tile", "doc_id", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "tile long, doc_id long, n long")


def blocks(posted: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """(block, doc_id): the distinct member lists of the tiles that hold fitting documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("tile").to_numpy(), b.column("doc_id").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not got:
            return
        tile, doc, n = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((doc, n, tile))
        tile, doc, n = tile[order], doc[order], n[order]
        near = (tile[1:] == tile[:-1]) & (den * n[:-1] >= num * n[1:])
        some = np.concatenate((near, [False])) | np.concatenate(([False], near))
        tile, doc = tile[some], doc[some]
        if not len(tile):
            return
        first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        size = np.diff(np.append(first, len(tile)))
        key = mix64(np.add.reduceat(mix64(doc.astype(np.uint64)), first) + size.astype(np.uint64))
        _, keep = np.unique(key, return_index=True)
        chosen = np.zeros(len(first), bool)
        chosen[keep] = True
        rows = np.repeat(chosen, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, size)[rows].view(np.int64)), pa.array(doc[rows])], names=["block", "doc_id"])

    return posted.repartition(partitions, "tile").mapInArrow(run, "block long, doc_id long").distinct()


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Component labels (smallest member) after linking x[i] with y[i]."""
    while True:
        a, b = label[x], label[y]
        differ = a != b
        if not differ.any():
            return label
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def fitting(listed: DataFrame, sets: DataFrame, partitions: int, num: int, den: int) -> DataFrame:
    """(a, b): edges that span the components of the candidate pairs of each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block", 20_000):
            block, doc, n = (t[c].to_numpy() for c in ("block", "doc_id", "n"))
            bits = sketch_bits(n)
            rows: dict[int, np.ndarray] = {}     # rows of the sketches of each length, those of twice the length folded
            at = np.zeros(len(n), np.int64)
            fold_at = np.zeros(len(n), np.int64)
            for b in np.unique(np.concatenate((bits, bits >> 1))).tolist():
                own, twice = np.flatnonzero(bits == b), np.flatnonzero(bits == 2 * b)
                parts = []
                if len(own):
                    parts.append(np.stack([np.frombuffer(t["sig"][i].as_buffer(), "<u8") for i in own.tolist()]))
                    at[own] = np.arange(len(own))
                if len(twice) and b >= 64:
                    w = np.stack([np.frombuffer(t["sig"][i].as_buffer(), "<u8") for i in twice.tolist()])
                    parts.append(w[:, :w.shape[1] // 2] ^ w[:, w.shape[1] // 2:])
                    fold_at[twice] = len(own) + np.arange(len(twice))
                if parts:
                    rows[b] = np.concatenate(parts)
            label = np.arange(len(n))
            left = np.arange(len(n) - 1)
            k = 1
            while len(left):
                left = left[(left + k < len(n))]
                left = left[block[left + k] == block[left]]     # rows of a block ascend by size
                a, b = left, left + k
                ok = (den * n[a] >= num * n[b]) & (bits[b] <= 2 * bits[a]) & (doc[a] != doc[b])
                a, b = a[ok], b[ok]
                low = bits[a]
                for size in np.unique(low).tolist():
                    m = low == size
                    x, y = a[m], b[m]
                    sig = rows[size]
                    differ = np.bitwise_count(sig[at[x]] ^ sig[np.where(bits[y] == size, at[y], fold_at[y])]).sum(1, dtype=np.int64)
                    # linked sets differ in at most (den - num) / (den + num) of the sum of their sizes
                    good = (den + num) * differ <= (den - num) * (n[x] + n[y])
                    label = merge(label, x[good], y[good])
                k += 1
            some = label != np.arange(len(n))
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(doc[label[some]])], names=["a", "b"])

    rows = listed.join(sets, "doc_id").select("block", "doc_id", "n", "sig")
    return rows.repartition(partitions, "block").sortWithinPartitions("block", "n", "doc_id").mapInArrow(run, "a long, b long")


def group_tiles(parts: DataFrame, block: int) -> DataFrame:
    """(doc_id, blocks) from (node, component): the one block of each document of a group, or of a group of more
    than ``block`` the tiles of its slice with every slice."""
    size = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("g"))
    own = F.pmod(F.xxhash64("node"), F.col("g"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda o: F.xxhash64("component", F.least(own, o), F.greatest(own, o)))
    return parts.join(size, "component").select(F.col("node").alias("doc_id"), tiles.alias("blocks"))


def members(docs: DataFrame, per_doc: DataFrame, sketch: np.ndarray, k: int) -> DataFrame:
    """(block, doc_id, grams): the whole ordered sets, in every block of the document."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_doc, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column("doc_id"), b.column("blocks")
            for i, j, h, d in shingle_sets(b.column("text"), k):
                h = h[ordered(h, d, held.value)]
                at = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=j - i))))
                for x in range(j - i):
                    own = lists[i + x].as_py()
                    raw = h[at[x]:at[x + 1]].tobytes()
                    step = max(1, (8 << 20) // max(len(raw), 1))
                    for y in range(0, len(own), step):
                        m = len(own[y:y + step])
                        yield pa.RecordBatch.from_arrays([pa.array(own[y:y + step], pa.int64()), pa.array([ids[i + x].as_py()] * m, pa.int64()), pa.array([raw] * m, pa.binary())], names=["block", "doc_id", "grams"])

    return texts.select("doc_id", "text", "blocks").mapInArrow(run, "block long, doc_id long, grams binary")


class Trie:
    """Ordered sets (rising lists of gram numbers) as a path-compressed prefix tree."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        keys = [keys[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets])
        self.lcp = np.zeros(max(len(sets) - 1, 0), np.int64)
        for i in range(len(sets) - 1):
            a, b = self.sets[i], self.sets[i + 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.lcp[i] = differ[0] if len(differ) else m

    def nodes(self) -> Iterator[tuple[int, int, int, int]]:
        """Depth first: (first leaf, last leaf + 1, depth above, depth below) of every node."""
        stack = [(0, len(self.sets), 0)]
        while stack:
            lo, hi, above = stack.pop()
            if hi - lo == 1:
                yield lo, hi, above, int(self.size[lo])
                continue
            below = int(self.lcp[lo:hi - 1].min())
            yield lo, hi, above, below
            cut = [lo, *(np.flatnonzero(self.lcp[lo:hi - 1] == below) + lo + 1).tolist(), hi]
            stack.extend((a, b, below) for a, b in zip(reversed(cut[:-1]), reversed(cut[1:])))

    def join(self, num: int, den: int, chunk: int = 24) -> np.ndarray:
        """Labels of the components of the sets with den * |x & y| >= num * |x | y|, in the order given."""
        m, size = len(self.sets), self.size
        flat = np.concatenate(self.sets) if m else np.zeros(0, np.int64)
        vocab = int(flat.max()) + 1 if len(flat) else 1
        begin = np.concatenate(([0], np.cumsum(size)))
        # grams of one set alone never meet: they share a column that nobody holds
        shared = np.bincount(flat, minlength=vocab) > 1
        column = np.where(shared, np.cumsum(shared), 0)
        holds = np.zeros((m, int(shared.sum()) + 1), bool)
        holds[np.repeat(np.arange(m), size), column[flat]] = True
        holds[:, 0] = False
        where = np.repeat(np.arange(m), size) * vocab + flat
        label = np.arange(m)
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.arange(m), np.zeros(m, np.int64))}
        depths = [0]
        for lo, hi, above, below in self.nodes():
            while depths[-1] != above:
                state.pop(depths.pop(), None)
            alive, overlap = state[above]
            low, high = int(size[lo:hi].min()), int(size[lo:hi].max())
            # every pair is met once; sizes must fit; nothing to learn inside one component
            ok = (alive > lo) & (num * low <= den * size[alive]) & (num * size[alive] <= den * high)
            if hi - lo == 1:
                ok &= label[alive] != label[lo]
            alive, overlap = alive[ok], overlap[ok]
            path, depth = self.sets[lo], above
            while depth < below and len(alive):
                step = path[depth:min(depth + chunk, below)]
                depth += len(step)
                overlap = overlap + holds[alive[:, None], column[step]].sum(1)
                left = begin[alive + 1] - np.searchsorted(where, alive * vocab + step[-1], "right")
                ok = (num + den) * (overlap + np.minimum(left, high - depth)) >= num * (size[alive] + low)
                alive, overlap = alive[ok], overlap[ok]
            if hi - lo == 1:
                hit = alive[den * overlap >= num * (size[alive] + low - overlap)]
                if len(hit):
                    old = np.append(label[hit], label[lo])
                    label[np.isin(label, old)] = old.min()
            else:
                state[below] = alive, overlap
                if depths[-1] != below:
                    depths.append(below)
        out = np.empty(m, np.int64)
        out[self.order] = label
        return out


def join_blocks(sets: DataFrame, sketch: np.ndarray, partitions: int, num: int, den: int) -> DataFrame:
    """(a, b): edges that span the components found in each block."""
    held = sets.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "block"):
            ids = g["doc_id"].to_numpy()
            raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in g["grams"]]
            every = np.unique(np.concatenate(raw))
            rank = np.empty(len(every), np.int64)
            rank[ordered(every, np.zeros(len(every), np.int64), held.value)] = np.arange(len(every))
            label = Trie([rank[np.searchsorted(every, r)] for r in raw]).join(num, den)
            _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
            a, b = ids, ids[first][inverse]
            some = a != b
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], names=["a", "b"])

    return sets.repartition(partitions, "block").sortWithinPartitions("block", "doc_id").mapInArrow(run, "a long, b long")


def link_documents(spark: SparkSession, docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; documents with
    den * |intersection| >= num * |union| are linked, component_id is the smallest doc_id reachable."""
    if 2 * num < den:
        raise ValueError("similarities below one half are not supported")
    ship(spark)
    made = stored(spark, digests(docs, k), "digests")
    sketch = read_sketch(made)
    sets = made.where("part is null").select("doc_id", "n", "d1", "d2", F.col("counts").alias("sig"))
    classes = stored(spark, sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    copies = (sets.where("n > 0").join(classes, ["n", "d1", "d2"]).where("doc_id > rep").select("doc_id").distinct()
              .join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    copies = stored(spark, copies, "copies")
    single = docs.where("doc_id is not null").join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    total = classes.agg(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1"))).first()[0] or 0
    posted = postings(single, sketch, k, num, den, block)
    met = stored(spark, blocks(posted, max(1, int(total) // POSTINGS_PER_TASK), num, den), "blocks")
    sizes = sets.where("n > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "n", "d1", "d2"]).select("doc_id", "n", "sig")
    candidates = connected_components(spark, fitting(met, sizes, max(1, met.count() // 50_000), num, den), "candidates")
    per_doc = stored(spark, group_tiles(stored(spark, candidates, "groups"), block), "tiles")
    rows = per_doc.agg(F.sum(F.size("blocks"))).first()[0] or 0
    few = F.broadcast(per_doc) if rows <= BROADCAST_IDS else per_doc
    edges = join_blocks(members(single, few, sketch, k), sketch, max(1, rows // 2000), num, den)
    # the classes of one doc_id's rows belong together
    many = stored(spark, sets.where("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2").distinct()
                  .groupBy("doc_id").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("doc_id"), "many")
    if many.limit(1).count():
        edges = edges.union(sets.join(many, "doc_id").join(classes, ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(spark, edges)
    named = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.drop("sig").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark, table(spark, sf_dir, "documents"), 4, 85, 100)
