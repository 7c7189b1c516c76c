"""Operator 7, suffix-array dedup: sampled splitters range-partition suffixes by their
leading bytes, buckets sort them locally by multikey quicksort, and what is equal is
compared across buckets.

Texts are bytes. A byte is removed when a string of ``length`` bytes that covers it also starts
earlier (smaller doc_id, or the same document, earlier start).

A suffix array of all positions would move hundreds of bytes per byte. The array
here is sparse, and exact: of every window of ``length`` bytes the suffix at its smallest ``GRAM``-byte string
(by hash; all of them on ties) is taken. Equal windows take suffixes at the same place in them, so any two equal
windows meet at suffixes with the same leading bytes.

1. Classes: of equal texts the smallest doc_id goes on; the others are removed whole (from ``length`` bytes on).
2. Suffixes (about 1 in 31 bytes) move as (hash of the leading bytes, hash of the
   context, document, position). The context is all that windows with this suffix can cover. Where a context
   occurred earlier the whole of it is removed; contexts that are first, but share their leading bytes with others, go on.
3. Those get their bytes, are range-partitioned by their leading bytes at sampled splitters, and
   each bucket sorts the starts of their windows by multikey quicksort; windows equal over ``length`` bytes are a run,
   all but the earliest of which are removed.
4. Leading bytes with more than ``hot`` contexts are not put in one bucket: their windows are compared across tasks by
   128-bit hash, with minima taken before the shuffle.
5. Removed intervals meet their texts, overlaps merge.

Defined results: null text is empty; a null doc_id comes before all others; rows that share a doc_id come in the order of a hash of their
texts, of equal rows one stays; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, ship, stored, table, whole_groups
from ledgerlens.llm.textarrays import Texts, mix64

LENGTH = 100
GRAM = 40
HOT = 20_000
SUFFIXES_PER_TASK = 600_000
CONTEXTS_PER_TASK = 20_000
#: A text's suffixes at positions below 2^40; above it, the text's rank among those of one doc_id.
RANK = 40
FIRST_ID = -(2**63)


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` neighbours (doubling steps)."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (width - done)], x[width - done:]) if done < width else x


def suffixes(t: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the chosen suffixes, their bytes to the left and right that windows
    can cover, and hashes of leading bytes and of the context."""
    size = len(t.data)
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width = length - gram + 1
    prefix = t.prefix_hash()
    at = np.arange(size - gram + 1)
    h = Texts.span_hash(prefix, at, at + gram)
    low = sliding(h, width, np.minimum)                    # by window start: size - length + 1 of them
    starts = np.arange(size - length + 1)
    end_of = np.repeat(t.offsets[1:], np.diff(t.offsets))
    low[starts + length > end_of[:len(starts)]] = 0       # not within one text
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate((pad, low, pad)), width, np.maximum)   # over the windows that hold each position
    pos = np.flatnonzero(best == h)
    doc = t.doc_of(pos)
    left = np.minimum(length - gram, pos - t.offsets[doc])
    right = np.minimum(length, t.offsets[doc + 1] - pos)
    ctx = Texts.span_hash(prefix, pos - left, pos + right) ^ mix64(left.astype(np.uint64) + np.uint64(7))
    return pos, left, right, h[pos], ctx


def suffix_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(lead, ctx, doc, pos, sides, done) of the suffixes of (doc, rank, text). What a batch has
    seen earlier itself is ``done``, and gets a lead of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = Texts.of(b.column("text"))
            ids, rank = b.column("doc").to_numpy(), b.column("rank").to_numpy()
            for i, j, t in texts.slices():
                pos, left, right, lead, ctx = suffixes(t, length, gram)
                d = t.doc_of(pos)
                place = pos - t.offsets[d] + (rank[i:j][d] << RANK)
                doc = ids[i:j][d]
                order = np.lexsort((place, doc, ctx, lead))
                lead, ctx, doc, place, sides = lead[order], ctx[order], doc[order], place[order], (left * 256 + right)[order]
                done = np.zeros(len(lead), bool)
                done[1:] = (lead[1:] == lead[:-1]) & (ctx[1:] == ctx[:-1])
                lead[done] = mix64(place[done].astype(np.uint64) + doc[done].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(place), pa.array(sides.astype(np.int32)), pa.array(done)],
                                                 names=["lead", "ctx", "doc", "pos", "sides", "done"])

    return docs.select("doc", "rank", "text").mapInArrow(run, "lead long, ctx long, doc long, pos long, sides int, done boolean")


def meet(table_: DataFrame, partitions: int, length: int) -> DataFrame:
    """(doc, a, b, lead): intervals [a, b) of later occurrences of a context (lead null), and
    positions a of first contexts whose leading bytes others share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None          # lead and context of the last suffix
        wait = None          # the last first context: lead, doc, pos, whether it was given out
        for b in batches:
            lead, ctx, doc, pos, sides = (b.column(c).to_numpy() for c in ("lead", "ctx", "doc", "pos", "sides"))
            done = b.column("done").to_numpy(zero_copy_only=False)
            live = np.flatnonzero(~done)
            first = np.ones(len(live), bool)
            l, c = lead[live], ctx[live]
            if len(live):
                first[1:] = (l[1:] != l[:-1]) | (c[1:] != c[:-1])
                first[0] = last is None or last != (l[0], c[0])
                last = (l[-1], c[-1])
            later = np.concatenate((np.flatnonzero(done), live[~first]))
            left, right = sides[later] >> 8, sides[later] & 255
            whole = left + right >= length
            later, left, right = later[whole], left[whole], right[whole]
            out = [(doc[later], pos[later] - left, pos[later] + right, np.zeros(len(later), np.int64), np.zeros(len(later), bool))]
            f = live[first]
            if len(f):
                fl, fd, fp = lead[f], doc[f], pos[f]
                given = np.zeros(len(f), bool)
                if wait is not None:
                    fl, fd, fp, given = np.append(wait[0], fl), np.append(wait[1], fd), np.append(wait[2], fp), np.append(wait[3], given)
                same = fl[1:] == fl[:-1]
                shared = np.append(same, False) | np.append(False, same)
                new = shared & ~given
                out.append((fd[new], fp[new], fp[new], fl[new], np.ones(int(new.sum()), bool)))
                wait = (fl[-1:], fd[-1:], fp[-1:], (given | shared)[-1:])
            d, a, e, h, ok = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(h, pa.int64(), mask=~ok)], names=["doc", "a", "b", "lead"])

    return table_.repartition(partitions, "lead").sortWithinPartitions("lead", "ctx", "doc", "pos").mapInArrow(run, "doc long, a long, b long, lead long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(lead, head, doc, pos, back, bytes) of the wanted (doc, a, lead): head holds the leading bytes, back the number of bytes before them."""
    per_doc = (wanted.withColumn("rank", F.shiftright("a", RANK)).groupBy("doc", "rank")
               .agg(F.collect_list(F.struct("a", "lead")).alias("at")))
    rows = docs.join(per_doc, ["doc", "rank"]).select("doc", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = Texts.of(b.column("text")), b.column("at")
            for i in range(b.num_rows):
                raw = texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes()
                place = at[i].values.field("a").to_numpy()
                own = (place & ((1 << RANK) - 1)).tolist()
                back = [min(length - gram, p) for p in own]
                yield pa.RecordBatch.from_arrays([at[i].values.field("lead"), pa.array([raw[p:p + gram] for p in own], pa.binary()), pa.array([b.column("doc")[i].as_py()] * len(own), pa.int64()),
                                                  pa.array(place), pa.array(back, pa.int32()), pa.array([raw[p - k:p + length] for p, k in zip(own, back)], pa.binary())],
                                                 names=["lead", "head", "doc", "pos", "back", "bytes"])

    return rows.mapInArrow(run, "lead long, head binary, doc long, pos long, back int, bytes binary")


def multikey_sort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``starts``, eight bytes a key: suffixes that are equal so far
    are sorted by their next key, all such groups at once, to ``depth`` bytes. Returns
    the suffixes that are equal to another over ``depth`` bytes, and their groups."""
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    left, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k in range(0, depth, 8):
        key = words[starts[left] + k].astype(np.uint64)
        if depth - k < 8:
            key >>= np.uint64(8 * (8 - depth + k))
        order = np.lexsort((key, group))
        left, group, key = left[order], group[order], key[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        left, group = left[many], group[many]
        if not len(left):
            break
    return left, group


def window_starts(t: pa.Table, length: int) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes, and for every window in them: its start there, its row, its position in the document."""
    texts = Texts.of(t["bytes"])
    size = np.diff(texts.offsets)
    n = np.maximum(size - length + 1, 0)
    n = np.minimum(n, t["back"].to_numpy() + 1)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = t["pos"].to_numpy()[row] - t["back"].to_numpy()[row] + k
    return texts, texts.offsets[row] + k, row, place


def merged(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the windows at (doc, start), overlapping ones as one."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[end] + length


def sort_buckets(ctx: DataFrame, partitions: int, length: int) -> DataFrame:
    """(doc, a, b) of windows that occur earlier, from contexts range-partitioned by their leading bytes."""
    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, starts, row, place = window_starts(t, length)
        left, group = multikey_sort(texts.data, starts, length)
        if not len(left):
            return
        doc, start = t["doc"].to_numpy()[row[left]], place[left]
        order = np.lexsort((start, doc, group))
        doc, start, group = doc[order], start[order], group[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        head = head[np.cumsum(np.append(True, group[1:] != group[:-1])) - 1]
        later = (doc != doc[head]) | (start != start[head])     # a window may be met at two suffixes of its own
        d, a, b = merged(doc[later], start[later], length)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "head", 8000):
            yield from flush(t)

    return (ctx.select("head", "doc", "pos", "back", "bytes").repartitionByRange(partitions, "head").sortWithinPartitions("head")
            .mapInArrow(run, "doc long, a long, b long"))


def compare_hot(ctx: DataFrame, length: int) -> DataFrame:
    """The same for leading bytes with too many contexts for a bucket: window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            texts, starts, row, place = window_starts(t, length)
            h = Texts.span_hash(texts.prefix_hash(), starts, starts + length)
            again = Texts.of(pa.array([x[::-1] for x in t["bytes"].to_pylist()], pa.binary()))
            end = texts.offsets[row] + texts.offsets[row + 1] - starts
            h2 = Texts.span_hash(again.prefix_hash(), end - length, end)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(t["doc"].to_numpy()[row]), pa.array(place)], names=["h1", "h2", "doc", "start"])

    w = ctx.select("doc", "pos", "back", "bytes").mapInArrow(run, "h1 long, h2 long, doc long, start long")
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last")).where("first <> last")
    return (w.join(first, ["h1", "h2"]).where(F.struct("doc", "start") != F.col("first"))
            .select("doc", F.col("start").alias("a"), (F.col("start") + length).alias("b")).distinct())


def cut_texts(docs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(doc, th, n_removed, n_spans, kept): what is left of the texts that lose bytes."""
    per_doc = (intervals.withColumn("rank", F.shiftright("a", RANK)).groupBy("doc", "rank")
               .agg(F.collect_list(F.struct("a", "b")).alias("gone")))
    rows = docs.join(per_doc, ["doc", "rank"]).select("doc", "th", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = Texts.of(b.column("text")), b.column("gone")
            removed, spans, kept = [], [], []
            for i in range(b.num_rows):
                raw = texts.data[texts.offsets[i]:texts.offsets[i + 1]].tobytes()
                base = (1 << RANK) - 1
                a, e = (gone[i].values.field(k).to_numpy() for k in ("a", "b"))
                size = e - a
                a = a & base
                order = np.argsort(a, kind="stable")
                a, e = a[order], np.maximum.accumulate((a + size)[order])
                new = np.append(True, a[1:] > e[:-1])
                start, end = a[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                removed.append(int((end - start).sum()))
                spans.append(len(start))
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)])))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "th", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc long, th long, n_removed long, n_spans long, kept binary")


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, th, n_bytes, whole_sha256, copy) for every row of ``docs``, copy where an earlier row
    has the same text, and (doc_id, th, n_removed, n_spans, kept) of the texts that lose some bytes to others."""
    ship(spark)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(spark, d.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("th"), F.xxhash64(F.lit(1), "text").alias("th2"), F.sha2("text", 256).alias("whole_sha256")), "rows")
    classes = stored(spark, rows.groupBy("n_bytes", "th", "th2").agg(F.min("doc").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc"))
    later = stored(spark, rows.join(classes, ["n_bytes", "th", "th2"]).where("doc > rep").select("doc", "th", "th2").distinct(), "later")
    copies = stored(spark, later.select("doc").distinct().join(reps, "doc", "left_anti"), "copies")
    # copies under a doc_id that has a text of its own too
    mixed = stored(spark, later.join(reps, "doc", "left_semi"), "mixed")
    many = reps.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    ranks = stored(spark, classes.withColumnRenamed("rep", "doc").join(many, "doc").select("doc", "th", (F.row_number().over(Window.partitionBy("doc").orderBy("th", "th2")) - 1).cast("long").alias("rank")), "ranks")
    single = d.join(copies, "doc", "left_anti").where(F.octet_length("text") >= length).withColumn("th", F.xxhash64("text"))
    if mixed.limit(1).count():
        single = single.withColumn("th2", F.xxhash64(F.lit(1), "text")).join(mixed, ["doc", "th", "th2"], "left_anti").drop("th2")
    single = single.join(ranks, ["doc", "th"], "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long"))) if ranks.limit(1).count() else single.withColumn("rank", F.lit(0).cast("long"))
    twice = stored(spark, rows.groupBy("doc", "n_bytes", "th", "th2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc").distinct(), "twice")
    if twice.limit(1).count():
        # equal rows of one doc_id are one text
        single = single.join(twice, "doc", "left_anti").unionByName(single.join(twice, "doc", "left_semi").dropDuplicates(["doc", "th"]))
    total = classes.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(1, total * 2 // (length - gram) // SUFFIXES_PER_TASK)
    found = Stored(spark, meet(suffix_table(single, length, gram), tasks, length), "found").df
    wanted, gone = found.where("lead is not null"), found.where("lead is null").select("doc", "a", "b")
    ctx = stored(spark, contexts(single, wanted, length, gram), "contexts")
    often = stored(spark, ctx.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("lead"), "often")
    cold = ctx
    if often.limit(1).count():
        gone = gone.union(compare_hot(ctx.join(often, "lead", "left_semi"), length))
        cold = ctx.join(often, "lead", "left_anti")
    gone = gone.union(sort_buckets(cold, max(1, ctx.count() // CONTEXTS_PER_TASK), length))
    cut = cut_texts(single, gone)
    own = F.when(F.col("doc") != FIRST_ID, F.col("doc")).alias("doc_id")
    # of equal rows of one doc_id the first stays, as many more as there are are copies
    same = (rows.groupBy("doc", "n_bytes", "th", "th2", "whole_sha256").agg(F.count(F.lit(1)).alias("n")).join(classes, ["n_bytes", "th", "th2"])
            .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))))
    every = same.select(own, "th", "n_bytes", "whole_sha256", ((F.col("doc") > F.col("rep")) | (F.col("i") > 1)).alias("copy"))
    return every, cut.select(own, "th", "n_removed", "n_spans", "kept")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, cut = drop_repeats(spark, table(spark, sf_dir, "documents"))
    cut = cut.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    some = F.col("n_removed").isNotNull() & ~F.col("copy")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(cut, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).when(some, F.col("n_removed")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(whole, F.lit(1)).when(some, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).when(some, F.col("sha")).otherwise(F.col("whole_sha256")).alias("kept_sha256"))
