"""Operator 11, benchmark decontamination: a distributed positional inverted index. Token postings
of the training documents are stored; test phrases are found by intersecting offset-adjusted lists from
their rarest terms on, as exact phrases or within a number of words.

1. Index (``build``): documents lie in segments of about ``SEGMENT_WORDS`` words. A segment has a row for each of its
   documents and one for each of its terms, whose postings are the term's word positions (gaps in variable-length bytes).
   It is written as Parquet, every document and term of the corpus, and can be opened again (``Index``).
2. Phrases (``windows``): every run of ``WINDOW`` words of an item; an item with fewer words, but not none, is one.
3. Search: corpus frequencies order the terms of a phrase. The lists of its two rarest terms are fetched and intersected
   first, per segment; only for segments where that leaves a place the lists of the other terms follow, each cutting the places further.
   ``Index.phrases`` gives exact matches, ``Index.near`` places where a number of words holds all words of a phrase.

Words are runs of 0-9, a-z and all characters beyond ASCII, after A-Z is lower-cased; terms are their 64-bit hashes.

Defined results: null text has no words; rows that share a doc_id are documents of their own; an item is an item_id, so
rows that share one count once; a null item_id has phrases that hit words but names no item; equal phrases are searched once;
empty tables give documents without hits or no rows; other input columns are not read.

Scale: no term is gathered anywhere, as lists are per segment, and a segment meets only the lists of phrases that its rarest terms
leave. Phrases come in blocks of at most about ``BLOCK`` (their size, not the corpus's, is what is broadcast). A segment holds
at most about ``SEGMENT_WORDS`` words, or one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, groups, ship, stored, table
from ledgerlens.llm.textarrays import Texts

WINDOW = 10
SEGMENT_WORDS = 1 << 19
BLOCK = 100_000
#: Rows of the phrase-to-item table up to which it is broadcast.
SMALL_ROWS = 1_000_000


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word."""
    low = texts.lower_ascii()
    inside = ((low.data >= 48) & (low.data <= 57)) | ((low.data >= 97) & (low.data <= 122)) | (low.data >= 128)
    starts, ends, doc = low.spans(inside)
    return Texts.span_hash(low.prefix_hash(), starts, ends).view(np.int64), doc


def to_bytes(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as variable-length bytes, and how many bytes each takes."""
    size = 1 + sum((gaps >= (1 << 7 * i)).astype(np.int64) for i in range(1, 5))
    end = np.cumsum(size)
    out = np.zeros(end[-1] if len(end) else 0, np.uint8)
    for i in range(5):
        at = np.flatnonzero(size > i)
        if not len(at):
            break
        out[end[at] - size[at] + i] = ((gaps[at] >> 7 * i) & 127) | ((size[at] > i + 1) << 7)
    return out, size


def from_bytes(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    within = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), first) if len(first) else first


def segment_rows(segment: int, ids: pa.Array, term: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """The rows of a segment: its documents, then its terms in order."""
    order = np.argsort(term, kind="stable")
    t = term[order]
    new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    gap = np.diff(order, prepend=0)
    gap[new] = order[new]
    data, size = to_bytes(gap)
    at = np.concatenate(([0], np.cumsum(size)))
    edge = np.concatenate((at[new], at[-1:])).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(edge), pa.py_buffer(data)])
    docs, n = len(counts), len(new)
    none = lambda k, m: pa.nulls(m, k)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    both = lambda a, b: pa.concat_arrays([a, b])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(docs + n, segment), pa.int64()), both(pa.array(np.arange(docs), pa.int32()), none(pa.int32(), n)),
         both(ids.cast(kind), none(kind, n)), both(pa.array(first, pa.int64()), none(pa.int64(), n)),
         both(none(pa.int64(), docs), pa.array(t[new], pa.int64())),
         both(pa.array(counts, pa.int64()), pa.array(np.diff(np.append(new, len(t))), pa.int64())), both(none(pa.binary(), docs), lists)],
        names=["segment", "ordinal", "doc_id", "first", "term", "n", "postings"])


def build(spark: SparkSession, docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> Index:
    """The index of ``docs`` (doc_id, text) in the shared folder."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, count = TaskContext.get().partitionId() << 32, 0
        ids, terms, counts, words = [], [], [], 0

        def flush() -> pa.RecordBatch:
            kind = ids[0].type
            return segment_rows(segment + count, pa.concat_arrays(ids), np.concatenate(terms), np.concatenate(counts), kind)

        for b in batches:
            for i, j, texts in Texts.of(b.column("text")).slices():
                h, doc = terms_of(texts)
                ids.append(b.column("doc_id").slice(i, j - i))
                terms.append(h)
                counts.append(np.bincount(doc, minlength=j - i))
                words += len(h)
                if words >= segment_words:
                    yield flush()
                    count += 1
                    ids, terms, counts, words = [], [], [], 0
        if ids:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"segment long, ordinal int, doc_id {kind}, first long, term long, n long, postings binary"
    return Index(Stored(spark, docs.select("doc_id", "text").mapInArrow(run, schema), "index"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms): the distinct phrases of each item; terms are ``size`` hashes, or fewer, 8 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for i, j, texts in Texts.of(b.column("text")).slices():
                h, doc = terms_of(texts)
                at = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    w = h[at[d]:at[d + 1]]
                    found = {w[k:k + size].tobytes() for k in range(max(1, len(w) - size + 1))} if len(w) else ()
                    row += [i + d] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms binary").select("item_id", F.xxhash64("terms").alias("phrase"), "terms")


class Plan:
    """Phrases with their terms from the rarest on (``terms``, at ``offset`` in the phrase), sorted by the rarest."""

    def __init__(self, phrase: np.ndarray, terms: list[np.ndarray], known: np.ndarray, frequency: np.ndarray):
        size = np.array([len(t) for t in terms])
        k = int(size.max(initial=1))
        grid = np.zeros((len(terms), k), np.int64)
        used = np.arange(k) < size[:, None]
        grid[used] = np.concatenate(terms) if len(terms) else 0
        at = np.minimum(np.searchsorted(known, grid), max(len(known) - 1, 0))
        often = np.where(used, np.where(known[at] == grid, frequency[at], 0), np.iinfo(np.int64).max) if len(known) else np.where(used, 0, 1)
        order = np.argsort(often, 1, kind="stable")
        terms_ = np.take_along_axis(grid, order, 1)
        # a phrase with a term that the corpus lacks is nowhere
        keep = np.flatnonzero(np.take_along_axis(often, order, 1)[:, 0] > 0)
        keep = keep[np.argsort(terms_[keep, 0], kind="stable")]
        self.phrase, self.terms, self.offset, self.size = phrase[keep], terms_[keep], order[keep], size[keep]
        self.anchor, self.start = np.unique(self.terms[:, 0], return_index=True)
        self.start = np.append(self.start, len(keep))
        # how often the phrase has each of its words; 0 where an earlier place has counted it
        own = np.arange(k) < self.size[:, None]
        same = (self.terms[:, :, None] == self.terms[:, None, :]) & own[:, None, :] & own[:, :, None]
        self.times = np.where(own & ~np.tril(same, -1).any(2), same.sum(2), 0)

    def words(self, depth: int | None = None) -> np.ndarray:
        k = self.terms.shape[1] if depth is None else min(depth, self.terms.shape[1])
        return np.unique(self.terms[:, :k][np.arange(k) < self.size[:, None]])


class Segment:
    """The fetched lists of a segment: sorted terms, and (place of the term, position) of all postings as one sorted column."""

    def __init__(self, t: pa.Table):
        docs = t["term"].null_count
        if docs:
            d = t.slice(0, docs).sort_by("ordinal")
            self.ordinal, self.first, self.count = d["ordinal"].to_numpy(), d["first"].to_numpy(), d["n"].to_numpy()
        t = t.slice(docs)
        self.term, n = t["term"].to_numpy(), t["n"].to_numpy()
        gaps = from_bytes(np.frombuffer(b"".join(t["postings"].to_pylist()), np.uint8))
        self.edge = np.concatenate(([0], np.cumsum(n)))
        run = np.cumsum(gaps)
        before = np.concatenate(([0], run))[self.edge[:-1]]
        self.keys = (np.repeat(np.arange(len(n)), n) << 32) | (run - np.repeat(before, n))

    def place(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term, or -1."""
        if not len(self.term):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return np.where(self.term[at] == terms, at, -1)

    def starts(self, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its rarest term) of the phrases whose rarest term is here."""
        at = np.searchsorted(plan.anchor, self.term)
        at[at == len(plan.anchor)] = 0
        here = np.flatnonzero(plan.anchor[at] == self.term) if len(plan.anchor) else np.zeros(0, np.int64)
        lo, hi = plan.start[at[here]], plan.start[at[here] + 1]
        w = np.repeat(lo, hi - lo) + _within(hi - lo)
        return w, np.repeat(here, hi - lo)

    def postings(self, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every posting of the phrases' rarest terms."""
        n = self.edge[place + 1] - self.edge[place]
        return np.repeat(w, n), self.keys[np.repeat(self.edge[place], n) + _within(n)] & 0xFFFFFFFF

    def phrases(self, plan: Plan, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first position): places that the lists of the ``depth`` rarest terms (all) leave."""
        k = plan.terms.shape[1] if depth is None else min(depth, plan.terms.shape[1])
        w, place = self.starts(plan)
        at = {}
        for j in range(1, k):
            at[j] = self.place(plan.terms[w, j])
            here = (at[j] >= 0) | (plan.size[w] <= j)
            w, place, at = w[here], place[here], {i: a[here] for i, a in at.items()}
        places = np.stack([place, *at.values()]) if len(w) else np.zeros((k, 0), np.int64)
        row = np.arange(len(w))
        i, pos = self.postings(row, place)
        s = pos - plan.offset[w[i], 0]
        ok = s >= 0
        i, s = i[ok], s[ok]
        for j in range(1, k):
            want = (places[j, i] << 32) | (s + plan.offset[w[i], j])
            hit = self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want if len(want) else np.zeros(0, bool)
            ok = hit | (plan.size[w[i]] <= j)
            i, s = i[ok], s[ok]
        return w[i], s

    def near(self, plan: Plan, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position): words of a phrase from which ``width`` words of the document hold all its words."""
        w, place = self.starts(plan)
        k = plan.terms.shape[1]
        for j in range(1, k):
            here = (self.place(plan.terms[w, j]) >= 0) | (plan.size[w] <= j)
            w, place = w[here], place[here]
        i, pos = self.postings(w, place)
        i, s = np.repeat(i, width), np.repeat(pos, width) - np.tile(np.arange(width), len(pos))
        both = np.unique(np.stack([i[s >= 0], s[s >= 0]]), axis=1)
        i, s = both[0], both[1]
        d = self.document(s)
        end = np.minimum(s + width, self.first[d] + self.count[d])
        begins = np.zeros(len(s), bool)
        ok = np.ones(len(s), bool)
        for j in range(k):
            times = plan.times[i, j]
            p = np.maximum(self.place(plan.terms[i, j]), 0)
            at = np.searchsorted(self.keys, (p << 32) | s)
            last = np.minimum(at + np.maximum(times, 1) - 1, len(self.keys) - 1)
            ok &= (times == 0) | ((at + times <= len(self.keys)) & (self.keys[last] >> 32 == p) & ((self.keys[last] & 0xFFFFFFFF) < end))
            begins |= (times > 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == ((p << 32) | s))
        ok &= begins
        return i[ok], s[ok]

    def document(self, s: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, s, "right") - 1

    def inside(self, size: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, whether ``size`` words from each position end in it)."""
        d = self.document(s)
        return d, s + size <= self.first[d] + self.count[d]


def _within(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """A stored positional index. (segment, ordinal) names a document row."""

    def __init__(self, at: Stored):
        self.at, self.spark = at, at.spark

    def documents(self) -> DataFrame:
        return self.at.df.where("ordinal is not null").select("segment", "ordinal", "doc_id", F.col("n").alias("n_words"))

    def lists(self) -> DataFrame:
        return self.at.df.where("term is not null")

    def _fetch(self, terms: np.ndarray, segments: DataFrame | None) -> DataFrame:
        """The lists of some terms (of a block of phrases), in the given segments with their documents, grouped by segment."""
        wanted = F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())}), "term long"))
        names = ["segment", "ordinal", "first", "term", "n", "postings"]
        got = self.lists().join(wanted, "term", "left_semi").select(*names)
        if segments is not None:
            got = got.union(self.at.df.where("ordinal is not null").select(*names)).join(segments, "segment", "left_semi")
        return got.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())

    def _search(self, phrases: DataFrame, find: Callable[[Segment, Plan], tuple[np.ndarray, np.ndarray, np.ndarray]], depth_two: bool, block: int) -> DataFrame:
        """(segment, ordinal, phrase, size, start): what ``find`` finds of ``phrases`` (phrase, terms), block by block."""
        ship(self.spark)
        distinct = Stored(self.spark, phrases.groupBy("phrase").agg(F.first("terms").alias("terms")), "phrases")
        n = max(1, -(-distinct.df.count() // block))
        out: list[Stored] = []
        for b in range(n):
            part = distinct.df.where(F.pmod("phrase", F.lit(n)) == b).toArrow()
            if not part.num_rows:
                continue
            terms = [np.frombuffer(x.as_buffer(), np.int64) for x in part["terms"].combine_chunks()]
            wanted = F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(np.unique(np.concatenate(terms)), pa.int64())}), "term long"))
            often = self.lists().select("term", "n").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toArrow()
            plan = Plan(part["phrase"].to_numpy(), terms, often["term"].to_numpy(), often["n"].to_numpy())
            if not len(plan.phrase):
                continue
            sent = self.spark.sparkContext.broadcast(plan)

            def rare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for g in groups(batches, "segment"):
                    s = Segment(g)
                    if len(s.phrases(sent.value, 2)[0] if depth_two else s.starts(sent.value)[0]):
                        yield pa.RecordBatch.from_arrays([g["segment"].chunk(0).slice(0, 1)], names=["segment"])

            def full(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for g in groups(batches, "segment"):
                    seg, p = Segment(g), sent.value
                    w, doc, start = find(seg, p)
                    order = np.lexsort((start, w, doc))
                    w, doc, start = w[order], doc[order], start[order]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(w), g["segment"][0].as_py()), pa.int64()), pa.array(seg.ordinal[doc], pa.int32()), pa.array(p.phrase[w], pa.int64()),
                         pa.array(p.size[w], pa.int32()), pa.array(start - seg.first[doc], pa.int64())], names=["segment", "ordinal", "phrase", "size", "start"])

            left = stored(self.spark, self._fetch(plan.words(2 if depth_two else 1), None).mapInArrow(rare, "segment long"), "segments")
            out.append(Stored(self.spark, self._fetch(plan.words(), left).mapInArrow(full, "segment long, ordinal int, phrase long, size int, start long"), "matches"))
        if not out:
            return self.spark.createDataFrame([], "segment long, ordinal int, phrase long, size int, start long")
        return self.spark.read.schema(out[0].schema).parquet(*[s.path for s in out])

    def phrases(self, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
        """(segment, ordinal, phrase, size, start): every exact occurrence; start counts the document's words from 0."""
        def find(s: Segment, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, at = s.phrases(p)
            doc, ok = s.inside(p.size[w], at)
            return w[ok], doc[ok], at[ok]

        return self._search(phrases, find, True, block)

    def near(self, phrases: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
        """(segment, ordinal, phrase, size, start): words of a phrase from which ``width`` words of the same document, in any
        order, hold every word of the phrase at least as often as the phrase."""
        def find(s: Segment, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, at = s.near(p, width)
            return w, s.document(at), at

        return self._search(phrases, find, False, block)


def covered(matches: DataFrame) -> DataFrame:
    """(segment, ordinal, n_hit, spans, phrases): per document the words inside any match, as maximal runs (start, end), and
    the phrases that match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "segment"):
            doc, start, size, phrase = (g[c].to_numpy() for c in ("ordinal", "start", "size", "phrase"))
            # documents lie apart by more than any of their words, so that one sweep serves all
            step = int((start + size).max()) + 1
            a, e = doc * step + start, doc * step + start + size
            high = np.maximum.accumulate(e)
            new = np.flatnonzero(np.concatenate(([True], a[1:] > high[:-1])))
            lo, hi = a[new], high[np.append(new[1:], len(a)) - 1]
            of = lo // step
            docs, at = np.unique(of, return_index=True)
            edge = np.append(at, len(of)).astype(np.int32)
            pair = np.unique(np.stack([doc.astype(np.int64), phrase]), axis=1)
            cut = np.searchsorted(pair[0], np.append(docs, docs[-1] + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(lo - of * step), pa.array(hi - of * step)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), g["segment"][0].as_py()), pa.int64()), pa.array(docs, pa.int32()), pa.array(np.add.reduceat(hi - lo, at), pa.int64()),
                 spans, pa.ListArray.from_arrays(pa.array(cut), pa.array(pair[1]))], names=["segment", "ordinal", "n_hit", "spans", "phrases"])

    schema = "segment long, ordinal int, n_hit long, spans array<struct<start:long,end:long>>, phrases array<long>"
    return matches.repartition("segment").sortWithinPartitions("segment", "ordinal", "start").mapInArrow(run, schema)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, segment_words: int = SEGMENT_WORDS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, spans (the hit words), items (sorted, as strings)."""
    index = build(spark, docs, segment_words)
    asked = Stored(spark, windows(items, window), "windows")
    hits = stored(spark, covered(index.phrases(asked.df, block)), "hits")
    of = asked.df.where("item_id is not null").select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    if asked.df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        of = F.broadcast(of)
    named = (hits.select("segment", "ordinal", F.explode("phrases").alias("phrase")).join(of, "phrase")
             .groupBy("segment", "ordinal").agg(F.sort_array(F.collect_set("item")).alias("items")))
    out = index.documents().join(hits.select("segment", "ordinal", "n_hit", "spans"), ["segment", "ordinal"], "left").join(named, ["segment", "ordinal"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM benchmark),
q AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM q),
g AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
m AS (SELECT r, k, i, item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM g) JOIN p USING (k, phrase)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, k, i FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
