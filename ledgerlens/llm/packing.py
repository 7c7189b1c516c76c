"""Operator 9, packing: harmonic packing. Lengths fall into reciprocal-capacity
classes - class k holds lengths over capacity / (k + 1), up to capacity / k - and
each class fills its sequences with k pieces, independently in every worker group.

Documents may be cut, so a remainder of ``min_cut`` tokens or more is cut to the
largest capacity / k that fits it and again, until a short rest is left: the pieces of
classes up to capacity / min_cut then fill their sequences to within k - 1 tokens. A
class's last, incomplete sequence in a group goes to one first-fit-decreasing pass over
the group's leftovers.

A document is its token ids and then ``end_id``. Each id lies in one piece. A sequence is
padded to ``capacity``, unless its length is a power of two.

Defined results: null or empty text is the end id alone; equal rows are separate
documents; a null doc_id is kept; an empty table gives an empty table; other input
columns are not read.

Scale: tokens are made and cut in one pass over the texts in Arrow batches; only the
pieces' numbers (and, if asked for, their ids) are written and shuffled. Groups are
hash classes of pieces, which are numbered by task, of about ``group_tokens`` tokens: neither a long document
nor equal documents or rows without doc_id gather in one; a piece is never longer than a sequence.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, ship, stored, table
from ledgerlens.llm.textarrays import Texts

CAPACITY = 2048
MIN_CUT = 128
END_ID = 1
GROUP_TOKENS = 2_000_000
VOCABULARY = "word_bpe_49k.json"

#: Bytes of text taken at once (their arrays take some 100 bytes each), and pieces of words whose ids a Python worker keeps (about 100 MB).
TEXT_BYTES = 512 << 10
KNOWN_PIECES = 1_000_000
#: Classes of bytes in words that are cut here as the tokenizer cuts them: letters (ASCII, and U+00C0 to U+024F in two
#: bytes), digits, other ASCII.
LETTER, DIGIT, OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
_TOKENIZERS: dict[str, WordTokenizer] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of white-space separated words. The tokenizer lower-cases words, cuts them where letters, single digits and other
    characters meet, and encodes these pieces independently of each other, so each distinct piece is encoded once. The ids
    of known pieces are kept by the piece's 64-bit hash; words with apostrophes or characters of other scripts
    are one piece each, which the tokenizer cuts itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        vocab = self.tk.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def keep(self, known: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """``known`` hashes in order, how many ids each has, and all ids."""
        self.known, self.count, self.ids = known, count, ids
        self.first = np.cumsum(count) - count

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def pieces(self, new: list[str]) -> list[bytes]:
        """The ids of pieces that the tokenizer doesn't cut."""
        out: list[bytes] = []
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            runs = [part[j:j + 400] for j in range(0, len(part), 400)]
            for run, e in zip(runs, self.tk.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) != len(run) or stop[-1] != len(ids):
                    out += [self.whole(p) for p in run]
                    continue
                raw, at = ids.tobytes(), 0
                for s in (stop * 4).tolist():
                    out.append(raw[at:s])
                    at = s
        return out

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(text, place among the known) of every piece of the texts."""
        starts, ends, cut = word_pieces(texts)
        low = texts.data + (((texts.data >= 65) & (texts.data <= 90) & cut).astype(np.uint8) << 5)
        lowered = Texts(low, texts.offsets)
        coded = pa.array(Texts.span_hash(lowered.prefix_hash(), starts, ends)).dictionary_encode()
        met, which = coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False)
        at = self.places(met)
        new = np.flatnonzero(at < 0)
        if len(new):
            # a place of each new piece in the texts
            example = np.empty(len(met), np.int64)
            example[which] = np.arange(len(which))
            k = example[new]
            raw = low.tobytes()
            words = [raw[a:e].decode("utf-8", "replace").lower() if c else raw[a:e].decode("utf-8", "replace")
                     for a, e, c in zip(starts[k].tolist(), ends[k].tolist(), cut[starts[k]].tolist())]
            plain = cut[starts[k]]
            found = np.empty(len(new), object)
            found[plain] = self.pieces([w for w, c in zip(words, plain.tolist()) if c])
            found[~plain] = [self.whole(w) for w, c in zip(words, plain.tolist()) if not c]
            if len(self.known) + len(new) > KNOWN_PIECES:
                # what these texts have stays
                use = np.sort(at[at >= 0])
                n = self.count[use]
                self.keep(self.known[use], n, self.ids[np.repeat(self.first[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            known = np.concatenate((self.known, met[new]))
            count = np.concatenate((self.count, np.fromiter((len(b) >> 2 for b in found), np.int64, len(found))))
            ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), np.uint32)))
            order = np.argsort(known, kind="stable")
            first, n = (np.cumsum(count) - count)[order], count[order]
            self.keep(known[order], n, ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            at = self.places(met)
        return texts.doc_of(starts), at[which]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)


def word_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all words, and for each byte whether its word is cut here."""
    data = texts.data
    kind = _CLASS[data]
    before, after = np.concatenate(([np.uint8(0)], data[:-1])), np.concatenate((data[1:], [np.uint8(0)]))
    inside = ~texts.white()
    starts, ends, _ = texts.spans(inside)
    # U+00D7, U+00F7, U+0130 and what lies beyond U+024F are no plain letters; special tokens begin with <|
    odd = inside & ((kind == 0) | (data == 39) | ((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0xC4) & (data == 0xB0))
           | ((before == 0xC9) & (data > 0x8F)) | ((data == 60) & (after == 124)))
    bad = np.add.reduceat(odd, starts) > 0 if len(starts) else np.zeros(0, bool)
    plain = np.zeros(len(data), bool)
    plain[inside] = np.repeat(~bad, ends - starts)
    first = np.zeros(len(data), bool)
    first[starts] = True
    kind_before = np.concatenate(([np.uint8(0)], kind[:-1]))
    new = np.flatnonzero(first | (plain & ((kind != kind_before) | (kind == DIGIT))))
    # a piece ends where its word ends or the next piece begins
    stop = np.append(new[1:], len(data))
    return new, np.minimum(stop, ends[np.cumsum(first)[new] - 1]) if len(new) else stop[:0], plain


def cut_lengths(n: int, capacity: int, min_cut: int) -> list[int]:
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= min_cut:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


def token_ids(texts: Texts, tokenizer: WordTokenizer, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each text."""
    doc, place = tokenizer.encode(texts)
    at = np.searchsorted(doc, np.arange(texts.n + 1))
    step = 200_000
    i = 0
    while i < texts.n:
        # some texts at once, about `step` pieces
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        w = place[at[i]:at[j]]
        c = tokenizer.count[w]
        stop = np.cumsum(c)
        ids = tokenizer.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(tokenizer.first[w] - (stop - c), c)]
        edge = np.concatenate(([0], stop))[at[i:j + 1] - at[i]]
        for d in range(i, j):
            yield d, np.append(ids[edge[d - i]:edge[d - i + 1]], np.uint32(end_id))
        i = j


def piece_table(docs: DataFrame, path: str, capacity: int, min_cut: int, end_id: int, with_ids: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        piece = TaskContext.get().partitionId() << 40
        for b in batches:
            # a slice of the texts at once: neither their arrays nor their ids gather for a whole batch
            for first, _, texts in Texts.of(b.column("text")).slices(TEXT_BYTES):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for d, ids in token_ids(texts, _TOKENIZERS[path], end_id):
                    raw, at = ids.astype("<u4").tobytes(), 0
                    for n in cut_lengths(len(ids), capacity, min_cut):
                        row.append(first + d)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(raw[4 * at:4 * (at + n)])
                        at += n
                out = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(piece, piece + len(row)))]
                piece += len(row)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
                if with_ids:
                    out, names = [*out, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, piece long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def first_fit(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Leftover pieces of one group, longest first, each to the first sequence with room."""
    pdf = pdf.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
    used: list[int] = []
    seq, at, first = [], [], 0
    for n in pdf["length"].tolist():
        i = first
        while i < len(used) and used[i] + n > capacity:
            i += 1
        if i == len(used):
            used.append(0)
        seq.append(i)
        at.append(used[i])
        used[i] += n
        while first < len(used) and used[first] == capacity:
            first += 1
    return pdf.assign(sequence_id=(pdf["grp"].to_numpy(np.int64) << 32) + np.array(seq, np.int64), offset=np.array(at, np.int64))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, min_cut: int = MIN_CUT, end_id: int = END_ID,
         group_tokens: int = GROUP_TOKENS, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, little-endian unsigned 32-bit, ``with_ids``)."""
    ship(spark)
    path = vocabulary or vocabulary_path()
    pieces = Stored(spark, piece_table(docs, path, capacity, min_cut, end_id, with_ids), "pieces")
    # ids stay where they are until every piece has its place
    names = [n for n in pieces.schema.names if n != "ids"]
    tokens = pieces.df.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    p = (pieces.df.select(*names).withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("long"))
         .withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long")))
    one = Window.partitionBy("grp", "k")
    p = (p.withColumn("rn", F.row_number().over(one.orderBy("piece")) - 1)
         .withColumn("n", F.count(F.lit(1)).over(one))
         .withColumn("bin", F.floor(F.col("rn") / F.col("k")).cast("long")))
    p = stored(spark, p, "classes")
    full = F.col("bin") < F.floor(F.col("n") / F.col("k"))
    inside = Window.partitionBy("grp", "k", "bin").orderBy("rn")
    harmonic = (p.where(full)
                .withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
                .withColumn("sequence_id", F.shiftleft("grp", 32) + F.shiftleft("k", 20) + F.col("bin"))
                .select(*names, "sequence_id", "offset"))
    fields = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        return first_fit(pdf, capacity)[[*names, "sequence_id", "offset"]]

    rest = p.where(~full).select(*names, "grp").groupBy("grp").applyInPandas(left, f"{fields}, sequence_id long, offset long")
    out = harmonic.union(rest)
    if with_ids:
        out = out.join(pieces.df.select("piece", "ids"), "piece")
    return out.drop("piece")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the padded sequences of pieces packed ``with_ids``. A sequence is one
    group of at most ``capacity`` tokens."""
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4").astype(np.int64)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate((ids, np.full(capacity - len(ids), pad_id, np.int64)))
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
