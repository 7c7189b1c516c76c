"""Numpy over Arrow text columns: words, lines and rolling hashes of many texts at once.

A column of texts is taken in slices of a megabyte (whole texts; one longer
text is a slice by itself), so that the 8-byte arrays per text byte stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)   # odd, so that its powers have inverses modulo 2^64
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)
        down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


class Texts:
    """Texts as one byte array with offsets (null: empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    @staticmethod
    def of(arr: pa.Array) -> Texts:
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string())
        if arr.null_count:
            arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
        return Texts(data[off[0]:off[-1]] if len(off) else data[:0], off - off[0] if len(off) else np.zeros(1, np.int64))

    def slices(self, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
        """(first, last + 1, texts) of whole texts, about ``size`` bytes each."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + size, "right")) - 1)
            yield i, j, Texts(self.data[self.offsets[i]:self.offsets[j]], self.offsets[i:j + 1] - self.offsets[i])
            i = j

    def lower_ascii(self) -> Texts:
        up = (self.data >= 65) & (self.data <= 90)
        return Texts(self.data + (up.astype(np.uint8) << 5), self.offsets)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def white(self) -> np.ndarray:
        return (self.data == 32) | ((self.data >= 9) & (self.data <= 13))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of the maximal runs of ``inside`` bytes that don't cross texts."""
        n = len(inside)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, self.doc_of(starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~self.white())

    def prefix_hash(self) -> np.ndarray:
        """P with P[j] - P[i] the polynomial of bytes i to j, times the base to the i."""
        up, _ = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * up[:len(self.data)], out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span: equal spans have equal hashes wherever they are."""
        _, down = _powers(len(prefix))
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * _MUL)


def shingle_hashes(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every k-word window inside a text; of a text with fewer words but
    at least one, its whole sequence."""
    n = len(word_hash)
    counts = np.bincount(doc, minlength=n_docs)
    h = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        h = h * _BASE + word_hash[i:n - k + 1 + i] if len(h) else h
    ok = doc[:n - k + 1] == doc[k - 1:] if n >= k else np.zeros(0, bool)
    hashes, docs = mix64(h[ok]), doc[:n - k + 1][ok] if n >= k else doc[:0]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        at = np.concatenate(([0], np.cumsum(counts)))
        extra = np.array([_sequence(word_hash[at[d]:at[d + 1]], k) for d in short], np.uint64)
        hashes, docs = np.concatenate((hashes, extra)), np.concatenate((docs, short))
    return hashes, docs


def _sequence(words: np.ndarray, k: int) -> np.uint64:
    h = int(len(words)) * int(_MUL)
    for w in words:
        h = (h * int(_BASE) + int(w)) & (2**64 - 1)
    return mix64(np.array([h ^ k], np.uint64))[0]


def sorted_unique(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, ordered by text, then hash."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(docs[order], kind="stable")]
    h, d = hashes[order], docs[order]
    if not len(h):
        return h, d
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    return h[new], d[new]
