"""Operator 2, quality rules: base rules on words, symbols and repeats, then a logistic
regression over hashed word and character n-grams, trained on labelled quality rows,
probability-calibrated, scored in Arrow batches against a fixed threshold.

The features of a text are the frequencies of its hashed words and of its hashed
3-byte strings; a score is thus a mean of table entries and any text, however long, is
scored whole in bounded memory. At most ``MAX_LABELLED`` labelled rows of each class, the
first in the order of a hash of the doc_id, are used to fit: three of four fit the weights,
the rest the calibration. Calibrated probabilities refer to the class shares among all labelled rows.

Defined results: null or empty text has no words and fails the base rules; a null or
repeated doc_id is scored row by row (a label counts for each row of its doc_id); null
labels are left out; without both classes among the labels the probability is the share
of the known class, or 1 without any; an empty table gives an empty table; input columns are kept,
but for those named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored, table, with_fields, without
from ledgerlens.llm.textarrays import Texts, mix64

WORD_BITS, CHAR_BITS = 11, 12
MAX_LABELLED = 1500
KEEP_FROM = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
OUTPUTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "base_failed": "boolean", "quality": "double", "kept": "boolean"}


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's bytes."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def group_counts(keys: np.ndarray) -> np.ndarray:
    """How often each value occurs, for every element."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


def base_counts(t: Texts, starts: np.ndarray, doc: np.ndarray, prefix: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of a slice of texts; ``words``: the words' hashes."""
    white = t.white()
    out = {"n_words": np.bincount(doc, minlength=t.n),
           "word_chars": per_text(~white & ((t.data & 0xC0) != 0x80), t.offsets),
           "n_symbols": per_text(_SYMBOL[t.data], t.offsets)}
    a, b, d = t.spans(t.data != 10)
    solid = np.concatenate(([0], np.cumsum(~white)))
    some = solid[b] > solid[a]
    a, b, d = a[some], b[some], d[some]
    key = mix64(Texts.span_hash(prefix, a, b) + d.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(d, minlength=t.n) - np.bincount(d[first], minlength=t.n)
    again = np.zeros(len(words), bool)
    if len(words) >= 3:
        same = doc[:-2] == doc[2:]
        h = (words[:-2] * np.uint64(31) + words[1:-1]) * np.uint64(1_000_003) + words[2:]
        at = np.flatnonzero(same)
        twice = at[group_counts(mix64(h[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >= 2]
        for i in range(3):
            again[twice + i] = True
    out["n_repeat_words"] = np.bincount(doc[again], minlength=t.n)
    return out


def ngram_index(t: Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the words, of the 3-byte strings, and whether a 3-byte string lies within one text (by its first byte)."""
    w = (words >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    d = t.data.astype(np.uint32)
    c = np.zeros(len(d), np.int32)
    ok = np.zeros(len(d), bool)
    if len(d) >= 3:
        c[:-2] = (((d[:-2] * np.uint32(0x9E3779B1) + d[1:-1]) * np.uint32(0x85EBCA77) + d[2:]) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - CHAR_BITS)
        ok[:-2] = True
        edge = np.concatenate((t.offsets[1:] - 1, t.offsets[1:] - 2))
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return w, c, ok


def parts(texts: Texts) -> Iterator[tuple[int, int, Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, t in texts.slices():
        starts, ends, doc = t.words()
        prefix = t.prefix_hash()
        yield i, j, t, starts, doc, prefix, Texts.span_hash(prefix, starts, ends)


def frequencies(texts: Texts) -> np.ndarray:
    """One row of feature frequencies per text (float32)."""
    nw, nc = 1 << WORD_BITS, 1 << CHAR_BITS
    out = np.zeros((texts.n, nw + nc), np.float32)
    for i, j, t, _, doc, _, words in parts(texts):
        w, c, ok = ngram_index(t, words)
        byte_doc = np.repeat(np.arange(t.n), np.diff(t.offsets))
        a = np.bincount(doc * nw + w, minlength=t.n * nw).reshape(t.n, nw)
        b = np.bincount(byte_doc[ok] * nc + c[ok], minlength=t.n * nc).reshape(t.n, nc)
        out[i:j, :nw] = a / np.maximum(a.sum(1, keepdims=True), 1)
        out[i:j, nw:] = b / np.maximum(b.sum(1, keepdims=True), 1)
    return out


class Model:
    """Weights per feature frequency, calibration logit = slope * score + shift."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights.astype(np.float64), slope, shift

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))

    def scores(self, t: Texts, doc: np.ndarray, words: np.ndarray) -> np.ndarray:
        w, c, ok = ngram_index(t, words)
        word = np.bincount(doc, self.weights[w], t.n) / np.maximum(np.bincount(doc, minlength=t.n), 1)
        char = self.weights[(1 << WORD_BITS) + c] * ok
        return word + per_text(char, t.offsets) / np.maximum(per_text(ok, t.offsets), 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 250) -> np.ndarray:
    """Weights on the columns of ``x``, which are scaled by their deviation for the fit (accelerated gradient descent)."""
    scale = 1 / (x.std(0) + 1e-4)
    mean = x.mean(0)
    z = ((x - mean) * scale).astype(np.float32)
    w = v = np.zeros(z.shape[1], np.float32)
    b = 0.0
    rate = 4.0 / max(1.0, float(np.linalg.norm(z[:256], 2) ** 2) / min(len(z), 256))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30)))
        g = z.T @ (p - y) / len(y) + l2 * v
        nxt = v - rate * g
        v = nxt + k / (k + 3) * (nxt - w)
        w = nxt
        b -= rate * float((p - y).mean())
    return w * scale


def calibrate(score: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Platt's slope and shift, moved from the sample's class share to ``share``."""
    hit = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = score.std() + 1e-12
    s = (score - score.mean()) / spread
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        r, q = p - hit, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * s).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(q * s * s).sum() + 1e-3, (q * s).sum()], [(q * s).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    own = y.mean()
    move = np.log(share / (1 - share)) - np.log(own / (1 - own))
    return a / spread, b - a * score.mean() / spread + move


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    ship(spark)
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"))
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    blank = np.zeros((1 << WORD_BITS) + (1 << CHAR_BITS))
    if len(n) < 2:
        p = 1 - 1e-9 if 0 not in n else 1e-9
        return Model(blank, 0.0, float(np.log(p / (1 - p))))
    sample = None
    for y in (0, 1):
        top = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
        sample = top if sample is None else sample.union(top)
    # at most 2 * max_labelled ids, and of rows that share one the text with the smallest hash, drawn before any feature is made
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    drawn = stored(spark, named.groupBy("doc_id", "__y").agg(F.min("th").alias("th")), "drawn")
    one = (docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(F.broadcast(drawn), ["doc_id", "th"])
           .groupBy("doc_id", "th", "__y").agg(F.first("text").alias("text")))
    rows = one.select(F.col("__y").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)).alias("fold"), "text", F.xxhash64("doc_id").alias("o"), "th")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = frequencies(Texts.of(part.column("text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("y", "fold", "o", "th")], pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "fold", "o", "th", "x"])

    got = rows.mapInArrow(vectors, "y int, fold long, o long, th long, x binary").toArrow().sort_by([("o", "ascending"), ("th", "ascending"), ("y", "ascending")])
    x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in got["x"]]) if len(got) else np.zeros((0, len(blank)), np.float32)
    y = got["y"].to_numpy().astype(np.float64)
    held = got["fold"].to_numpy() == 0
    share = n[1] / (n[0] + n[1])
    if min((y[held] == 0).sum(), (y[held] == 1).sum(), (y[~held] == 0).sum(), (y[~held] == 1).sum()) == 0:
        held = np.zeros(len(y), bool)
    if not len(y) or y.min() == y.max():
        return Model(blank, 0.0, float(np.log(share / (1 - share))))
    w = fit_logistic(x[~held], y[~held])
    score = x[held if held.any() else ~held] @ w
    return Model(w, *calibrate(score.astype(np.float64), y[held if held.any() else ~held], share))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the base counts, the calibrated probability of good quality and kept."""
    ship(spark)
    keep = without(docs, *OUTPUTS)
    rest = docs.select(*[f"`{c}`" for c in keep])
    at = [c.lower() for c in keep].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = Texts.of(b.column(at))
            got: dict[str, list] = {k: [] for k in OUTPUTS}
            for _, _, t, starts, doc, prefix, words in parts(texts):
                c = base_counts(t, starts, doc, prefix, words)
                p = np.round(model.probability(model.scores(t, doc, words)), 9)
                bad = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                for k, v in (c | {"base_failed": bad, "quality": p, "kept": ~bad & (p >= keep_from)}).items():
                    got[k].append(v)
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            new = [pa.array(np.concatenate(got[k]) if got[k] else [], kinds[v]) for k, v in OUTPUTS.items()]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*keep, *OUTPUTS])

    return rest.mapInArrow(run, with_fields(rest, OUTPUTS))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels"))
    return score(spark, docs, model).drop("text")
