"""Operator 8, toxicity: a bidirectional gated recurrent network with attention pooling
over character and word inputs, trained in numpy, scoring all overlapping windows.

A word is a run of letters, digits and non-ASCII bytes, A-Z lower-cased. Its input is a
hashed word vector beside the mean of its hashed 3-byte strings' vectors. A text is cut to
windows of ``WINDOW`` words, ``STRIDE`` apart, the last one ending with the text, so that each passage
of up to WINDOW - STRIDE + 1 words lies whole in one; every window is scored and a text's score is its highest window, calibrated to a probability.

Fitting takes a bounded sample of labelled rows: of each class the first
``MAX_LABELLED`` in the order of a hash of the doc_id, texts of any length; rows held out
(crc32 of the doc_id mod 5 is 0) are never used. Of a text with more, ``FIT_WINDOWS`` windows, spread evenly over its whole
length, are learned from (fewer where they hold over ``FIT_BYTES``; words count to ``FIT_WORD`` bytes there). A toxic
text teaches through the highest of them, any other through the highest and a random one.
One row in four is kept for the calibration, by the score of its whole text.

Defined results: texts without a word, empty and null ones get the share of toxic
labels; a null doc_id is not held out and has no label; null labels are left out; without
both classes all scores are that share (0 without labels); equal rows are scored alike; an empty
table gives an empty table; only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, table, with_fields, without
from ledgerlens.llm.quality_rules import calibrate
from ledgerlens.llm.textarrays import Texts

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS, DIM, HIDDEN = 13, 13, 8, 8
MAX_LABELLED = 3000
FIT_WINDOWS, FIT_BYTES, FIT_WORD = 24, 16384, 256
EPOCHS = 12
BATCH = 4096
SEED = 5

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts: of every distinct word its vector numbers, of every
    occurrence its distinct word and text."""

    def __init__(self, texts: Texts):
        found = []
        for i, _, t in texts.slices():          # 8 bytes per text byte for a slice at a time
            t = t.lower_ascii()
            starts, ends, doc = t.spans(_WORD[t.data])
            found.append((starts + texts.offsets[i], (ends - starts).astype(np.int32), doc + i, Texts.span_hash(t.prefix_hash(), starts, ends)))
        starts, lengths, self.doc, h = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, k) for k in (np.int64, np.int32, np.int64, np.uint64))
        del found
        distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
        del h
        self.at = at.astype(np.int32)
        self.word = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        a, size = starts[first], lengths[first].astype(np.int64)
        # 3-byte strings around each byte of a word, 0 outside the word
        self.owner = np.repeat(np.arange(len(size)), size)
        stop = np.cumsum(size)
        k = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
        pos = np.repeat(a, size) + k
        # only the distinct words' bytes, side by side
        data = np.append(_LOWER[texts.data[pos]].astype(np.uint32), np.uint32(0))
        near = np.arange(len(pos))
        left = np.where(k > 0, data[near - 1], 0)
        right = np.where(k + 1 < np.repeat(size, size), data[near + 1], 0)
        mixed = ((left * np.uint32(0x9E3779B1) + data[:-1]) * np.uint32(0x85EBCA77) + right) * np.uint32(0xC2B2AE3D)
        self.char = (mixed >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
        self.size, self.n_texts = size, texts.n

    def subset(self, ids: np.ndarray) -> tuple[Words, np.ndarray]:
        """The distinct words among ``ids`` alone, and ``ids`` numbered among them."""
        some, again = np.unique(ids, return_inverse=True)
        out = object.__new__(Words)
        out.word, out.size = self.word[some], self.size[some]
        begin = (np.cumsum(self.size) - self.size)[some]
        out.owner = np.repeat(np.arange(len(some)), out.size)
        out.char = self.char[np.arange(len(out.owner)) + np.repeat(begin - (np.cumsum(out.size) - out.size), out.size)]
        return out, again.reshape(ids.shape)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word numbers (window, WINDOW), whether a place holds a word, and each window's text."""
        n = np.bincount(self.doc, minlength=self.n_texts)
        per = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
        doc = np.repeat(np.arange(self.n_texts), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.minimum(nth * STRIDE, np.maximum(n[doc] - WINDOW, 0)).astype(np.int32)
        place = begin[:, None] + np.arange(WINDOW, dtype=np.int32)
        real = place < n[doc][:, None]
        place += (np.cumsum(n) - n)[doc].astype(np.int32)[:, None]
        ids = self.at[np.minimum(place, max(len(self.at) - 1, 0), out=place)] if len(doc) else np.zeros((0, WINDOW), np.int32)
        return np.where(real, ids, 0), real, doc


def _sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """rows added up by index."""
    return np.stack([np.bincount(index, rows[:, j], size) for j in range(rows.shape[1])], 1).astype(np.float32)


class Network:
    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        h = HIDDEN
        normal = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": normal(1 << WORD_BITS, DIM, scale=0.1), "char": normal(1 << CHAR_BITS, DIM, scale=0.3),
            "wf": normal(2 * DIM, 3 * h, scale=0.4), "wb": normal(2 * DIM, 3 * h, scale=0.4),
            "uf": normal(h, 3 * h, scale=0.35), "ub": normal(h, 3 * h, scale=0.35),
            "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
            "att": normal(2 * h, 2 * h, scale=0.35), "attb": np.zeros(2 * h, np.float32), "attv": normal(2 * h, scale=0.5),
            "out": normal(2 * h, scale=0.5), "outb": np.zeros(1, np.float32),
        }
        self.slope, self.shift, self.share = 1.0, 0.0, 0.0

    def inputs(self, w: Words) -> np.ndarray:
        char = _sums(w.owner, self.p["char"][w.char], len(w.size)) / w.size[:, None].astype(np.float32) if len(w.size) else np.zeros((0, DIM), np.float32)
        return np.concatenate((self.p["word"][w.word], char), 1)

    @staticmethod
    def _run(proj: np.ndarray, u: np.ndarray, ids: np.ndarray, real: np.ndarray | None, steps: range, keep: list | None) -> np.ndarray:
        """Hidden states (time, window, HIDDEN) of one direction."""
        h = HIDDEN
        state = np.zeros((ids.shape[1], h), np.float32)
        out = np.empty((len(ids), ids.shape[1], h), np.float32)
        for t in steps:
            x = proj[ids[t]]
            hu = state @ u
            gates = x[:, :2 * h] + hu[:, :2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[:, 2 * h:] + r * hu[:, 2 * h:])
            new = n + z * (state - n)
            if real is not None:
                new = np.where(real[t][:, None], new, state)
            if keep is not None:
                keep.append((t, state, hu, z, r, n))
            state = out[t] = new
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window logits; x: inputs of the distinct words, ids and real: (window, WINDOW)."""
        p, ids, full = self.p, np.ascontiguousarray(ids.T), bool(real.all())
        mask = None if full else np.ascontiguousarray(real.T)
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._run(x @ p["wf"] + p["bf"], p["uf"], ids, mask, range(len(ids)), kf)
        hb = self._run(x @ p["wb"] + p["bb"], p["ub"], ids, mask, range(len(ids) - 1, -1, -1), kb)
        h = np.concatenate((hf, hb), 2)
        a = np.tanh(h @ p["att"] + p["attb"])
        e = a @ p["attv"]
        if not full:
            e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tbh,tb->bh", h, e)
        if keep is not None:
            keep.update(ids=ids, mask=mask, kf=kf, kb=kb, h=h, a=a, e=e, pooled=pooled)
        return pooled @ p["out"] + p["outb"][0]

    def gradient(self, w: Words, x: np.ndarray, ids: np.ndarray, real: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, k = self.p, {}
        logit = self.forward(x, ids, real, k)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target) * weight).astype(np.float32)
        g = {"out": k["pooled"].T @ d, "outb": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["out"]
        de = np.einsum("tbh,bh->tb", k["h"], dpool)
        ds = k["e"] * (de - (k["e"] * de).sum(0))
        da = ds[:, :, None] * p["attv"] * (1 - k["a"] ** 2)
        dh = k["e"][:, :, None] * dpool + da @ p["att"].T
        flat = lambda v: v.reshape(-1, v.shape[-1])
        g["attv"] = flat(k["a"]).T @ ds.reshape(-1)
        g["att"], g["attb"] = flat(k["h"]).T @ flat(da), flat(da).sum(0)
        dx = np.zeros_like(x)
        for side, kept, part in (("f", k["kf"], dh[:, :, :HIDDEN]), ("b", k["kb"], dh[:, :, HIDDEN:])):
            u, carry = p["u" + side], np.zeros((ids.shape[0], HIDDEN), np.float32)
            gu = np.zeros_like(u)
            dproj = np.zeros((len(k["ids"]), ids.shape[0], 3 * HIDDEN), np.float32)
            for t, state, hu, z, r, n in reversed(kept):
                dn_h = part[t] + carry
                if k["mask"] is not None:
                    m = k["mask"][t][:, None]
                    skip, dn_h = np.where(m, 0, dn_h), np.where(m, dn_h, 0)
                else:
                    skip = 0
                dn = dn_h * (1 - z) * (1 - n * n)
                dz = dn_h * (state - n) * z * (1 - z)
                dr = dn * hu[:, 2 * HIDDEN:] * r * (1 - r)
                dproj[t] = np.concatenate((dz, dr, dn), 1)
                dhu = np.concatenate((dz, dr, dn * r), 1)
                gu += state.T @ dhu
                carry = dn_h * z + dhu @ u.T + skip
            per_word = _sums(k["ids"].reshape(-1), flat(dproj), len(x))
            g["u" + side], g["b" + side] = gu, flat(dproj).sum(0)
            g["w" + side] = x.T @ per_word
            dx += per_word @ p["w" + side].T
        g["word"] = _sums(w.word, dx[:, :DIM], 1 << WORD_BITS)
        g["char"] = _sums(w.char, (dx[:, DIM:] / w.size[:, None])[w.owner], 1 << CHAR_BITS)
        return g

    def logits(self, x: np.ndarray, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.float32)
        whole = real[:, -1] if len(ids) else np.zeros(0, bool)
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(group), BATCH):
                at = group[i:i + BATCH]
                out[at] = self.forward(x, ids[at], real[at])
        return out

    def text_logits(self, texts: Texts) -> np.ndarray:
        """The highest window of every text; NaN without words."""
        out = np.full(texts.n, np.nan)
        for i, j, t in texts.slices(1 << 20):
            w = Words(t)
            ids, real, doc = w.windows()
            if not len(doc):
                continue
            best = np.full(t.n, -np.inf)
            np.maximum.at(best, doc, self.logits(self.inputs(w), ids, real))
            out[i:j] = np.where(np.isfinite(best), best, np.nan)
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(logit) + self.shift, -40, 40)))
        return np.where(np.isnan(logit), self.share, p)


def drawn_windows(texts: Texts) -> Iterator[tuple[int, int, bytes]]:
    """(text, window, its words) of at most ``FIT_WINDOWS`` windows of each text."""
    for i, _, t in texts.slices():
        t = t.lower_ascii()
        starts, ends, doc = t.spans(_WORD[t.data])
        first = np.searchsorted(doc, np.arange(t.n + 1))
        for k in range(t.n):
            a, n = int(first[k]), int(first[k + 1] - first[k])
            if not n:
                continue
            per = max(-(-(n - WINDOW) // STRIDE), 0) + 1
            mean = WINDOW * (np.minimum(ends[a:a + n] - starts[a:a + n], FIT_WORD).mean() + 1)
            nth = np.unique(np.linspace(0, per - 1, max(1, min(per, FIT_WINDOWS, int(FIT_BYTES / mean)))).round().astype(np.int64))
            for j in nth.tolist():
                at = a + min(j * STRIDE, max(n - WINDOW, 0))
                end = min(at + WINDOW, a + n)
                yield i + k, j, b" ".join(t.data[s:min(e, s + FIT_WORD)].tobytes() for s, e in zip(starts[at:end].tolist(), ends[at:end].tolist()))


def train(texts: Texts, y: np.ndarray, held: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, owner: np.ndarray | None = None) -> Network:
    """A network fitted to the texts that are not ``held``; ``owner`` has (rising) the text of y and held that each of ``texts`` is a part of."""
    net, g = Network(seed), np.random.default_rng(seed)
    w = Words(texts)
    ids, real, doc = w.windows()
    doc = doc if owner is None else owner[doc]
    used = ~held[doc]
    first = np.searchsorted(doc, np.arange(len(y)))
    count = np.bincount(doc, minlength=len(y))
    fit_docs = np.flatnonzero(~held & (count > 0))
    if not len(fit_docs) or len(set(y[fit_docs])) < 2:
        return net
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    balance = np.where(y == 1, 0.5 / max((y[fit_docs] == 1).mean(), 1e-3), 0.5 / max((y[fit_docs] == 0).mean(), 1e-3))
    for epoch in range(epochs):
        logit = np.full(len(doc), -np.inf, np.float32)
        at = np.flatnonzero(used)
        logit[at] = net.logits(net.inputs(w), ids[at], real[at])
        order = np.lexsort((-logit, doc))
        best = order[first[fit_docs]]
        calm = fit_docs[y[fit_docs] == 0]
        other = first[calm] + g.integers(0, count[calm])
        chosen = np.concatenate((best, other))
        weight = np.concatenate((balance[fit_docs], balance[calm]))
        mixed = g.permutation(len(chosen))
        rate = 0.01 * (1 - 0.9 * epoch / epochs)
        for i in range(0, len(mixed), 256):
            part = mixed[i:i + 256]
            sel = chosen[part]
            words, own = w.subset(ids[sel])
            grad = net.gradient(words, net.inputs(words), own, real[sel], y[doc[sel]], weight[part] / len(part))
            step += 1
            for k, v in grad.items():
                a, b = m[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                net.p[k] -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS) -> Network:
    known = (labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
             .select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")))
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    net = Network()
    net.share = n.get(1, 0) / max(sum(n.values()), 1)
    net.slope, net.shift = 0.0, float(np.log(max(net.share, 1e-9) / max(1 - net.share, 1e-9)))
    if len(n) < 2:
        return net
    sample = None
    for y in (0, 1):
        top = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
        sample = top if sample is None else sample.union(top)
    # at most 2 * max_labelled ids; what comes to the driver of each text is bounded too
    ship(spark)
    rows = docs.select(F.col("doc_id").alias("__id"), "text", F.xxhash64("text").alias("__th"))
    got = rows.join(F.broadcast(sample), "__id").select("__id", "__th", "__y").distinct().orderBy("__id", "__th", "__y").limit(4 * max_labelled).toArrow().sort_by([("__id", "ascending"), ("__th", "ascending"), ("__y", "ascending")])
    y = got["__y"].to_numpy().astype(np.int64)
    held = np.arange(len(y)) % 4 == 0
    if min([((y == a) & (held == b)).sum() for a in (0, 1) for b in (False, True)]) == 0:
        return net

    def of(which: np.ndarray) -> DataFrame:
        at = np.flatnonzero(which)
        keys = spark.createDataFrame(got.select(["__id", "__th"]).take(pa.array(at)).append_column("nth", pa.array(at, pa.int64())))
        return rows.join(F.broadcast(keys), ["__id", "__th"]).select("nth", "text")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nth = b.column("nth").to_numpy()
            parts = list(drawn_windows(Texts.of(b.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array([int(nth[k]) for k, _, _ in parts], pa.int64()), pa.array([j for _, j, _ in parts], pa.int64()), pa.array([x for _, _, x in parts], pa.binary())], names=["nth", "part", "words"])

    parts = of(~held).mapInArrow(draw, "nth long, part long, words binary").dropDuplicates(["nth", "part"]).toArrow().sort_by([("nth", "ascending"), ("part", "ascending")])
    share, net = net.share, train(Texts.of(parts["words"]), y, held, epochs, owner=parts["nth"].to_numpy())
    net.share = share

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("nth"), pa.array(net.text_logits(Texts.of(b.column("text"))), pa.float64())], names=["nth", "logit"])

    scores = of(held).mapInArrow(whole, "nth long, logit double").dropDuplicates(["nth"]).toArrow().sort_by("nth")
    logit, own = scores["logit"].to_numpy(), scores["nth"].to_numpy()
    ok = ~np.isnan(logit)
    net.slope, net.shift = calibrate(logit[ok], y[own][ok].astype(float), share)
    return net


OUTPUTS = {"toxicity": "double"}


def score(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with the toxicity (0 to 1) of the whole text."""
    ship(spark)
    keep = without(docs, *OUTPUTS)
    rest = docs.select(*[f"`{c}`" for c in keep])
    at = [c.lower() for c in keep].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.round(net.probability(net.text_logits(Texts.of(b.column(at)))), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*keep, *OUTPUTS])

    return rest.mapInArrow(run, with_fields(rest, OUTPUTS))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
