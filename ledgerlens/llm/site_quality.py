"""Operator 6, quality classifier: hierarchical empirical Bayes. A document's evidence
from its text is combined with the posterior of its path, whose prior is the posterior of
its host, whose prior is the share of all documents; sparse sites shrink toward it.

1. Evidence. Each text has a few rates (symbols, capitals, separators, repeats ...), each
   in fixed bins. Labelled documents are counted by (rate, bin, label); with shrunk shares
   each bin gives a log likelihood ratio. Their sum is binned again and counted by label,
   which calibrates it (the rates are not independent).
2. Sites. ``source`` is host/path; the path level is its first segment, or the document's
   language section where the source is a bare host. Every document counts with its label,
   or else its probability from the evidence. Per host: mean (sum + k * global) / (n + k);
   per path: the same with the host's mean as prior; k is estimated by moments from
   the spread of the host (path) shares.
3. Probability: logit = evidence + logit(path mean); kept if at least ``keep_from``.

Defined results: null or empty text has the bins of an empty text; a null source is a
site of its own; a null lang is the section ''; a null doc_id has no label; a doc_id labelled both ways
counts as 0; without both labels the evidence is 0 and the prior the known share, or 1 without labels; equal rows count
each; an empty table gives an empty table; columns named like an output are replaced.

Scale: everything learned is a grouped aggregate with map-side partial sums; the
evidence tables have a fixed number of bins. The site table joins by broadcast only where its
row count is checked to be small, else by a sort-merge join that AQE may split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, cols, ship, stored, table, with_fields, without
from ledgerlens.llm.quality_rules import per_text
from ledgerlens.llm.textarrays import Texts, mix64

#: Bin edges of each rate: the bin of a value is the number of edges at or below it.
EDGES = {
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),       # characters of #*$%&|<> per character
    "capitals": (0.01, 0.03, 0.08, 0.2, 0.4, 0.7),        # capitals per ASCII letter
    "marks": (0.005, 0.02, 0.05, 0.1),                    # ! and ? per character
    "digits": (0.005, 0.02, 0.05, 0.15),                  # digits per character
    "word_length": (2.0, 3.0, 4.0, 5.0, 6.5, 9.0, 14.0),  # bytes per word
    "repeated": (0.05, 0.15, 0.3, 0.5, 0.75),             # words that occur before in the text
    "bars": (0.05, 0.2, 0.5),                             # words that are symbols alone
    "words": (1, 10, 25, 50, 100, 400, 2000, 8000),       # words
}
EVIDENCE_EDGES = tuple(x / 2 for x in range(-16, 17))
KEEP_FROM = 0.5
#: A site table of at most this many rows (under 20 MB) is broadcast.
BROADCAST_SITES = 100_000
PSEUDO = 1.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!?", np.uint8)] = True


def rate_bins(texts: Texts) -> np.ndarray:
    """One row of bins (uint8) per text, in the order of EDGES."""
    out = np.zeros((texts.n, len(EDGES)), np.uint8)
    for i, j, t in texts.slices():
        starts, ends, doc = t.words()
        prefix = t.prefix_hash()
        words = Texts.span_hash(prefix, starts, ends)
        n = np.bincount(doc, minlength=t.n)
        size = np.maximum(np.diff(t.offsets), 1)
        some = np.maximum(n, 1)
        capital = (t.data >= 65) & (t.data <= 90)
        letter = per_text(capital | ((t.data >= 97) & (t.data <= 122)), t.offsets)
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[t.data])))
        key = mix64(words + doc.astype(np.uint64))
        _, first = np.unique(key, return_index=True)
        rates = {
            "symbols": per_text(_SYMBOL[t.data], t.offsets) / size,
            "capitals": per_text(capital, t.offsets) / np.maximum(letter, 1),
            "marks": per_text(_MARK[t.data], t.offsets) / size,
            "digits": per_text((t.data >= 48) & (t.data <= 57), t.offsets) / size,
            "word_length": np.bincount(doc, ends - starts, t.n) / some,
            "repeated": (n - np.bincount(doc[first], minlength=t.n)) / some,
            "bars": np.bincount(doc, symbols[ends] - symbols[starts] == ends - starts, t.n) / some,
            "words": n,
        }
        for k, (name, edges) in enumerate(EDGES.items()):
            out[i:j, k] = np.searchsorted(np.array(edges, float), rates[name], "right")
    return out


def with_bins(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``__bins``, the bins of its text's rates."""
    ship(spark)
    at = [c.lower() for c in docs.columns].index("text")
    names = [*docs.columns, "__bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = rate_bins(Texts.of(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins.astype(np.int64).tolist(), pa.list_(pa.int32()))], names=names)

    return docs.mapInArrow(run, with_fields(docs, {"__bins": "array<int>"}))


def host_path(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__host`` and ``__path``."""
    section = F.when(F.instr("source", "/") > 0, F.substring_index(F.substring_index("source", "/", 2), "/", -1)).otherwise(F.coalesce("lang", F.lit("")))
    return docs.withColumn("__host", F.substring_index("source", "/", 1)).withColumn("__path", section)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


class Evidence:
    """Log likelihood ratios: ``rates[i][bin]`` and, for their binned sum, ``total[bin]``."""

    def __init__(self, rates: list[list[float]], total: list[float], prior: float):
        self.rates, self.total, self.prior = rates, total, prior

    def raw(self) -> Column:
        table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in self.rates])
        return F.aggregate(F.zip_with("__bins", table, lambda b, r: F.get(r, b)), F.lit(0.0), lambda a, x: a + x)

    def column(self) -> Column:
        return F.get(F.array(*[F.lit(x) for x in self.total]), total_bin(self.raw()))


def total_bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor((x - EVIDENCE_EDGES[0]) * 2) + 1, F.lit(0)), F.lit(len(EVIDENCE_EDGES))).cast("int")


def _ratios(counts: dict[tuple[int, int], float], bins: int, n: tuple[float, float]) -> list[float]:
    """log P(bin | 1) / P(bin | 0), each share shrunk toward the bin's share among all labelled rows."""
    out = []
    for b in range(bins):
        c = [counts.get((b, y), 0.0) for y in (0, 1)]
        base = (sum(c) + PSEUDO) / (sum(n) + PSEUDO * bins)
        p = [(c[y] + 2 * PSEUDO * base) / (n[y] + 2 * PSEUDO) for y in (0, 1)]
        out.append(math.log(p[1] / p[0]))
    return out


def fit_evidence(labelled: DataFrame) -> Evidence:
    """From (__bins, __y); counts are grouped by Spark, only a table of bins comes back."""
    flat = labelled.select("__y", F.posexplode("__bins").alias("rate", "bin"))
    got = flat.groupBy("rate", "bin", "__y").agg(F.count(F.lit(1)).alias("n")).collect()
    size = [len(e) + 1 for e in EDGES.values()]
    first = [r for r in got if r["rate"] == 0]
    n = tuple(float(sum(r["n"] for r in first if r["__y"] == y)) for y in (0, 1))
    if min(n) == 0:
        prior = 1.0 if sum(n) == 0 else n[1] / sum(n)
        return Evidence([[0.0] * s for s in size], [0.0] * (len(EVIDENCE_EDGES) + 1), prior)
    rates = [_ratios({(r["bin"], r["__y"]): r["n"] for r in got if r["rate"] == k}, s, n) for k, s in enumerate(size)]
    blank = Evidence(rates, [], n[1] / sum(n))
    again = labelled.select("__y", total_bin(blank.raw()).alias("bin")).groupBy("bin", "__y").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {(r["bin"], r["__y"]): float(r["n"]) for r in again}
    total = _monotone(_ratios(counts, len(EVIDENCE_EDGES) + 1, n), [counts.get((b, 0), 0) + counts.get((b, 1), 0) for b in range(len(EVIDENCE_EDGES) + 1)])
    return Evidence(rates, total, n[1] / sum(n))


def _monotone(values: list[float], weights: list[float]) -> list[float]:
    """Nearest rising sequence (pool adjacent violators): more raw evidence never counts for less."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w + 1e-6, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return list(chain.from_iterable([v] * int(n) for v, _, n in blocks))


def strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-count k by moments: shares of groups of n with beta means vary by
    m(1 - m)(1/n + 1/k), roughly; no excess spread gives a large k."""
    m = F.col("__m")
    g = groups.withColumn("__m", mean).where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("spread"),
        F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("weight")).first()
    if not g["weight"]:
        return 1e6
    excess = (g["spread"] - g["chance"]) / g["weight"]
    return min(max(1 / excess if excess > 1e-6 else 1e6, 1.0), 1e6)


def fit_sites(spark: SparkSession, docs: DataFrame, evidence: Evidence) -> DataFrame:
    """(__host, __path, host_mean, path_mean) from (__host, __path, __p) of every document."""
    paths = docs.groupBy("__host", "__path").agg(F.count(F.lit(1)).alias("n"), F.sum("__p").alias("s"))
    paths = stored(spark, paths, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else evidence.prior
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("__host").alias("__h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_mean"))
    both = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h")))
    k = strength(both, F.col("host_mean"))
    return both.select("__host", "__path", "host_mean", ((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)).alias("path_mean"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[Evidence, DataFrame, bool]:
    """Evidence tables, the site table, and whether it is checked to be small."""
    known = (labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__id"))
             .agg(F.min("quality").cast("int").alias("__y")))
    b = host_path(with_bins(spark, docs.select("doc_id", "source", "lang", "text"))).select("doc_id", "__host", "__path", "__bins")
    b = stored(spark, b.join(known, F.col("doc_id") == F.col("__id"), "left").select("__host", "__path", "__bins", "__y"), "bins")
    evidence = fit_evidence(b.where("__y is not null"))
    prior = min(max(evidence.prior, 1e-6), 1 - 1e-6)
    soft = 1 / (1 + F.exp(-(evidence.column() + math.log(prior / (1 - prior)))))
    sites = Stored(spark, fit_sites(spark, b.withColumn("__p", F.coalesce(F.col("__y").cast("double"), soft)), evidence), "sites").df
    return evidence, sites, sites.count() <= BROADCAST_SITES


OUTPUTS = ("evidence", "host_mean", "path_mean", "quality", "kept")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the text's evidence (log likelihood ratio), the site means, the
    probability of good quality and kept."""
    keep = without(docs, *OUTPUTS)
    evidence, sites, small = fit(spark, docs, labels)
    sites = sites.select(F.col("__host").alias("__h"), F.col("__path").alias("__q"), F.col("host_mean").alias("__hm"), F.col("path_mean").alias("__pm"))
    rows = host_path(with_bins(spark, docs.select(*cols(keep))))
    rows = rows.join(F.broadcast(sites) if small else sites, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__path") == F.col("__q")), "left")
    pm = F.least(F.greatest(F.col("__pm"), F.lit(1e-9)), F.lit(1 - 1e-9))
    p = F.round(1 / (1 + F.exp(-(F.col("__e") + logit(pm)))), 9)
    return (rows.withColumn("__e", evidence.column()).withColumn("__prob", p)
            .select(*cols(keep), F.col("__e").alias("evidence"), F.round("__hm", 9).alias("host_mean"), F.round("__pm", 9).alias("path_mean"),
                    F.col("__prob").alias("quality"), (F.col("__prob") >= keep_from).alias("kept")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "evidence", "host_mean", "path_mean", "quality", "kept")
