"""Evaluation metrics of a binary classifier.

Input is an evaluation frame with a 0/1 label column ``y``, a probability
``p`` and optionally a hard prediction / score / decision. Every metric is a
single aggregate pass or, for curve metrics, an aggregate by distinct score
followed by ``prefix_sums`` (distributed running sums — no single-partition
sort of the rows, and a score shared by a third of all rows is one row after
the first aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import flag
from .order_stats import exact_quantiles, prefix_sums

EPS = 2.220446049250313e-16  # float64 machine epsilon: probability clipping of log loss


def _div(a: Column, b: Column) -> Column:
    """a / b with zero_division = 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """2x2 confusion counts (A14): tn, fp, fn, tp."""
    yy, pp = F.col(y), F.col(pred)
    return df.agg(
        F.sum(flag((yy == 0) & (pp == 0))).cast("long").alias("tn"),
        F.sum(flag((yy == 0) & (pp == 1))).cast("long").alias("fp"),
        F.sum(flag((yy == 1) & (pp == 0))).cast("long").alias("fn"),
        F.sum(flag((yy == 1) & (pp == 1))).cast("long").alias("tp"),
    )


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 with zero_division = 0."""
    c = confusion(df, y, pred)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    return c.select(
        _div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        _div(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
    )


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted
    averages (A16) — derived from the four confusion counts."""
    c = confusion(df, y, pred)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    rows = c.select(
        # class 1: positives; class 0: the roles of the counts swap
        _div(tn, tn + fn).alias("p0"), _div(tn, tn + fp).alias("r0"),
        _div(F.lit(2.0) * tn, F.lit(2) * tn + fp + fn).alias("f0"), (tn + fp).alias("s0"),
        _div(tp, tp + fp).alias("p1"), _div(tp, tp + fn).alias("r1"),
        _div(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"),
    )
    n = F.col("s0") + F.col("s1")
    wavg = lambda a, b: _div(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), n)

    def row(label, prec, rec, f1, support):
        return F.struct(F.lit(label).alias("label"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1_score"), support.cast("long").alias("support"))

    out = rows.select(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, n),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), n),
    ).alias("r"))
    return out.select(F.inline("r"))


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row per distinct score with its positive and negative counts."""
    return df.groupBy(F.col(p).alias("score")).agg(
        F.sum(flag(F.col(y) == 1)).cast("long").alias("pos"),
        F.sum(flag(F.col(y) == 0)).cast("long").alias("neg"))


def _totals(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.sum(flag(F.col(y) == 1)).cast("long").alias("P"),
                  F.sum(flag(F.col(y) == 0)).cast("long").alias("N"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC with half credit for ties (A17) = Σ pos·(neg below + ½·neg at) / (P·N)."""
    sc = prefix_sums(score_counts(df, y, p), "score", ["neg"], inclusive=False)
    part = sc.agg(F.sum(F.col("pos") * (F.col("cum_neg") + F.lit(0.5) * F.col("neg"))).alias("num"),
                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select(F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
                       .otherwise(F.col("num") / (F.col("P").cast("double") * F.col("N").cast("double")))
                       .alias("roc_auc"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, descending, plus the
    starting point (inf, 0, 0) (A18). Collinear points are kept."""
    c = _with_totals(prefix_sums(score_counts(df, y, p), "score", ["pos", "neg"], descending=True), df, y)
    pts = c.select(F.col("score").alias("threshold"), _div(F.col("cum_neg"), F.col("N")).alias("fpr"),
                   _div(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the closing
    point precision 1 / recall 0 with a NULL threshold (A19)."""
    c = _with_totals(prefix_sums(score_counts(df, y, p), "score", ["pos", "neg"], descending=True), df, y)
    pts = c.select(F.col("score").alias("threshold"),
                   _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                   _div(F.col("cum_pos"), F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """AP = Σ Δrecall · precision over descending thresholds (A20); Δrecall at
    a score is pos/P, so no lag is needed."""
    c = prefix_sums(score_counts(df, y, p), "score", ["pos", "neg"], descending=True)
    agg = c.agg(F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("num"),
                F.sum("pos").alias("P"))
    return agg.select(_div(F.col("num"), F.col("P")).alias("average_precision"))


def _with_totals(c: DataFrame, df: DataFrame, y: str) -> DataFrame:
    """Attach the class totals as scalar subqueries (evaluated once, no join)."""
    tot = _totals(df, y)
    return c.withColumn("P", tot.select("P").scalar()).withColumn("N", tot.select("N").scalar())


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Mean negative log-likelihood, probabilities clipped to [eps, 1-eps]."""
    pc = F.greatest(F.lit(EPS), F.least(F.lit(1.0 - EPS), F.col(p)))
    yy = F.col(y).cast("double")
    return df.agg(F.avg(-(yy * F.log(pc) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - pc))).alias("log_loss"))


def threshold_sweep(df: DataFrame, y: str = "y", p: str = "p", thresholds=None) -> DataFrame:
    """Precision, recall, F1 and accept rate (share p < t, in %) for each
    threshold (A22) — one aggregate pass with conditional sums per threshold.
    Rows without a probability are left out."""
    df = df.where(F.col(p).isNotNull())
    ts = thresholds or S.THRESHOLDS
    yy, pp = F.col(y), F.col(p)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(ts):
        pred = pp >= F.lit(t)
        aggs += [F.sum(flag(pred & (yy == 1))).alias(f"tp{i}"), F.sum(flag(pred & (yy == 0))).alias(f"fp{i}"),
                 F.sum(flag(~pred & (yy == 1))).alias(f"fn{i}"), F.sum(flag(pp < F.lit(t))).alias(f"acc{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, t in enumerate(ts):
        tp, fp, fn, acc = (F.col(f"{k}{i}") for k in ("tp", "fp", "fn", "acc"))
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), _div(tp, tp + fp).alias("precision"),
                             _div(tp, tp + fn).alias("recall"),
                             _div(F.lit(2.0) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
                             (_div(acc, F.col("n")) * F.lit(100.0)).alias("accept_rate")))
    return one.select(F.inline(F.array(*rows)))


def metric_gate(auc: DataFrame, metrics: DataFrame) -> DataFrame:
    """Quality gate: AUC >= 0.7 and recall >= 0.7 (A23); one row built from
    two one-row results (scalar subqueries)."""
    a = auc.select("roc_auc").scalar()
    r = metrics.select("recall").scalar()
    one = metrics.sparkSession.range(1).select(a.alias("roc_auc"), r.alias("recall"))
    return one.select("roc_auc", "recall",
                      (F.col("roc_auc") >= S.AUC_GATE).alias("auc_ok"),
                      (F.col("recall") >= S.RECALL_GATE).alias("recall_ok"),
                      ((F.col("roc_auc") >= S.AUC_GATE) & (F.col("recall") >= S.RECALL_GATE)).alias("model_good"))


def decision_distribution(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Count and percent per decision; all four labels, fixed order, zeros
    kept (A11). One conditional-count pass, then unpivot."""
    d = F.col(decision)
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(flag(d == lbl)).cast("long").alias(f"c{i}") for i, lbl in enumerate(S.DECISIONS)])
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(lbl).alias("decision"),
                     F.col(f"c{i}").alias("n_rows"),
                     (_div(F.col(f"c{i}"), F.col("n")) * F.lit(100.0)).alias("pct"))
            for i, lbl in enumerate(S.DECISIONS)]
    return one.select(F.inline(F.array(*rows)))


def default_rate_by_decision(df: DataFrame, y: str = "y", decision: str = "decision") -> DataFrame:
    """Count, percent and actual default rate (%) per decision; an empty
    decision has rate 0 (A12)."""
    d, yy = F.col(decision), F.col(y)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, lbl in enumerate(S.DECISIONS):
        aggs += [F.sum(flag(d == lbl)).cast("long").alias(f"c{i}"),
                 F.sum(flag((d == lbl) & (yy == 1))).cast("long").alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(lbl).alias("decision"), F.col(f"c{i}").alias("n_rows"),
                     (_div(F.col(f"c{i}"), F.col("n")) * F.lit(100.0)).alias("pct"),
                     (_div(F.col(f"d{i}"), F.col(f"c{i}")) * F.lit(100.0)).alias("default_rate"))
            for i, lbl in enumerate(S.DECISIONS)]
    return one.select(F.inline(F.array(*rows)))


def decile_table(df: DataFrame, y: str = "y", p: str = "p", q: int = 10) -> DataFrame:
    """Quantile bins of the probability (A13): edges are exact linear
    quantiles, bins right-closed with the lowest value in bin 0 (pandas
    qcut); duplicate edges raise, as qcut does. Rows without a probability
    are in no bin."""
    df = df.where(F.col(p).isNotNull())
    probs = [i / q for i in range(q + 1)]
    qs = exact_quantiles(df, p, probs).where((F.col("q") > 0) & (F.col("q") < 1))
    edges = qs.agg(F.array_sort(F.collect_list("quantile")).alias("_edges"),   # 9 values
                   (F.count(F.lit(1)) - F.count_distinct("quantile")).alias("_dups"))
    x = df.withColumn("_edges", edges.select("_edges").scalar()).withColumn(
        "_dups", edges.select("_dups").scalar())
    pv = F.col(p)
    # pandas raises on duplicate edges; fail the same way
    dec = F.when(F.col("_dups") > 0,
                 F.raise_error(F.lit("Bin edges must be unique (duplicate quantile edges)"))
                 ).otherwise(F.size(F.filter("_edges", lambda e: e < pv)))
    return (x.groupBy(dec.cast("int").alias("decile"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.avg(F.col(y)).alias("default_rate")))


def score_hist_by_label(df: DataFrame, y: str = "y", score: str = "score", bins: int = 30) -> DataFrame:
    """Equal-width histogram of the score per label over that label's own
    [min, max] (A8), ``bins`` bins, last bin closed."""
    rng = df.groupBy(y).agg(F.min(score).alias("_mn"), F.max(score).alias("_mx"))
    x = df.join(F.broadcast(rng), y)
    s, mn, mx = F.col(score).cast("double"), F.col("_mn").cast("double"), F.col("_mx").cast("double")
    b = F.when(mx == mn, F.lit(bins // 2)).otherwise(
        F.least(F.floor((s - mn) / (mx - mn) * F.lit(float(bins))), F.lit(bins - 1)))
    return x.groupBy(F.col(y).alias("label"), b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"))
