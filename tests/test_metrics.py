"""Metrics and order statistics against brute force on small data, including
a hot value holding a third of all rows."""

import random

import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators import metrics as M
from ledgerlens.operators.order_stats import exact_quantiles, prefix_sums
from ledgerlens.operators.splits import stratified_split


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        y = 1 if rnd.random() < 0.2 else 0
        p = round(min(1.0, max(0.0, rnd.gauss(0.3 + 0.3 * y, 0.2))), 2)   # many ties
        if i % 3 == 0:
            p = 0.15                                                      # hot value: a third of rows
        rows.append((i, y, p, int(p >= 0.5)))
    pdf = pd.DataFrame(rows, columns=["id", "y", "p", "pred"])
    return spark.createDataFrame(pdf), pdf


def brute_auc(pdf):
    pos = pdf[pdf.y == 1].p.values
    neg = pdf[pdf.y == 0].p.values
    s = 0.0
    for a in pos:
        s += (neg < a).sum() + 0.5 * (neg == a).sum()
    return s / (len(pos) * len(neg))


def brute_ap(pdf):
    d = pdf.sort_values("p", ascending=False)
    P = d.y.sum()
    ap, prev_r = 0.0, 0.0
    for t in sorted(d.p.unique(), reverse=True):
        sel = d[d.p >= t]
        tp = sel.y.sum()
        prec, rec = tp / len(sel), tp / P
        ap += (rec - prev_r) * prec
        prev_r = rec
    return ap


def test_auc_and_ap(spark, scored):
    df, pdf = scored
    assert M.roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(brute_auc(pdf), abs=1e-12)
    assert M.average_precision(df).collect()[0]["average_precision"] == pytest.approx(brute_ap(pdf), abs=1e-12)


def test_auc_invariant_under_monotone_transform(spark, scored):
    df, _ = scored
    a = M.roc_auc(df).collect()[0]["roc_auc"]
    b = M.roc_auc(df.withColumn("p", df.p * df.p * 3 + 1)).collect()[0]["roc_auc"]
    assert a == pytest.approx(b, abs=1e-15)
    assert 0.0 <= a <= 1.0


def test_roc_and_pr_curves(spark, scored):
    df, pdf = scored
    roc = M.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert roc.iloc[0].threshold == float("inf") and roc.iloc[0].fpr == 0 and roc.iloc[0].tpr == 0
    assert roc.tpr.is_monotonic_increasing and roc.fpr.is_monotonic_increasing
    t = 0.4
    exp_tpr = ((pdf.p >= t) & (pdf.y == 1)).sum() / (pdf.y == 1).sum()
    assert roc[roc.threshold == t].tpr.iloc[0] == pytest.approx(exp_tpr)
    pr = M.pr_curve(df).toPandas()
    end = pr[pr.threshold.isna()]
    assert len(end) == 1 and end.precision.iloc[0] == 1.0 and end.recall.iloc[0] == 0.0


def test_confusion_report_sweep(spark, scored):
    df, pdf = scored
    c = M.confusion(df).collect()[0]
    assert c["tp"] == int(((pdf.y == 1) & (pdf.pred == 1)).sum())
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert rep["1"]["support"] == int((pdf.y == 1).sum()) and rep["macro avg"]["support"] == len(pdf)
    sw = {r["threshold"]: r for r in M.threshold_sweep(df).collect()}
    assert sw[0.3]["accept_rate"] == pytest.approx((pdf.p < 0.3).mean() * 100)


def test_decile_matches_qcut(spark, scored):
    df, pdf = scored
    d = pdf.assign(p=pdf.p + pdf.id * 1e-9)          # qcut needs unique edges
    exp = d.assign(dec=pd.qcut(d.p, 10, labels=False)).groupby("dec").y.agg(["count", "mean"])
    got = M.decile_table(spark.createDataFrame(d)).toPandas().set_index("decile").sort_index()
    assert list(got.n_rows) == list(exp["count"])
    assert np.allclose(got.default_rate.values, exp["mean"].values)


def test_decile_duplicate_edges_fail(spark, scored):
    df, _ = scored
    with pytest.raises(Exception):
        M.decile_table(df).collect()     # the hot value makes edges repeat, like pandas


def test_exact_quantiles_match_numpy(spark, scored):
    df, pdf = scored
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "p", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(pdf.p.values, q), abs=1e-12)
    by = exact_quantiles(df, "p", [0.5], by=["y"]).toPandas().set_index("y")["quantile"]
    for y, g in pdf.groupby("y"):
        assert by[y] == pytest.approx(np.median(g.p.values), abs=1e-12)


def test_prefix_sums_match_cumsum(spark, scored):
    df, pdf = scored
    agg = df.groupBy("p").count()
    got = prefix_sums(agg, "p", ["count"], n_partitions=5).toPandas().sort_values("p")
    exp = pdf.groupby("p").size().sort_index().cumsum()
    assert list(got["cum_count"]) == list(exp.values)
    desc = prefix_sums(agg, "p", ["count"], descending=True, inclusive=False, n_partitions=3).toPandas()
    exp_d = pdf.groupby("p").size().sort_index(ascending=False)
    exp_excl = (exp_d.cumsum() - exp_d).to_dict()
    assert all(r.cum_count == exp_excl[r.p] for r in desc.itertuples())


def test_stratified_split_exact_counts(spark, scored):
    df, pdf = scored
    s = stratified_split(df, "y", ["id"], 0.2, 42)
    got = s.where("is_test").groupBy("y").count().toPandas().set_index("y")["count"]
    for y, g in pdf.groupby("y"):
        assert got[y] == round(len(g) * 0.2)
    # reproducible
    a = {r["id"] for r in s.where("is_test").collect()}
    b = {r["id"] for r in stratified_split(df, "y", ["id"], 0.2, 42).where("is_test").collect()}
    assert a == b
