"""Boosted trees whose levels are one job each."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as BO


def _table(spark, x, y, parts=3):
    data = [(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, v array<double>, y int").withColumn("features", array_to_vector("v")).repartition(parts, "id").cache()


@pytest.fixture(scope="module")
def rows(spark):
    """Noisy labels; one slot is constant, two are binary, one has more values than bins."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 20, 1200), rng.integers(0, 2, 1200), np.ones(1200), rng.integers(0, 9, 1200), rng.integers(0, 2, 1200), rng.normal(size=1200)])
    y = (x[:, 0] / 10 + x[:, 1] * (x[:, 3] > 4) + x[:, 5] + 0.5 * rng.normal(size=1200) > 1.8).astype(int)
    return _table(spark, x, y)


def _brute(x, y, n_trees, depth):
    """Margins of boosted trees by the definition, cuts between all values; and the decrease of squared error per feature."""
    label, at, gains = 2.0 * y - 1, np.zeros(len(y)), np.zeros(x.shape[1])

    def fit(rows, r, d):
        s = r[rows]
        best = (1e-12 * len(rows), None)
        for j in range(x.shape[1]) if d < depth else ():
            for t in np.unique(x[rows, j])[:-1]:
                left = x[rows, j] <= t
                gain = s[left].sum() ** 2 / left.sum() + s[~left].sum() ** 2 / (~left).sum() - s.sum() ** 2 / len(s)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, left))
        if best[1] is None:
            out[rows] = s.mean()
            return
        j, left = best[1]
        gains[j] += best[0]
        fit(rows[left], r, d + 1)
        fit(rows[~left], r, d + 1)

    for k in range(n_trees):
        out = np.zeros(len(y))
        fit(np.arange(len(y)), label if k == 0 else 4 * label / (1 + np.exp(2 * label * at)), 0)
        at = at + out * (0.1 if k else 1.0)
    return at, gains / gains.sum()


def test_equals_the_definition(spark, monkeypatch):
    """Five trees of a table whose values all have a bin; the margins are taken anew from the rows after every third."""
    monkeypatch.setattr(BO, "RESTART", 3)
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 2, 400), rng.integers(0, 2, 400), rng.integers(0, 30, 400)]).astype(float)
    y = (x[:, 0] / 6 + x[:, 1] + rng.normal(size=400) > 1.7).astype(int)
    df = _table(spark, x, y)
    m = BO.TableBoosted(labelCol="y", maxIter=5, maxDepth=3).fit(df)
    out = {r["id"]: r for r in m.transform(df).select("id", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("raw"), "prediction").collect()}
    want, importance = _brute(x, y, 5, 3)
    assert max(abs(out[i]["raw"][1] - want[i]) for i in out) < 1e-9 and len(out) == 400
    assert all(abs(r["p"][1] - 1 / (1 + np.exp(-2 * r["raw"][1]))) < 1e-12 and r["prediction"] == float(r["raw"][1] > 0) for r in out.values())
    assert np.allclose(m.featureImportances.toArray(), importance, atol=1e-9)


def test_as_good_as_mllib(rows):
    """MLlib's boosted trees took one job of two stages and all rows' nodes per level: the same loss, in one stage."""
    loss = {}
    for clf in (BO.TableBoosted(labelCol="y", maxIter=5), GBTClassifier(labelCol="y", maxIter=5, stepSize=0.1, seed=42)):
        m = clf.fit(rows)
        loss[type(clf).__name__] = m.transform(rows).select(F.avg(-F.log(F.get(vector_to_array("probability"), F.col("y"))))).head()[0]
        assert m.featureImportances.toArray()[2] == 0 and abs(m.featureImportances.toArray().sum() - 1) < 1e-9 and m.getNumTrees == 5
    assert abs(loss["TableBoosted"] - loss["GBTClassifier"]) < 0.05 * loss["GBTClassifier"]


def test_partitions_and_saved_model(spark, rows):
    """The dealing of rows changes sums by rounding only; a saved model scores alike."""
    m = BO.TableBoosted(labelCol="y", maxIter=3).fit(rows)
    n = BO.TableBoosted(labelCol="y", maxIter=3).fit(rows.repartition(11))
    folder = tempfile.mkdtemp(prefix="ll-boosted-", dir="/tmp")
    PipelineModel([m]).write().overwrite().save(folder)
    p = lambda model: dict(model.transform(rows).select("id", vector_to_array("probability")[1]).collect())
    a, b, c = p(m), p(n), p(PipelineModel.load(folder))
    assert a == c and max(abs(a[i] - b[i]) for i in a) < 1e-9
    # half of the nodes' sums added by Spark in two steps
    few, BO.FEW_PARTS = BO.FEW_PARTS, 1
    try:
        d = p(BO.TableBoosted(labelCol="y", maxIter=3).fit(rows))
    finally:
        BO.FEW_PARTS = few
    assert max(abs(a[i] - d[i]) for i in a) < 1e-9


def test_depth():
    for feature, depth in (([-1], 0), ([0, -1, -1], 1), ([0, -1, 1, -1, -1], 2), ([0, 2, 1, -1, -1, 3, -1, -1, -1], 3)):
        assert BO.depth_of(np.array(feature)) == depth


def test_nothing_to_split(spark):
    """Constant features: every tree is a leaf, the margin goes to that of the labels' share. A label beside 0 and 1 is an error."""
    y = np.array([1] * 3 + [0] * 9)
    m = BO.TableBoosted(labelCol="y", maxIter=30).fit(_table(spark, np.ones((12, 2)), y))
    p = m.transform(_table(spark, np.ones((1, 2)), y[:1])).select(vector_to_array("probability")[1]).head()[0]
    assert abs(p - 0.25) < 0.01 and m.getNumTrees == 30 and m.featureImportances.toArray().tolist() == [0, 0]
    with pytest.raises(Exception, match="labels 0 and 1"):
        BO.TableBoosted(labelCol="y", maxIter=2).fit(_table(spark, np.ones((4, 2)), np.array([0, 1, 2, 1])))


def test_smaller_children_are_counted(rows, monkeypatch):
    """Both children of every split went through all features; the larger one's sums are the parent's less the smaller one's."""
    asked, level = [], BO._level
    monkeypatch.setattr(BO, "_level", lambda blocks, first, columns, feature, cut, nodes: asked.append((len(feature), len(nodes))) or level(blocks, first, columns, feature, cut, nodes))
    m = BO.TableBoosted(labelCol="y", maxIter=2).fit(rows)
    starts = [i for i, (n, _) in enumerate(asked) if n == 1]
    assert len(starts) == 2 and all(asked[i + 1][1] == 1 for i in starts)
    assert all(n <= 2 ** max(0, (i - max(s for s in starts if s <= i)) - 1) for i, (_, n) in enumerate(asked))
    assert m.getNumTrees == 2


def test_joint_codes_and_steps(monkeypatch):
    """Features that share a column, more rows than a step: the sums, and the node that a row ends at, feature by feature."""
    monkeypatch.setattr(BO, "STEP_VALUES", 70)
    rng = np.random.default_rng(2)
    bins = [32, 1, 2, 31, 2, 7]
    columns, x = BO._Columns(bins), np.stack([rng.integers(0, b, 300) for b in bins]).astype(np.uint8)
    codes, values, node = columns.codes(x), rng.normal(size=300), rng.integers(0, 3, 300)
    total = columns.none(3)
    for r in BO._steps(300):
        columns.add(total, codes, r, node[r], values[r])
    out = columns.by_feature(total, 3)
    for j, first, b in columns.slots:
        for v in range(3):
            assert out[0, v, first:first + b].tolist() == np.bincount(x[j, node == v], minlength=b).tolist()
            assert np.allclose(out[1, v, first:first + b], np.bincount(x[j, node == v], weights=values[node == v], minlength=b))
    feature, cut = np.array([3, 0, 5, -1, 2, -1, -1, -1, -1]), np.array([14, 9, 3, 0, 0, 0, 0, 0, 0])
    assert (columns.walker(feature, cut)(codes, np.arange(300)) == BO.walked(x, feature, cut, 3)).all()
