"""The forest whose nodes are a table (M10), and queries that fit one candidate."""

import itertools
import json
import tempfile
import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import forest as FO
from ledgerlens.operators import models as MD
from ledgerlens.plans import q_models as Q
from ledgerlens.session import scratch_path, scratch_scope, side_by_side


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that follow from the features, with noise; one slot is constant, one binary."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=1500), rng.integers(0, 2, 1500), np.ones(1500), rng.integers(0, 9, 1500), rng.random(1500)])
    y = ((x[:, 0] + x[:, 1] * (x[:, 3] > 4) + 0.3 * rng.normal(size=1500)) > 0.8).astype(int)
    data = [(i, r.tolist(), int(v), 2.0 if v else 0.7) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, v array<double>, y int, w double").withColumn("features", array_to_vector("v")).repartition(5, "id").cache()


def _fit(rows, **given):
    return FO.TableForest(labelCol="y", weightCol="w", numTrees=9, **given).fit(rows)


@pytest.mark.parametrize("task_rows", [400_000, 120])
def test_forest_is_whole(spark, rows, task_rows):
    """Every tree down to leaves of one label, in subtrees of bounded rows, scored as its nodes say."""
    m = _fit(rows, taskRows=task_rows)
    out = {r["id"]: r for r in m.transform(rows).select("id", "v", "y", vector_to_array("probability").alias("p"), "prediction").collect()}
    assert np.mean([r["prediction"] == r["y"] for r in out.values()]) > 0.95
    nodes = {(r["tree"], r["node"]): r for r in FO.node_table(rows, m).collect()}
    assert {t for t, _ in nodes} == set(range(9))
    subtrees = spark.read.parquet(m.getOrDefault("nodes")).count()
    assert subtrees == 9 if task_rows > 1500 else subtrees > 50
    assert sum(len(t[0]) for t in json.loads(m.getOrDefault("top"))["trees"]) < 9 * 8 * 1500 / task_rows + 10   # what the driver holds
    leaves = [r["value"] for r in nodes.values() if r["feature"] is None]
    assert np.mean([v in (0.0, 1.0) for v in leaves]) > 0.9     # the others: rows that no drawn feature splits
    for r in itertools.islice(out.values(), 100):
        p = 0.0
        for t in range(9):
            n = nodes[t, 0]
            while n["feature"] is not None:
                n = nodes[t, n["left_child"] if r["v"][n["feature"]] <= n["threshold"] else n["right_child"]]
            p += n["value"] / 9
        assert abs(r["p"][1] - p) < 1e-12 and abs(sum(r["p"]) - 1) < 1e-12
    imp = m.featureImportances.toArray()
    assert abs(imp.sum() - 1) < 1e-9 and imp[2] == 0 and imp[0] == imp.max()


def test_depth_bound_and_saved_model(rows):
    m = _fit(rows, maxDepth=3, taskRows=300)
    nodes = FO.node_table(rows, m).groupBy("tree").count().collect()
    assert all(3 <= r["count"] <= 15 for r in nodes)
    path = tempfile.mkdtemp(prefix="ll-forest-", dir="/tmp") + "/m"
    PipelineModel([m]).save(path)
    again = PipelineModel.load(path)
    p = vector_to_array("probability")[1].alias("p")
    assert sorted(again.transform(rows).select("id", p).collect()) == sorted(m.transform(rows).select("id", p).collect())
    assert again.stages[0].getOrDefault("nodes").startswith(path)


def test_one_label_and_few_rows(rows):
    one = rows.where("y = 0").limit(2)
    m = _fit(one)
    assert [r[0] for r in m.transform(one).select("prediction").collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        _fit(rows.limit(0))


def test_best_split_by_brute_force():
    rng = np.random.default_rng(0)
    x, code, times = rng.integers(0, 6, (200, 4)).astype(np.uint8), rng.integers(0, 2, 200).astype(np.uint8), rng.integers(1, 4, 200).astype(np.uint8)
    weights = np.array([[0.6, 0.0], [0.0, 3.0]])
    drawn, node = np.array([[0, 2], [1, 3]]), rng.integers(0, 2, 200)
    k, cut, gain, left = FO.best_splits(FO.histogram(x, np.arange(200), node, times, code, drawn, 6, 2), weights)

    def gini(r):
        w = [(times[r] * (code[r] == c)).sum() * weights[c, c] for c in (0, 1)]
        return sum(w) - sum(v * v for v in w) / sum(w)

    for n in (0, 1):
        r = np.flatnonzero(node == n)
        best = max((gini(r) - gini(r[x[r, f] <= c]) - gini(r[x[r, f] > c]), -f, -c) for f in drawn[n] for c in range(5))
        assert abs(best[0] - gain[n]) < 1e-9 and (drawn[n][k[n]], cut[n]) == (-best[1], -best[2])
        goes = r[x[r, drawn[n][k[n]]] <= cut[n]]
        assert left[n].tolist() == [(times[goes] * (code[goes] == c)).sum() for c in (0, 1)]


def test_named_candidate_is_fitted_alone(spark, monkeypatch):
    """train_full_lr took the forest and the boosted trees along."""
    fitted, make = [], MD.make_classifier
    monkeypatch.setattr(MD, "make_classifier", lambda name, *a, **b: fitted.append(name) or make(name, *a, **b))
    monkeypatch.setattr(Q, "_FIT_CACHE", {})
    out = Q.q_train_full_lr(spark, "/root/testdata/sf0.001")
    assert fitted == ["logistic_regression"]
    assert out.where(F.col("coefficient") != 0).count() > 20


def test_node_splits_equal_histograms():
    """Nodes of few, some and many rows: the cuts that the counts over all bins give, weights of three classes included."""
    rng = np.random.default_rng(5)
    size = np.array([1, 2, 3, 5, 8, 31, 32, 33, 200, FO.LARGE_NODE, 900, 2, 17])
    n, first = int(size.sum()), np.cumsum(size) - size
    x = rng.integers(0, 9, (n, 6)).astype(np.uint8)
    x[:, 2], x[:, 3] = x[:, 2] > 6, 1
    rows, own = rng.permutation(n), np.repeat(np.arange(len(size)), size)
    times, drawn = rng.integers(1, 256, n).astype(np.uint8), FO.draw(rng, len(size), 6, 3)
    for weights in (np.array([[0.6, 0.0], [0.0, 3.0]]), np.array([[0.6, 0.0], [0.0, 3.0], [0.5, 0.0]])):
        code = rng.integers(0, len(weights), n).astype(np.uint8)
        want = FO.best_splits(FO.histogram(x, rows, own, times, code, drawn, 9, len(weights)), weights)
        got = FO.node_splits(x, np.ascontiguousarray(x.T), rows, first, size, times, code, drawn, weights, 9)
        ok = want[2] > 0
        assert ok.sum() > 8 and (got[2] == want[2]).all()
        for a, b in zip(got, want, strict=True):
            assert (a[ok] == b[ok]).all()


def test_candidates_are_fitted_side_by_side(spark, monkeypatch):
    """The fits of a role went one after the other."""
    met = threading.Barrier(3, timeout=60)
    monkeypatch.setattr(MD, "evaluate", lambda f, *a: (met.wait(), f.metrics.update(roc_auc={"random_forest": 0.9}.get(f.name, 0.5))))
    make = MD.make_classifier
    monkeypatch.setattr(MD, "make_classifier", lambda name, *a, **b: make("logistic_regression", *a, **b).setMaxIter(1))
    train, test = Q._split(spark, "/root/testdata/sf0.001")
    fits, best = MD.train_role(train, test, "cold")
    assert list(fits) == MD.CANDIDATE_ORDER and best == "random_forest"


def test_side_by_side(spark):
    """Order, the open scratch scope and errors."""
    with scratch_scope(spark) as scope:
        assert side_by_side(spark, [lambda i=i: (scratch_path(spark, f"t{i}"), spark.range(i).count())[1] for i in (3, 1, 2)]) == [3, 1, 2]
        assert len(scope.paths) == 3
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 / 0])


def test_nodes_are_split_in_steps_of_bounded_memory():
    """All small nodes of a level went through numpy at once, in temporary arrays that left the core's cache."""
    rng = np.random.default_rng(6)
    size = rng.integers(2, 33, 40_000)
    n, first = int(size.sum()), np.cumsum(size) - size
    x, code, times = rng.integers(0, 20, (n, 30)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8), np.ones(n, dtype=np.uint8)
    drawn, rows = FO.draw(rng, len(size), 30, 6), np.arange(n)
    tracemalloc.start()
    try:
        FO.node_splits(x, None, rows, first, size, times, code, drawn, np.eye(2), 20)
        assert tracemalloc.get_traced_memory()[1] < 20e6
    finally:
        tracemalloc.stop()


def test_walk_ends_where_a_row_by_row_walk_does():
    """Trees of every shape: a leaf alone, open top nodes, deeper than a step of levels; more rows than a step."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (FO.STEP_VALUES + 50, 5)).astype(np.uint8)
    chain = np.array([4, *[-1, 2] * 11, -1, -1])                # every right child is split again
    for feature in (np.array([-1]), np.array([-2]), np.array([0, -3, 3, -2, -1]), chain):
        cut, left = rng.integers(0, 255, len(feature)), np.where(feature >= 0, FO.left_children(feature), 0)
        end = FO.walk(x, feature, cut, left)
        for i in [*range(200), len(x) - 1]:
            node = 0
            while feature[node] >= 0:
                node = left[node] + (x[i, feature[node]] > cut[node])
            assert end[i] == node
