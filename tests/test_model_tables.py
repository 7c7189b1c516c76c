"""Fitted models replayed by sums, joins and DuckDB; association of categoricals."""

import glob
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.operators import audit as AU
from ledgerlens.operators import model_tables as MT
from ledgerlens.operators import models as MD
from ledgerlens.operators.prep import with_class_weights
from ledgerlens.plans.q_models import _split

from .conftest import SF_SMALL

KEYS = ["customer_id", "snapshot_month"]


@pytest.fixture(scope="module")
def split(spark):
    train, test = _split(spark, SF_SMALL)
    return train.persist(), test.persist()


def test_gradient_is_the_objectives(spark, split):
    train, _ = split
    f = MD.fit_candidate(train, "full", "logistic_regression")
    got = {r["feature"]: r["gradient"] for r in MT.lr_gradient(spark, f, train).collect()}
    lr = f.model.stages[-1]
    rows = f.model.transform(with_class_weights(train, S.LABEL)).select(vector_to_array("features").alias("x"), S.LABEL, "weight").toPandas()
    x, y, w = np.stack(rows["x"]), rows[S.LABEL].to_numpy(float), rows["weight"].to_numpy(float)
    beta, b0, lam = lr.coefficients.toArray(), lr.intercept, lr.getRegParam()
    e = w * (1 / (1 + np.exp(-(x @ beta + b0))) - y)
    want = np.append(e @ x / len(y) + lam * beta, e.sum() / len(y))
    assert np.allclose(list(got.values()), want, atol=1e-10)
    assert np.abs(want).max() <= MT.GRADIENT_BOUND
    # a fit that stopped early isn't stationary
    early = MD.fit_candidate(train, "full", "logistic_regression")
    short = MD.make_classifier("logistic_regression", len(y)).setMaxIter(1).fit(
        early.model.transform(with_class_weights(train, S.LABEL)).select("features", S.LABEL, "weight"))
    early.model.stages[-1] = short
    assert MT.lr_gradient(spark, early, train).agg(F.max(F.abs("gradient"))).first()[0] > MT.GRADIENT_BOUND
    assert MT.lr_gradient(spark, f, train.limit(0)).count() == 0


def test_one_candidate_keeps_one_copy_of_the_rows(spark, split, monkeypatch):
    """The vectors aren't stored beside the copy that the regression's fit makes of them."""
    train, _ = split
    kept, persist = [], type(train).persist
    monkeypatch.setattr(type(train), "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    one = MD.fit_candidate(train, "cold", "logistic_regression")
    assert not kept
    two = MD.fit_candidates(train, "cold", ["logistic_regression", "gradient_boosting"])["logistic_regression"]
    assert len(kept) == 1
    assert np.allclose(one.model.stages[-1].coefficients.toArray(), two.model.stages[-1].coefficients.toArray(), atol=1e-6)


@pytest.mark.parametrize("name", ["gradient_boosting", "random_forest"])
def test_trees_walked_by_joins_and_by_duckdb(spark, split, name):
    train, test = split
    data = with_class_weights(train.select(*MD.role_features("full"), S.LABEL), S.LABEL)
    f = _small(data, name)
    folder = tempfile.mkdtemp(prefix="ll-nodes-", dir="/tmp")
    out = MT.walk_agreement(spark, f, test, KEYS, folder)
    assert sorted(out.collect()) == sorted((*r, True) for r in test.select(*KEYS).collect())

    table = MT.tree_nodes(spark, f, folder)
    table.nodes.write.parquet(f"{folder}/nodes")
    f.model.transform(test.withColumn("k", F.struct(*KEYS))).select("k.*", vector_to_array("features").alias("v"), vector_to_array("probability")[1].alias("p")).write.parquet(f"{folder}/rows")
    p = "1 / (1 + exp(-2 * sum(value)))" if table.kind == "boosted" else f"sum(value) / {table.n_trees}"
    got = duckdb.sql(f"""WITH RECURSIVE n AS (SELECT * FROM '{folder}/nodes/*.parquet'), r AS (SELECT * FROM '{folder}/rows/*.parquet'),
      w AS (SELECT customer_id, snapshot_month, v, tree, 0 AS node FROM r, (SELECT DISTINCT tree FROM n)
        UNION ALL SELECT customer_id, snapshot_month, v, w.tree, CASE WHEN CASE WHEN left_values IS NULL THEN v[feature + 1] <= threshold
          ELSE list_contains(left_values, v[feature + 1]) END THEN left_child ELSE right_child END
        FROM w JOIN n USING (tree, node) WHERE feature IS NOT NULL),
      s AS (SELECT customer_id, snapshot_month, {p} AS q FROM w JOIN n USING (tree, node) WHERE feature IS NULL GROUP BY ALL)
      SELECT count(*), max(abs(p - q)) FROM r JOIN s USING (customer_id, snapshot_month)""").fetchall()[0]
    assert got[0] == test.count() and got[1] < 1e-9
    assert glob.glob(f"{folder}/full/*/stages/*")


def _small(data, name):
    """A model of few trees, with splits on numerics and on one-hot values."""
    from pyspark.ml import Pipeline, PipelineModel

    from ledgerlens.operators.prep import preprocessor, split_roles

    cat, num = split_roles(data, MD.role_features("full"))
    prep = Pipeline(stages=preprocessor(cat, num)).fit(data)
    clf = MD.make_classifier(name, data.count(), rf_max_depth=9)
    clf = clf.setMaxIter(6) if name == "gradient_boosting" else clf.setNumTrees(7)
    return MD.Fitted(name, "full", PipelineModel([*prep.stages, clf.fit(prep.transform(data))]), cat, num)


def test_kept_columns_are_the_inputs(spark, split):
    """Imputing and scaling in place don't reach the columns that a prediction keeps."""
    train, test = split
    f = MD.fit_candidate(train, "full", "logistic_regression")
    cols = [*KEYS, "age", "monthly_income", "util_avg_3m", "employment_status"]
    gaps = test.withColumns({"age": F.when(F.col("customer_id") % 2 == 0, F.col("age")), "employment_status": F.lit(None).cast("string")})
    key = lambda r: r[:2]
    assert sorted(MD.predict(f, gaps, keep=cols).select(cols).collect(), key=key) == sorted(gaps.select(cols).collect(), key=key)
    assert MD.predict(f, test).columns == ["probability", "predicted", "credit_score", "decision"]


def test_correlation_ratio_of_categoricals(spark):
    rows = [("a", "x", 1), ("a", None, 1), ("a", "x", 0), ("b", "x", 0), ("b", None, 0), (None, "x", 1), ("b", "x", None)]
    df = spark.createDataFrame(rows, f"c string, d string, {S.LABEL} int")
    got = {r["feature"]: r for r in AU.categorical_association(df, ["c", "d"]).collect()}
    assert set(got) == {"c_a", "c_b", "c_Unknown", "d_x", "d_Unknown"}
    y = np.array([1, 1, 0, 0, 0, 1.0])
    for c, groups in (("c", {"a": [0, 1, 2], "b": [3, 4], "Unknown": [5]}), ("d", {"x": [0, 2, 3, 5], "Unknown": [1, 4]})):
        terms = {g: len(i) * (y[i].mean() - y.mean()) ** 2 / (len(y) * y.var()) for g, i in groups.items()}
        for g, t in terms.items():
            assert abs(got[f"{c}_{g}"]["importance"] ** 2 - t) < 1e-12
    one = df.withColumn(S.LABEL, F.lit(1))
    assert all(r["importance"] is None for r in AU.categorical_association(one, ["c"]).collect())
    assert AU.categorical_association(df.limit(0), ["c"]).count() == 0


def test_one_hot_names_match_by_prefix(spark):
    snap = spark.createDataFrame([("Tier-1", 0.2, 1), ("Tier-2", 0.9, 0), ("Tier-1", 0.4, 1), ("Tier-2", 0.1, 1)], f"city_tier string, util_avg_3m double, {S.LABEL} int")
    imp = AU.expanded_importance(snap, ["city_tier", "util_avg_3m"])
    assert {r["feature"] for r in imp.collect()} == {"city_tier_Tier-1", "city_tier_Tier-2", "util_avg_3m"}
    shares = {r["group"]: r["share"] for r in AU.importance_share(imp, AU.group_table(spark)).collect()}
    assert set(shares) == {"static", "behavioral"} and abs(sum(shares.values()) - 1) < 1e-12


@pytest.mark.parametrize("name", ["gradient_boosting", "random_forest"])
def test_walk_shuffles_no_vectors(spark, split, name):
    """Hold-out rows x trees went through a shuffle with their vectors at every level."""
    train, test = split
    f = _small(with_class_weights(train.select(*MD.role_features("full"), S.LABEL), S.LABEL), name)
    scored = f.model.transform(test.withColumn("k", F.struct(*KEYS))).select("k.*", "features", vector_to_array("probability")[1].alias("p"))
    out = MT.tree_walk(scored, KEYS, MT.tree_nodes(spark, f, tempfile.mkdtemp(prefix="ll-nodes-", dir="/tmp")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1      # the sums by key
    assert scored.join(out, KEYS).where(F.abs(F.col("p") - F.col("probability")) < 1e-9).count() == test.count()


def test_stored_tree_without_an_end(tmp_path):
    """A child that isn't stored, or no tree at all: no value. NaN goes right, as in the model."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    file = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"node": pa.array([2, 0, 1], pa.int32()), "feature": pa.array([None, 1, None], pa.int32()), "threshold": [None, 0.5, None],
                             "left_child": pa.array([2, 1, 1], pa.int32()), "right_child": pa.array([2, 2, 1], pa.int32()), "value": [0.75, None, None]}), file)
    x = np.array([[9.0, 0.5], [9.0, 0.6], [9.0, np.nan]])
    got = MT.stored_values(x, [f"file://{file}"], 3)
    assert np.isnan(got[0]) and got[1:].tolist() == [0.75, 0.75]
    assert np.isnan(MT.stored_values(x, [], 3)).all()
