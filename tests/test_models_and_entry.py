"""Models on the smallest scale, persistence, and the driver contract."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlens import schemas as S
from ledgerlens.operators import models as MD
from ledgerlens.operators import prep as PR
from ledgerlens.plans.q_models import _split

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def split(spark):
    train, test = _split(spark, SF_SMALL)
    return train.persist(), test.persist()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == ["risk_band", "n_rows", "default_rate", "avg_risk_score"]
    assert len(rows) >= 1


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    for name, sql in o.items():
        assert sql.strip(), name


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "x double")
    m = PR.MedianImputer(inputCols=["x"]).fit(df)
    assert m.getOrDefault(m.values) == [3.0]          # numpy median, not the lower one
    assert sorted(r["x"] for r in m.transform(df).collect()) == [1.0, 2.0, 3.0, 4.0, 8.0]


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = PR.PopulationScaler(inputCols=["a", "b"]).fit(df)
    got = [(r["a"], r["b"]) for r in m.transform(df).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]            # population std = 1; constant column -> 0


def test_lr_full_beats_cold_and_roundtrips(spark, split):
    train, test = split
    full = MD.fit_candidate(train, "full", "logistic_regression")
    cold = MD.fit_candidate(train, "cold", "logistic_regression")
    fa = MD.evaluate(full, test)["roc_auc"]
    ca = MD.evaluate(cold, test)["roc_auc"]
    assert fa > ca and fa >= 0.7
    path = MD.save_model(full, tempfile.mkdtemp(prefix="ll-model-", dir="/tmp"), "t1")
    loaded = MD.load_model(path)
    a = MD.predict(full, test, keep=["customer_id", "snapshot_month"]).orderBy("customer_id", "snapshot_month")
    b = MD.predict(loaded, test, keep=["customer_id", "snapshot_month"]).orderBy("customer_id", "snapshot_month")
    assert [r["probability"] for r in a.collect()] == [r["probability"] for r in b.collect()]
    # unseen category still scores (all-zero one-hot)
    odd = test.limit(3).withColumn("employment_status", F.lit("Astronaut"))
    assert all(0.0 <= r["probability"] <= 1.0 for r in MD.predict(full, odd).collect())
    imp = MD.feature_importance(spark, full)
    assert imp.count() == len(MD.role_features("full")) - len(S.CATEGORICAL_STATIC) + sum(
        len(s.labels) for s in full.model.stages if hasattr(s, "labels"))


def test_importance_names_are_aligned(spark):
    """Each one-hot slot is named after its own category, an unseen one is all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = [(float(i), ["a", "b", "c"][i % 3], ["x", None, "z"][i % 3]) for i in range(9)]
    df = spark.createDataFrame(rows, "n double, c string, d string")
    model = Pipeline(stages=PR.preprocessor(["c", "d"], ["n"])).fit(df)
    names = PR.expanded_feature_names(model, ["c", "d"], ["n"])
    assert names == ["n", "c_a", "c_b", "c_c", "d_Unknown", "d_x", "d_z"]
    odd = spark.createDataFrame([(4.0, "b", None), (4.0, "new", "z")], "n double, c string, d string")
    got = [r["v"] for r in model.transform(odd).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0.0, 0, 1, 0, 1, 0, 0], [0.0, 0, 0, 0, 0, 0, 1]]


def test_one_class_hold_out_is_reported(spark, split):
    train, test = split
    f = MD.fit_candidate(train, "cold", "logistic_regression")
    MD.evaluate(f, test.where(F.col(S.LABEL) == 0))
    row = MD.comparison_frame(spark, {f.name: f}, f.name).first()
    assert row["roc_auc"] is None and row["accuracy"] is not None
