"""Scratch tables go with the scope or job that wrote them."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.order_stats import exact_quantiles, written
from ledgerlens.plans import jobs as J
from ledgerlens.session import scratch_scope, sweep_scratch, warehouse_path

from .conftest import SF_SMALL


def _tables(spark):
    return set(glob.glob(warehouse_path(spark, "scratch/*").replace("file:", "")))


def test_scope_drops_its_tables(spark):
    before = _tables(spark)
    with scratch_scope(spark):
        got = exact_quantiles(spark.range(1000).select(F.col("id").cast("double").alias("x")), "x", [0.5]).collect()
        assert got[0]["quantile"] == 499.5 and _tables(spark) > before
    assert _tables(spark) == before
    with pytest.raises(RuntimeError), scratch_scope(spark):
        written(spark.range(5), "lost")
        raise RuntimeError
    assert _tables(spark) == before


def test_a_failed_write_goes_too(spark):
    before = _tables(spark)
    bad = spark.range(5).select(F.raise_error(F.concat(F.lit("row "), F.col("id").cast("string"))).cast("string").alias("x"))
    with pytest.raises(Exception, match="row"), scratch_scope(spark):     # noqa: B017, PT011
        written(bad, "half")
    assert _tables(spark) == before


def test_inner_scopes_hand_tables_on(spark):
    before = _tables(spark)
    with scratch_scope(spark):
        with scratch_scope(spark) as inner:
            kept, lost = written(spark.range(5), "kept"), written(spark.range(5), "lost")
            inner.keep(next(p for p in inner.paths if "/kept-" in p))
        assert kept.count() == 5 and len(_tables(spark) - before) == 1
        assert not any("/lost-" in p for p in _tables(spark)) and lost.columns == ["id"]
    assert _tables(spark) == before


def test_jobs_leave_no_scratch(spark):
    root = tempfile.mkdtemp(prefix="ll-scr-", dir="/tmp")
    snap, before = os.path.join(root, "snapshots"), _tables(spark)
    assert J.run_feature_job(spark, SF_SMALL, snap).ok
    res = J.run_training_job(spark, snap, root, run_id="r1", candidates=["logistic_regression"])
    assert res.ok and _tables(spark) == before
    assert spark.read.parquet(f"{root}/evaluation/full/r1").count() > 0
    with pytest.raises(Exception):      # noqa: B017, PT011 — an unknown candidate
        J.run_training_job(spark, snap, root, run_id="r2", candidates=["no such model"])
    assert _tables(spark) == before


def test_sweep_takes_old_tables_only(spark):
    with scratch_scope(spark):
        t = written(spark.range(5), "fresh")
        assert sweep_scratch(spark, older_than_hours=1) == 0 and t.count() == 5
    old = written(spark.range(5), "old")
    path = os.path.dirname(old.inputFiles()[0].replace("file://", ""))
    os.utime(path, (0, 0))
    assert sweep_scratch(spark, older_than_hours=24 * 365) >= 1 and not os.path.exists(path)
