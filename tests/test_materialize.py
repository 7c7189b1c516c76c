"""Written intermediate tables: write-once versions, reuse, fresh rebuild per run tag."""

import os

from ledgerlens.plans import materialize as MZ

from .conftest import SF_SMALL


def test_versions_are_write_once_and_reused(spark, monkeypatch):
    monkeypatch.setenv("LEDGERLENS_RUN_TAG", "t-" + os.urandom(4).hex())
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")

    a = MZ.materialized(spark, "mz_test", SF_SMALL, ["customer"], build)
    b = MZ.materialized(spark, "mz_test", SF_SMALL, ["customer"], build)
    assert len(calls) == 1 and a.count() == b.count() == 5
    # an incomplete version (no _SUCCESS) is ignored by readers
    path = a.inputFiles()[0].rsplit("/", 1)[0]
    base = path.rsplit("/", 1)[0].replace("file:", "")
    os.makedirs(os.path.join(base, "v=0000-incomplete"))
    c = MZ.materialized(spark, "mz_test", SF_SMALL, ["customer"], build)
    assert len(calls) == 1 and c.count() == 5
    # a new run tag builds a fresh table
    monkeypatch.setenv("LEDGERLENS_RUN_TAG", "t-" + os.urandom(4).hex())
    MZ.materialized(spark, "mz_test", SF_SMALL, ["customer"], build)
    assert len(calls) == 2


def test_changed_file_in_a_folder_is_seen(spark, tmp_path):
    d = tmp_path / "in"
    spark.range(10).repartition(2).write.parquet(str(d / "customer.parquet"))
    build = lambda: spark.read.parquet(str(d / "customer.parquet"))
    assert MZ.materialized(spark, "mz_change", str(d), ["customer"], build).count() == 10
    spark.range(3).write.mode("append").parquet(str(d / "customer.parquet"))
    assert MZ.materialized(spark, "mz_change", str(d), ["customer"], build).count() == 13
    assert MZ.drop_other_versions(spark, "mz_change", str(d), ["customer"]) == 1
    assert MZ.materialized(spark, "mz_change", str(d), ["customer"], build).count() == 13


def test_no_local_folder_off_a_local_master():
    import pytest

    from ledgerlens.session import ensure_checkpoint_dir

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)
