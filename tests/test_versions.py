"""Versioned publishing: readers during a publish, concurrent writers, failed checks, expiry."""

import os
import tempfile
import threading
import time

import pytest

from ledgerlens.plans import jobs as J
from ledgerlens.plans import versions as V

from .conftest import SF_SMALL


@pytest.fixture
def root():
    return os.path.join(tempfile.mkdtemp(prefix="ll-versions-", dir="/tmp"), "table")


def test_reader_keeps_its_version(spark, root):
    assert V.current(spark, root) is None
    n, first = V.publish_version(spark, spark.range(100), root)
    reader = spark.read.parquet(V.current(spark, root)[1])
    assert (n, V.current(spark, root)) == (1, (1, first))
    V.publish_version(spark, spark.range(7), root)
    assert reader.count() == 100 and spark.read.parquet(V.current(spark, root)[1]).count() == 7


def test_failed_check_and_unfinished_pointer_change_nothing(spark, root):
    V.publish_version(spark, spark.range(5), root)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        V.publish_version(spark, spark.range(9), root, refuse)
    assert V.current(spark, root)[0] == 1 and len(os.listdir(f"{root}/{V.VERSIONS}")) == 1
    # a writer that died between creating a pointer and filling it
    open(f"{root}/{V.POINTERS}/{2:012d}", "w").close()
    assert V.current(spark, root)[0] == 1
    assert V.publish_version(spark, spark.range(3), root)[0] == 3 and spark.read.parquet(V.current(spark, root)[1]).count() == 3


def test_concurrent_writers(spark, root):
    """All versions are complete, numbers are unique; of writers that expect the same version one commits."""
    V.publish_version(spark, spark.range(1), root)
    done, lost = [], []

    def write(n, expected):
        try:
            done.append(V.publish_version(spark, spark.range(n), root, expected=expected))
        except V.Conflict:
            lost.append(n)

    for expected, winners in ((None, 4), (5, 1)):
        done.clear()
        lost.clear()
        threads = [threading.Thread(target=write, args=(10 + i, expected)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(done) == winners and len(lost) == 4 - winners and len({n for n, _ in done}) == winners
        assert V.current(spark, root) == max(done)
    assert V.current(spark, root)[0] == 6 and 10 <= spark.read.parquet(V.current(spark, root)[1]).count() < 14


def test_expiry_waits_for_the_grace_period(spark, root):
    paths = [V.publish_version(spark, spark.range(n), root)[1] for n in (1, 2, 3)]
    assert V.expire(spark, root) == []
    spark.range(4).write.parquet(f"{root}/{V.VERSIONS}/v-orphan")
    gone = V.expire(spark, root, 60, now=time.time() + 120)
    assert sorted(gone) == sorted([*[os.path.basename(p) for p in paths[:2]], "v-orphan"])
    assert V.current(spark, root) == (3, paths[2]) and spark.read.parquet(paths[2]).count() == 3
    assert V.publish_version(spark, spark.range(8), root)[0] == 4


def test_jobs_on_a_versioned_table(spark, root):
    assert J.run_feature_job(spark, SF_SMALL, root, versioned=True).ok
    first = J.last_good(spark, root)
    rows = spark.read.parquet(first).count()
    assert J.run_feature_job(spark, SF_SMALL, root, versioned=True).ok
    assert J.last_good(spark, root) != first and spark.read.parquet(first).count() == rows == spark.read.parquet(J.last_good(spark, root)).count()
    assert not J.run_feature_job(spark, "/nonexistent", root, versioned=True).ok and V.current(spark, root)[0] == 2
    assert J.run_training_job(spark, root, f"{root}-models", run_id="r", candidates=["logistic_regression"]).ok
