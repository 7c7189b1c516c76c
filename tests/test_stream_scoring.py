"""X4 with saved models and profiles on a stream; X3 that takes over from a batch."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.operators import carry as C
from ledgerlens.operators.features import build_snapshots, finish_snapshots, window_features
from ledgerlens.plans import jobs as J
from ledgerlens.sources.fixtures import ledger, profiles
from ledgerlens.streaming import handover as H
from ledgerlens.streaming import scoring as SC

from .conftest import SF_SMALL


def _root(tag):
    return tempfile.mkdtemp(prefix=f"ll-{tag}-", dir="/tmp")


def _rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def trained(spark):
    root = _root("models")
    assert J.run_feature_job(spark, SF_SMALL, f"{root}/snapshots").ok
    res = J.run_training_job(spark, f"{root}/snapshots", root, run_id="r1", candidates=["logistic_regression"])
    return spark.read.parquet(J.last_good(spark, f"{root}/snapshots")), res.report["cold_model_path"], res.report["full_model_path"]


def test_saved_models_score_a_stream(spark, trained):
    snaps, cold, full = trained
    prof = profiles(spark, SF_SMALL)
    root = _root("requests")
    at = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(snapshot_month as int))")
    req = snaps.where("customer_id <= 40").withColumn(SC.REQUEST_ID, F.concat_ws("-", "customer_id", "snapshot_month")).withColumn(SC.REQUEST_TIME, at)
    # profile fields come from the table, but for one tier whose requests bring their age; one customer has no profile
    req = req.withColumn("age", F.when(F.col("customer_id") % 2 == 0, F.col("age") + 1))
    for c in S.STATIC_FEATURES:
        req = req.withColumn(c, F.lit(None).cast(req.schema[c].dataType)) if c != "age" else req
    prof = prof.where("customer_id <> 7").cache()
    names = SC.request_schema().fieldNames()
    req = req.select(*[F.col(c) if c in req.columns else F.lit(None).cast(SC.request_schema()[c].dataType).alias(c) for c in names]).cache()

    def send(name, cond):
        req.where(cond).coalesce(1).write.parquet(f"{root}/src/{name}")

    def run():
        q = SC.start_scoring(spark, f"{root}/src/*", prof, cold, full, f"{root}/out", f"{root}/ckpt", max_files_per_trigger=1)
        q.awaitTermination(600)
        assert q.exception() is None

    send("a", "snapshot_month % 3 = 0")
    send("b", "snapshot_month % 3 = 1 or customer_id = 5")          # customer 5 sends again
    run()
    send("c", "snapshot_month % 3 = 2 or customer_id in (5, 6)")    # and again after a restart
    run()
    got = spark.read.parquet(f"{root}/out")
    want = J.run_scoring_job(spark, SC.with_profiles(req, prof), cold, full, keep=[SC.REQUEST_ID, SC.REQUEST_TIME, "customer_id"])
    assert got.count() == req.count() and _rows(got) == _rows(want)
    assert _rows(SC.score_requests(spark, req.union(req), prof, cold, full)) == _rows(want)
    assert got.where("model_missing").count() == 0 and got.select("customer_tier").distinct().count() > 1
    with pytest.raises(ValueError, match="several profiles"):
        SC.start_scoring(spark, f"{root}/src/*", prof.union(prof), cold, full, f"{root}/out", f"{root}/ckpt")


def _stream(spark, src):
    return spark.readStream.schema(S.LEDGER).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def _run(stream, root, name="out"):
    q = (stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/ckpt-{name}")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(900)
    assert q.exception() is None


def test_carry_continues_the_window_features(spark):
    led = ledger(spark, SF_SMALL).cache()
    for cut in (2, 9):
        old, new = led.where(F.col("month") <= cut), led.where(F.col("month") > cut)
        carry = C.carry_rows(old)
        zero = new.join(carry, "customer_id").select("customer_id", "month", *[c for c in led.columns if c not in ("customer_id", "month")],
                                                     (F.col("n_rows") - F.size("rows")).alias("_rn0"), F.col("n_defaults").alias("_defaults0"), F.col("last_default_rn").alias("_last_default0"))
        both = zero.unionByName(C.carried_ledger(carry).select(*zero.columns))
        got = window_features(both).where((F.col("snapshot_month") > cut) & (F.col("_rn") > 3))
        want = window_features(led).where((F.col("snapshot_month") > cut) & (F.col("_rn") > 3))
        assert _rows(got) == _rows(want) and want.count() > 0
        assert _rows(C.carry_rows(both)) == _rows(C.carry_rows(led))


def test_stream_takes_over_from_a_batch(spark):
    H.use_rocksdb(spark)
    led = ledger(spark, SF_SMALL).where("month <= 9").cache()
    prof = profiles(spark, SF_SMALL)
    root = _root("handover")
    for m in (6, 7, 8, 9):
        led.where(F.col("month") == m).coalesce(1).write.parquet(f"{root}/src/m={m:02d}")
    led.where("month = 4").coalesce(1).write.parquet(f"{root}/src/m=99")        # a month of the batch again
    C.carry_rows(led.where("month <= 5")).write.parquet(f"{root}/carry")
    _run(H.continued_features(spark, _stream(spark, f"{root}/src"), spark.read.parquet(f"{root}/carry")), root)
    out = spark.read.parquet(f"{root}/out")
    got = finish_snapshots(H.features_of(out), prof)
    want = build_snapshots(led, prof).where("snapshot_month > 5")
    assert _rows(got.select(*want.columns)) == _rows(want) and want.count() > 0
    late = H.side_rows(out)
    assert late.where("kind = 'late' and month = 4").count() == led.where("month = 4").count() == late.count()


def test_idle_customers_are_evicted(spark):
    H.use_rocksdb(spark)
    led = ledger(spark, SF_SMALL).where("month <= 8").cache()
    root = _root("evict")
    half = F.col("customer_id") % 2 == 0
    led.where("month <= 4").coalesce(1).write.parquet(f"{root}/src/a")
    for name, cond in (("b", "month = 5"), ("c", "month = 6")):
        led.where(cond).where(half).coalesce(1).write.parquet(f"{root}/src/{name}")
    led.where("month = 7").coalesce(1).write.parquet(f"{root}/src/d")        # the odd ones come back
    # a query with timers has no last batch: it is stopped when all files are in
    q = (H.continued_features(spark, _stream(spark, f"{root}/src"), idle_ms=1).writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").outputMode("append").trigger(processingTime="1 second").start())
    end, total = time.time() + 120, led.where("month <= 4").count() + led.where("month in (5, 6)").where(half).count() + led.where("month = 7").count()
    while time.time() < end and q.isActive and sum(p["numInputRows"] for p in q.recentProgress) < total:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None
    out = spark.read.parquet(f"{root}/out")
    gone = H.evicted_carry(out).where(~half)
    want = C.carry_rows(led.where("month <= 4").where(~half))
    assert _rows(gone) == _rows(want) and want.count() > 0
    back = H.side_rows(out).where("kind = 'returned'").where(~half)
    assert back.count() == led.where("month = 7").where(~half).count()
    assert out.where("kind = 'features' and snapshot_month = 7").where(~half).count() == 0
