"""Streaming refresh equals the batch job; micro-batch scoring equals batch scoring."""

import os
import re
import tempfile

from pyspark.sql import functions as F

from ledgerlens.sources.fixtures import profiles
from ledgerlens.streaming import refresh as R

from .conftest import SF_SMALL


def _sorted(df, keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_refresh_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    prof = profiles(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-stream-", dir="/tmp")
    src, out, ckpt = (os.path.join(root, d) for d in ("src", "out", "ckpt"))
    # one file per day: the stream sees the history arrive day by day
    days = [r["d"] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i, d in enumerate(days[:8]):
        events.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.parquet(f"{src}/day={i:02d}")
    q = R.start_refresh(spark, src + "/*", prof, out, ckpt, available_now=True)
    q.awaitTermination(600)
    assert q.exception() is None
    streamed = R.latest_snapshots(spark, out)
    batch = R.event_snapshots(spark.read.schema(R.EVENTS).parquet(src + "/*"), prof)
    keys = ["customer_id", "snapshot_month"]
    cols = sorted(batch.columns)
    assert _sorted(streamed.select(*cols), keys) == _sorted(batch.select(*cols), keys)


def test_compacted_history_gives_the_same_refresh(spark):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    prof = profiles(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-compact-", dir="/tmp")
    days = [r["d"] for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()][:5]
    batch = lambda i: events.where(F.to_date("ts") == F.lit(days[i]))
    for i in range(4):
        R.refresh_batch(spark, batch(i), i, f"{root}/h", prof, f"{root}/out", buckets=4)
    R.compact_history(spark, f"{root}/h", buckets=4)
    assert sorted(os.listdir(f"{root}/h")) == ["batch_id=-1", "batch_id=3"]
    R.refresh_batch(spark, batch(3), 3, f"{root}/h", prof, f"{root}/out", buckets=4)      # the newest batch again
    # an interruption after the merge is finished by the next refresh
    R.compact_history(spark, f"{root}/h", buckets=4)
    os.rename(f"{root}/h/batch_id=-1", f"{root}/h__compact-2")
    R.refresh_batch(spark, batch(4), 4, f"{root}/h", prof, f"{root}/out", buckets=4)
    whole = R.event_snapshots(events.where(F.to_date("ts").isin(days)), prof)
    keys, cols = ["customer_id", "snapshot_month"], sorted(whole.columns)
    assert _sorted(R.latest_snapshots(spark, f"{root}/out").select(*cols), keys) == _sorted(whole.select(*cols), keys)


def test_score_stream_equals_batch(spark):
    from ledgerlens.operators.features import build_snapshots
    from ledgerlens.sources.fixtures import ledger
    snaps = build_snapshots(ledger(spark, SF_SMALL), profiles(spark, SF_SMALL))
    root = tempfile.mkdtemp(prefix="ll-score-", dir="/tmp")
    snaps.repartition(4).write.parquet(f"{root}/req")
    stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/req")
    q = (R.score_stream(stream).writeStream.format("parquet").option("path", f"{root}/scored")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.read.parquet(f"{root}/scored").drop("risk_warnings")
    exp = R.score_stream(snaps).drop("risk_warnings")
    keys = ["customer_id", "snapshot_month"]
    assert _sorted(got.select(*sorted(exp.columns)), keys) == _sorted(exp.select(*sorted(exp.columns)), keys)


def test_stateful_stream_equals_batch(spark):
    """Per-customer state over a month-by-month ledger stream gives the
    same snapshots as the batch window job; a replayed old month is late."""
    from ledgerlens import schemas as S
    from ledgerlens.operators.features import build_snapshots, finish_snapshots
    from ledgerlens.sources.fixtures import ledger
    from ledgerlens.streaming.state import split_late, stateful_window_features

    led = ledger(spark, SF_SMALL).where("month <= 7")
    prof = profiles(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-state-", dir="/tmp")
    for m in range(1, 8):
        led.where(F.col("month") == m).coalesce(1).write.parquet(f"{root}/src/m={m:02d}")
    # a duplicate of month 2 arriving after month 7
    led.where(F.col("month") == 2).coalesce(1).write.parquet(f"{root}/src/m=99")
    stream = (spark.readStream.schema(S.LEDGER).option("maxFilesPerTrigger", 1)
              .parquet(f"{root}/src/*"))
    feats = stateful_window_features(spark, stream)
    q = (feats.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(900)
    assert q.exception() is None
    on_time, late = split_late(spark.read.parquet(f"{root}/out"))
    streamed = finish_snapshots(on_time, prof)
    batch = build_snapshots(led, prof)
    keys = ["customer_id", "snapshot_month"]
    cols = sorted(batch.columns)
    assert _sorted(streamed.select(*cols), keys) == _sorted(batch.select(*cols), keys)
    assert late.count() == led.where("month = 2").count()


def test_refresh_works_on_changed_days_only(spark):
    """In-order batches read no older day; late data goes back to an older carry row; compacted output is the same."""
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").cache()
    prof = profiles(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="ll-carry-", dir="/tmp")
    day = F.datediff(F.to_date("ts"), F.lit(R.BASE_DATE)) + 1
    lo = events.agg(F.min(day)).first()[0]
    batches = [(lo, lo + 3), (lo + 4, lo + 12), (lo + 13, lo + 16), (lo + 17, lo + 20)]
    late = (day == lo + 14) & (F.col("user_id") % 3 == 0)
    parts = [events.where(day.between(a, b) & ~late) for a, b in batches] + [events.where(late)]
    for i, part in enumerate(parts[:4]):
        R.refresh_batch(spark, part, i, f"{root}/h", prof, f"{root}/out", buckets=4)
    mine = spark.read.parquet(f"{root}/h/batch_id=3")
    touched = R.touched_customers(spark, mine, f"{root}/out_carry", 3)
    read = R.partials_to_rebuild(spark, f"{root}/h", touched)
    old = touched.where("carry is null").count()
    assert read.where("carry is not null and month < first_changed").count() <= read.where("carry is not null").count() / 4
    known = touched.where("carry is not null")
    some = R.partials_to_rebuild(spark, f"{root}/h", known)
    first = known.agg(F.min("carry.month")).first()[0]
    assert some.agg(F.min("month")).first()[0] > first and known.count() > 10 * max(old, 1)
    plan = some._jdf.queryExecution().sparkPlan().toString()
    eras = [int(x) for x in re.findall(r"era#\d+ >= (\d+)", plan)]
    assert eras and min(eras) >= (first + 1) // R.ERA_DAYS
    R.compact_snapshots(spark, f"{root}/out")
    R.compact_history(spark, f"{root}/h", buckets=4)
    for _ in range(2):      # and once more, as a replay
        R.refresh_batch(spark, parts[4], 4, f"{root}/h", prof, f"{root}/out", buckets=4)
    back = R.touched_customers(spark, spark.read.parquet(f"{root}/h/batch_id=4"), f"{root}/out_carry", 4).where("carry is not null")
    assert back.where("carry.month >= first_changed").count() == 0 and back.count() > 0
    whole = R.event_snapshots(events.where(day.between(lo, lo + 20)), prof)
    keys, cols = ["customer_id", "snapshot_month"], sorted(whole.columns)
    assert _sorted(R.latest_snapshots(spark, f"{root}/out").select(*cols), keys) == _sorted(whole.select(*cols), keys)
    # a later batch after late data starts from the carry row that the late batch wrote
    nxt = events.where(day.between(lo + 21, lo + 23))
    R.refresh_batch(spark, nxt, 5, f"{root}/h", prof, f"{root}/out", buckets=4)
    whole = R.event_snapshots(events.where(day.between(lo, lo + 23)), prof)
    assert _sorted(R.latest_snapshots(spark, f"{root}/out").select(*cols), keys) == _sorted(whole.select(*cols), keys)
