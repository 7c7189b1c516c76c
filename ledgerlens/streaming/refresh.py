"""Structured Streaming: incremental refresh and micro-batch scoring.

The reference polls two file mtimes and recomputes everything on a change,
retrying a failed run. Here:

* X1  ``readStream`` over a folder of new event files; the checkpoint makes a
      failed micro-batch re-run (same ``batch_id``) — the retry.
* X2  in ``foreachBatch``: the batch's per-customer-day partial aggregates
      are written to a history table partitioned by ``batch_id``, a
      customer hash bucket and an era of days. A customer's rebuild begins at the first day that the batch changes: what
      came before is in the customer's carry row (``operators.carry``), of which every batch writes a new version, so the
      history is read from the changed days on only (partition pruning). A version counts as long as no later batch
      changed a day up to its own; late data goes back to an older one. The rebuilt snapshot rows are written to
      ``batch_id=<n>`` with overwrite, so a replayed batch is idempotent; ``latest_snapshots``
      keeps the newest row of each customer and day, ``compact_snapshots`` merges the batches.
* X4  ``score_stream``: a stateless projection of the scoring policy over a
      stream of scoring requests.

Event mapping (fixture C): period = day number since ``base_date`` (1-based);
a ``purchase`` is a transaction of ``value``; an ``error`` on that day means
40% paid, else 100%.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import policy as P
from .. import schemas as S
from ..operators import carry as C
from ..operators.features import build_snapshots, finish_snapshots, window_features
from ..sources.fixtures import BEFORE, ledger_from_amounts

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

_PARTIALS = "customer_id long, month int, n long, cents long, err int, bucket int, era int"
BASE_DATE = "2024-01-01"   # fixture parameter: day 1 of the event stream
ERROR_PAID_PERCENT, CLEAN_PAID_PERCENT = 40, 100


def day_partials(events: DataFrame, base_date: str = BASE_DATE) -> DataFrame:
    """Per (customer, day) partial aggregates: purchase count, purchase cents,
    error seen. Re-aggregating partials gives the same result, so they can be
    kept per micro-batch and combined later."""
    day = (F.datediff(F.to_date("ts"), F.lit(base_date)) + 1).cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    is_purchase = F.col("event_type") == "purchase"
    return events.groupBy(F.col("user_id").cast("long").alias("customer_id"), day.alias("month")).agg(
        F.sum(is_purchase.cast("long")).alias("n"),
        F.coalesce(F.sum(F.when(is_purchase, cents)), F.lit(0)).cast("long").alias("cents"),
        F.max((F.col("event_type") == "error").cast("int")).alias("err"))


def amounts_from_partials(partials: DataFrame, begin: DataFrame | None = None) -> DataFrame:
    """(customer_id, month=day, n, bill4, paid4) on a dense spine from each
    customer's first day (``lo`` of ``begin``, if the customer is there) to the last (gaps are inactive days)."""
    per_day = partials.groupBy("customer_id", "month").agg(
        F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("err").alias("err"))
    share = F.when(F.col("err") == 1, F.lit(ERROR_PAID_PERCENT)).otherwise(F.lit(CLEAN_PAID_PERCENT))
    active = per_day.select("customer_id", "month", "n", (F.col("cents") * 100).alias("bill4"),
                            (F.col("cents") * share).alias("paid4"))
    span = per_day.groupBy("customer_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    if begin is not None:
        span = span.join(begin.withColumnRenamed("lo", "_lo"), "customer_id", "left").withColumn("lo", F.coalesce("_lo", "lo"))
    spine = span.select("customer_id", F.explode(F.sequence("lo", "hi")).alias("month"),
                        F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bill4"),
                        F.lit(0).cast("long").alias("paid4"))
    return (active.unionByName(spine).groupBy("customer_id", "month")
            .agg(F.sum("n").alias("n"), F.sum("bill4").alias("bill4"), F.sum("paid4").alias("paid4")))


def event_amounts(events: DataFrame, base_date: str = BASE_DATE) -> DataFrame:
    return amounts_from_partials(day_partials(events, base_date))


def event_ledger(events: DataFrame, base_date: str = BASE_DATE) -> DataFrame:
    return ledger_from_amounts(event_amounts(events, base_date))


def event_snapshots(events: DataFrame, profiles: DataFrame, base_date: str = BASE_DATE) -> DataFrame:
    return build_snapshots(event_ledger(events, base_date), profiles)


#: Buckets of the history table: choose so that one bucket's history is a task or a few.
HISTORY_BUCKETS = 64


def _bucket(c: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(c)), F.lit(buckets)).cast("int")


#: Days of an era, the unit in which the history is left out.
ERA_DAYS = 8


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _stored_partials(partials: DataFrame, buckets: int) -> DataFrame:
    return partials.withColumn("bucket", _bucket("customer_id", buckets)).withColumn("era", F.floor(F.col("month") / ERA_DAYS).cast("int"))


def touched_customers(spark: SparkSession, mine: DataFrame, carry_dir: str, batch_id: int) -> DataFrame:
    """(customer_id, bucket, first_changed, carry): the customers of a batch's partials with the newest carry row before
    the first changed day that still counts, NULL if there is none."""
    touched = mine.groupBy("customer_id", "bucket").agg(F.min("month").alias("first_changed"))
    if not _exists(spark, carry_dir):
        kind = T.StructType([*C.CARRY.fields[1:], T.StructField("month", T.IntegerType()), T.StructField("unpaid4", T.LongType())])
        return touched.withColumn("carry", F.lit(None).cast(kind))
    hit = [r["bucket"] for r in mine.select("bucket").distinct().collect()]   # at most `buckets` values
    kept = spark.read.parquet(carry_dir).where(F.col("bucket").isin(hit) & (F.col("batch_id") < batch_id)).withColumnRenamed("first_changed", "changed_by")
    later = Window.partitionBy("customer_id").orderBy(F.col("batch_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.join(touched.select("customer_id", "first_changed"), "customer_id").withColumn("_later", F.min("changed_by").over(later))
    counts = (F.col("month") < F.col("first_changed")) & F.coalesce(F.col("_later") > F.col("month"), F.lit(True))
    names = [f.name for f in C.CARRY.fields[1:]]
    best = kept.where(counts).groupBy("customer_id").agg(F.max_by(F.struct(*names, "month", "unpaid4"), F.struct("month", "batch_id")).alias("carry"))
    return touched.join(best, "customer_id", "left")


def partials_to_rebuild(spark: SparkSession, history_dir: str, touched: DataFrame) -> DataFrame:
    """The history rows of touched customers after their carry row (columns of the partials, first_changed, carry)."""
    first = touched.agg(F.min(F.coalesce(F.col("carry.month") + 1, F.lit(-(1 << 30))))).first()[0]
    hit = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
    history = spark.read.parquet(history_dir).where(F.col("bucket").isin(hit) & (F.col("era") >= (first if first is not None else 0) // ERA_DAYS))
    return history.drop("bucket").join(touched.drop("bucket"), "customer_id").where(F.col("carry").isNull() | (F.col("month") > F.col("carry.month")))


def continued_ledger(touched: DataFrame, partials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger with ``carry.OFFSETS``: the carried rows and the new ones; unpaid sum of the new rows by customer)."""
    carry = touched.where("carry is not null").select("customer_id", "carry.*")
    amounts = amounts_from_partials(partials.select("customer_id", "month", "n", "cents", "err"),
                                    carry.select("customer_id", (F.col("month") + 1).alias("lo")))
    last = F.element_at("rows", -1)
    before = carry.select("customer_id", F.struct(F.col("unpaid4"), last["missed"].alias("missed_due_flag"), last["ratio"].alias("payment_ratio"),
                                                  last["bal"].alias("outstanding_balance"), last["late"].alias("late_payment")).cast(BEFORE).alias("before"))
    new = ledger_from_amounts(amounts.join(before, "customer_id", "left"))
    offsets = carry.select("customer_id", (F.col("n_rows") - F.size("rows")).alias("_rn0"), F.col("n_defaults").alias("_defaults0"), F.col("last_default_rn").alias("_last_default0"))
    new = new.join(offsets, "customer_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in C.OFFSETS})
    both = new.unionByName(C.carried_ledger(carry).select(*new.columns))
    return both, amounts.groupBy("customer_id").agg(F.sum(F.col("bill4") - F.col("paid4")).alias("unpaid_new"))


def refresh_batch(spark: SparkSession, batch: DataFrame, batch_id: int, history_dir: str, profiles: DataFrame,
                  out_dir: str, base_date: str = BASE_DATE, buckets: int = HISTORY_BUCKETS, lookback: int = S.LOOKBACK_MONTHS) -> None:
    """X2 body: this batch's partials are appended to the history, the snapshots of its customers are rebuilt from the
    first changed day on, then the customers' new carry rows are written. Each table has a folder
    of this batch, written with overwrite, and carry rows of earlier batches only are read: a replay gives the same."""
    base, out, carry_dir = history_dir.rstrip("/"), out_dir.rstrip("/"), f"{out_dir.rstrip('/')}_carry"
    finish_compaction(spark, base)
    finish_compaction(spark, out)
    _stored_partials(day_partials(batch, base_date), buckets).write.mode("overwrite").partitionBy("bucket", "era").parquet(f"{base}/batch_id={batch_id}")
    mine = spark.read.schema(_PARTIALS).parquet(f"{base}/batch_id={batch_id}")
    touched = touched_customers(spark, mine, carry_dir, batch_id)
    ledger, unpaid = continued_ledger(touched, partials_to_rebuild(spark, base, touched))
    begin = touched.select("customer_id", F.col("carry.month").alias("_carried"))
    feats = window_features(ledger, lookback).where(F.col("_rn") > lookback).join(begin, "customer_id")
    feats = feats.where(F.col("_carried").isNull() | (F.col("snapshot_month") > F.col("_carried"))).drop("_carried")
    finish_snapshots(feats, profiles).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    carry = (C.carry_rows(ledger, lookback).join(touched, "customer_id").join(unpaid, "customer_id")
             .select("customer_id", "bucket", "first_changed", *[c for c in C.CARRY.fieldNames() if c != "customer_id"],
                     F.element_at("rows", -1)["month"].alias("month"), (F.coalesce(F.col("carry.unpaid4"), F.lit(0)) + F.col("unpaid_new")).alias("unpaid4")))
    carry.write.mode("overwrite").partitionBy("bucket").parquet(f"{carry_dir}/batch_id={batch_id}")


def start_refresh(spark: SparkSession, source_dir: str, profiles: DataFrame, out_dir: str,
                  checkpoint_dir: str, history_dir: str | None = None, base_date: str = BASE_DATE,
                  available_now: bool = True, max_files_per_trigger: int | None = None, interval: str = "2 seconds",
                  buckets: int = HISTORY_BUCKETS):
    """Stream new event files into incremental refreshes, all waiting files in one micro-batch
    unless ``max_files_per_trigger`` limits it."""
    history_dir = history_dir or f"{out_dir.rstrip('/')}_history"
    reader = spark.readStream.schema(EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: refresh_batch(spark, df, bid, history_dir, profiles, out_dir, base_date, buckets))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def latest_snapshots(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per customer and day, the snapshot row of the newest batch that has one."""
    finish_compaction(spark, out_dir.rstrip("/"))
    allb = spark.read.parquet(out_dir)
    newest = allb.groupBy("customer_id", "snapshot_month").agg(F.max("batch_id").alias("batch_id"))
    return allb.join(newest, ["customer_id", "snapshot_month", "batch_id"], "left_semi").drop("batch_id")


COMPACTED = -1      # batch_id of the merged history


def _compact(spark: SparkSession, folder: str, merge, partition_by: list[str]) -> None:
    """Merge all batches of a folder but the newest (a failed micro-batch writes that one
    again) into one. Run between refreshes. The merged table is complete before
    the folders that went into it are removed; what an interruption leaves is finished by the
    next call or refresh."""
    base = folder.rstrip("/")
    finish_compaction(spark, base)
    every = spark.read.parquet(base)
    ids = sorted(r["batch_id"] for r in every.select("batch_id").distinct().collect())[:-1]
    if len(ids) < 2:
        return
    merged = merge(every.where(F.col("batch_id").isin(ids)))
    w = (merged.hint("rebalance", *partition_by) if partition_by else merged).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{base}__compact-{ids[-1]}")
    finish_compaction(spark, base)


def compact_history(spark: SparkSession, history_dir: str, buckets: int = HISTORY_BUCKETS) -> None:
    """One row per customer and day of the merged batches."""
    _compact(spark, history_dir, lambda df: _stored_partials(
        df.groupBy("customer_id", "month").agg(F.sum("n").alias("n"), F.sum("cents").cast("long").alias("cents"), F.max("err").alias("err")), buckets), ["bucket", "era"])


def compact_snapshots(spark: SparkSession, out_dir: str) -> None:
    """The newest snapshot row per customer and day of the merged batches."""
    def merge(df: DataFrame) -> DataFrame:
        newest = df.groupBy("customer_id", "snapshot_month").agg(F.max("batch_id").alias("batch_id"))
        return df.join(newest, ["customer_id", "snapshot_month", "batch_id"], "left_semi").drop("batch_id")

    _compact(spark, out_dir, merge, [])


def finish_compaction(spark: SparkSession, history_dir: str) -> None:
    base = history_dir.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [x.getPath() for x in fs.globStatus(path(f"{base}__compact-*")) or [] if fs.exists(path(f"{x.getPath()}/_SUCCESS"))]
    for new in done:
        last = int(new.getName().rsplit("__compact-", 1)[1])
        for x in fs.globStatus(path(f"{base}/batch_id=*")) or []:
            if int(x.getPath().getName().split("=")[1]) <= last:
                fs.delete(x.getPath(), True)
        fs.rename(new, path(f"{base}/batch_id={COMPACTED}"))


def score_stream(requests: DataFrame) -> DataFrame:
    """The policy router over a (streaming) DataFrame of scoring requests,
    with the surrogate probabilities; a pure projection, so it runs per
    micro-batch without state."""
    cols = requests.columns
    keep = [c for c in ("customer_id", "snapshot_month") if c in cols]
    return P.route(requests, P.surrogate_cold_probability(cols), P.surrogate_full_probability(), keep=keep)
