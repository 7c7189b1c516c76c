"""Scoring requests on a stream with the saved models.

A request carries an id, a time, a customer and the behavioural fields; its profile fields come from the profile table
by a stream-static join, unless the request brings them itself. A request that is sent again within the watermark is scored
once (``dropDuplicatesWithinWatermark``). Both saved pipelines transform the stream itself, then the tier router decides:
all of it but the duplicate check is stateless, so the state is one key per request of the watermark's span. The file sink
and the checkpoint make the output exactly-once over restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..plans.jobs import run_scoring_job

REQUEST_ID, REQUEST_TIME = "request_id", "requested_at"
DELAY = "1 hour"


def request_schema() -> T.StructType:
    """The fields of a stream of requests, all nullable but the key columns."""
    return T.StructType([T.StructField(REQUEST_ID, T.StringType()), T.StructField(REQUEST_TIME, T.TimestampType()),
                         T.StructField("customer_id", T.LongType()), *S.scoring_input_schema().fields])


def with_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with the profile fields they don't bring; a customer without a profile keeps what the request has.
    ``profiles`` has one row per customer."""
    static = [c for c in S.STATIC_FEATURES if c in profiles.columns]
    known = profiles.select(F.col("customer_id").alias("_profile_of"), *[F.col(c).alias(f"_profile_{c}") for c in static])
    joined = requests.join(known, F.col("customer_id") == F.col("_profile_of"), "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_profile_{c}")) if c in requests.columns else F.col(f"_profile_{c}") for c in static}
    return joined.withColumns(filled).drop("_profile_of", *[f"_profile_{c}" for c in static])


def assert_one_profile_each(profiles: DataFrame) -> None:
    twice = profiles.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"customers with several profiles: {[r['customer_id'] for r in twice]}")


def score_requests(spark: SparkSession, requests: DataFrame, profiles: DataFrame, cold_model_path: str, full_model_path: str,
                   delay: str = DELAY, zero_on_reject: bool = False) -> DataFrame:
    """Scored requests: id, time, customer and the router's columns (F17), for a stream or a batch of requests."""
    if requests.isStreaming:
        once = requests.withWatermark(REQUEST_TIME, delay).dropDuplicatesWithinWatermark([REQUEST_ID])
    else:
        once = requests.dropDuplicates([REQUEST_ID])
    return run_scoring_job(spark, with_profiles(once, profiles), cold_model_path, full_model_path,
                           keep=[REQUEST_ID, REQUEST_TIME, "customer_id"], zero_on_reject=zero_on_reject)


def start_scoring(spark: SparkSession, source_dir: str, profiles: DataFrame, cold_model_path: str, full_model_path: str, out_path: str,
                  checkpoint_dir: str, delay: str = DELAY, max_files_per_trigger: int | None = None, available_now: bool = True,
                  interval: str = "2 seconds", schema: T.StructType | None = None):
    """Start the query over a folder of Parquet files of requests; scored rows are appended to ``out_path``."""
    assert_one_profile_each(profiles)
    reader = spark.readStream.schema(schema or request_schema())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_requests(spark, reader.parquet(source_dir), profiles, cold_model_path, full_model_path, delay)
    writer = scored.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_dir).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
