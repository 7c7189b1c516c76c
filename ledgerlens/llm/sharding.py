"""Operator 4, sharding (DataFrame functions only): sampled splitters. Size-weighted key
samples give quantile boundaries, records are range-partitioned between them, overfull ranges are subdivided.

The law is ``bytes``: shards of nearly equal size. A record's key is a hash of its text, so that
equal texts are one group; a group stays in one shard, unless it is larger than a shard.

1. Sample: a group is drawn with probability bytes * samples / total, by a hash of its key;
   large groups are certain to be in it. Expected size: at most ``SAMPLES_PER_RANGE`` a range.
2. Boundaries: quantiles of the sample's cumulated weights, ``RANGES_PER_SHARD`` a shard.
3. Units: groups over 1/``LARGE`` of a shard are units by themselves (there are at most LARGE a shard), larger than a
   shard in pieces by row. The rest lies in ranges; a range with over twice its share is subdivided by hash.
4. Units to shards: large ones by size, back and forth; ranges in order, up to the level that makes the shards even.
5. Slots: units and their pieces of about ``PIECE_ROWS`` rows get offsets from a running sum of their counts,
   records a row number in their piece.

Defined results: null text has size 1 and crc32 0; null doc_ids and equal rows are records like any other; an empty table gives
an empty table; other columns of the input are not read.

Scale: the texts are read once, for their sizes and hashes; no window holds more than one piece, one shard's units or the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Stored, cols, stored, table

SHARDS = 8
RANGES_PER_SHARD = 256
SAMPLES_PER_RANGE = 8
LARGE = 128
PIECE_ROWS = 1000
SEED = 23


def records(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("key"))


def uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def splitters(groups: DataFrame, total: int, ranges: int, samples: int) -> list[int]:
    """At most ``ranges`` - 1 boundaries from a size-weighted sample of the keys."""
    rate = F.col("bytes") * (samples / max(total, 1))
    drawn = groups.where(uniform(F.lit(SEED), "key") < rate).select("key", F.greatest(F.col("bytes").cast("double"), F.lit(total / samples)).alias("w"))
    # the sample is bounded, so one window may hold it
    run = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy())
    bounds = drawn.withColumn("r", F.least(F.floor(run * ranges), F.lit(ranges - 1))).groupBy("r").agg(F.min("key").alias("b")).where("r > 0")
    return sorted(row["b"] for row in bounds.select("b").collect())


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at or below the key: by blocks of boundaries, then inside one block."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    block = F.greatest(below(longs([b[0] for b in blocks])) - 1, F.lit(0))
    return (block * step + below(F.get(F.array(*[longs(b) for b in blocks]), block))).cast("int")


def assign(units: DataFrame, shards: int) -> DataFrame:
    """``units`` (large, unit, bytes) with a shard: large units back and forth by size, the rest in order up to a level."""
    everything = Window.partitionBy()
    big = units.where("large")
    nth = F.row_number().over(Window.orderBy(F.col("bytes").desc(), "unit")) - 1
    turn, at = F.floor(nth / shards), nth % shards
    big = big.withColumn("shard", F.when(turn % 2 == 0, at).otherwise(shards - 1 - at).cast("int"))
    load = big.groupBy("shard").agg(F.sum("bytes").alias("load"))
    all_shards = units.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").withColumn("load", F.coalesce("load", F.lit(0)).cast("double"))
    rest = units.where("not large")
    light = rest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("light"))
    # the level under which the k least loaded shards are filled: the first that the next shard's load does not undercut
    by_load = Window.orderBy("load", "shard")
    s = (all_shards.withColumn("k", F.row_number().over(by_load)).withColumn("under", F.sum("load").over(by_load.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("next", F.lead("load").over(by_load)).withColumn("light", F.lit(light.first()[0])))
    s = s.withColumn("try", (F.col("light") + F.col("under")) / F.col("k"))
    s = s.withColumn("level", F.min(F.when(F.col("next").isNull() | (F.col("try") <= F.col("next")), F.struct("k", "try"))).over(everything)["try"])
    room = s.withColumn("room", F.greatest(F.col("level") - F.col("load"), F.lit(0.0)))
    ends = [row["end"] for row in room.select("shard", F.sum("room").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)).alias("end")).orderBy("shard").collect()]
    order = Window.orderBy("unit")
    middle = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2
    shard = F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda x: x <= F.col("middle"))), F.lit(shards - 1))
    rest = rest.withColumn("middle", middle).withColumn("shard", shard.cast("int")).drop("middle")
    return big.select("unit", "shard", "bytes").union(rest.select("unit", "shard", "bytes"))


def shard_records(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every row of ``docs``."""
    # a number of its own for every row, written, so that rows equal in all columns can be told apart
    recs = Stored(spark, records(docs).withColumn("row", F.monotonically_increasing_id()), "records").df
    groups = stored(spark, recs.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    ranges = shards * ranges_per_shard
    share = max(total / shards, 1.0)
    bounds = splitters(groups, total, ranges, ranges * SAMPLES_PER_RANGE) if total else []
    # at most LARGE * shards groups
    large = (groups.where(F.col("bytes") > share / LARGE)
             .select(F.col("key").alias("__key"), F.when(F.col("bytes") > share, F.ceil(F.col("bytes") * LARGE / share)).otherwise(1).alias("__cuts")))
    placed = recs.withColumn("range", range_of(F.col("key"), bounds)).join(F.broadcast(large), F.col("key") == F.col("__key"), "left")
    placed = stored(spark, placed.withColumn("large", F.col("__cuts").isNotNull()).drop("__key"), "placed")
    # ranges with over twice their share, at most `ranges` of them
    full = (placed.where("not large").groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * total / ranges)
            .select(F.col("range").alias("__range"), F.ceil(F.col("bytes") * ranges / max(total, 1)).alias("__parts")))
    placed = placed.join(F.broadcast(full), F.col("range") == F.col("__range"), "left")
    part = F.when(F.col("large"), F.pmod(F.xxhash64(F.lit(2), "row"), F.col("__cuts"))).otherwise(F.pmod(F.xxhash64(F.lit(3), "key"), F.coalesce("__parts", F.lit(1))))
    unit = F.struct("range", F.when(F.col("large"), F.col("key")).alias("own"), part.alias("part"))
    placed = placed.withColumn("unit", unit).drop("__range", "__parts", "__cuts")
    units = placed.groupBy("large", "unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    units = stored(spark, units, "units")
    where_to = assign(units.select("large", "unit", "bytes"), shards).join(units.select("unit", F.greatest(F.ceil(F.col("rows") / piece_rows), F.lit(1)).alias("pieces")), "unit")
    where_to = stored(spark, where_to.select(F.col("unit").alias("__unit"), "shard", "pieces"), "shards")
    # units are bounded by the ranges, not by the records
    placed = placed.join(F.broadcast(where_to), F.col("unit") == F.col("__unit")).drop("__unit")
    placed = stored(spark, placed.withColumn("turn", F.xxhash64(F.lit(4), "row")).withColumn("piece", F.pmod("turn", F.col("pieces"))), "pieces")
    counts = placed.groupBy("shard", "unit", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("unit", "piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counts = counts.withColumn("before", before).drop("n")
    nth = F.row_number().over(Window.partitionBy("shard", "unit", "piece").orderBy("turn", "row")) - 1
    return (placed.withColumn("nth", nth).join(counts, ["shard", "unit", "piece"])
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + F.col("nth")).alias("slot")))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, **options) -> None:
    """The records as Parquet, one folder a shard; equal rows take one slot each."""
    plan = stored(spark, shard_records(spark, docs, **options).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), "slots")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    rows = docs
    if plan.groupBy("__doc", "__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # the k-th of equal rows, by the rest of their columns, takes the k-th slot
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*cols(docs.columns)))))
        plan = plan.withColumn("__at", F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("__shard", "__slot")))
        same = same & (F.col("__nth") == F.col("__at"))
    rows = rows.join(plan, same)
    (rows.select(*[f"`{c}`" for c in docs.columns], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
