"""Reproducible train/test splits.

Each row gets a uniform ``u`` from md5(key | seed) — identical in every engine
and on every re-execution, so a lost executor recomputes the same split.

Stratified split (M1): within each label, the ``round(fraction * n_label)``
rows with the smallest ``(u, key...)`` are the test set. One row per label, the
last of its test rows, is the cut; being in the test set is then a comparison
with it, a projection without a shuffle. The cut is found without a
per-label sort of all rows: ``u`` is uniform, so a 2^16-bucket histogram per
label (bounded size) locates the bucket where the cut falls; only the rows of
that one bucket (about n / 65536 per label) are ranked, by their keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIST_BITS = 16


def hash_u(keys: list[str], seed: int) -> tuple[Column, Column]:
    """(u in [0,1), 32-bit integer h) from the first 8 hex digits of md5(k1|k2|...|seed)."""
    s = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0), h


def stratified_cuts(df: DataFrame, label: str, keys: list[str], test_fraction: float = 0.2, seed: int = 42) -> list:
    """One row per label: the label, and (u, *keys) of the last row of its test set."""
    u, h = hash_u(keys, seed)
    x = df.select(F.col(label).alias("_l"), u.alias("_u"), F.shiftright(h, 32 - HIST_BITS).alias("_hb"), *keys)
    x = x.withColumn("_l", F.when(F.col("_l").isNull(), F.raise_error(F.lit(f"{label} holds NULLs")).cast(df.schema[label].dataType)).otherwise(F.col("_l")))
    hist = x.groupBy("_l", "_hb").agg(F.count(F.lit(1)).alias("_c"))      # <= 2^16 rows per label
    w = Window.partitionBy("_l").orderBy("_hb")
    hist = hist.select("_l", "_hb", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_c",
                       F.round(F.sum("_c").over(Window.partitionBy("_l")) * F.lit(float(test_fraction))).cast("long").alias("_k"))
    at = hist.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))     # one row per label
    rows = x.join(F.broadcast(at.select("_l", "_hb", "_before", "_k")), ["_l", "_hb"])
    nth = F.row_number().over(Window.partitionBy("_l").orderBy("_u", *keys))
    return rows.withColumn("_nth", F.col("_before") + nth).where("_nth = _k").select("_l", "_u", *keys).collect()


def stratified_split(df: DataFrame, label: str, keys: list[str], test_fraction: float = 0.2,
                     seed: int = 42, col: str = "is_test") -> DataFrame:
    """Add boolean ``is_test``; exactly round(test_fraction * n) rows per label. A NULL label is an error."""
    u, _ = hash_u(keys, seed)
    here = F.struct(u.alias("u"), *keys)
    test = F.lit(False)
    for row in stratified_cuts(df, label, keys, test_fraction, seed):
        cut = F.struct(F.lit(row["_u"]).alias("u"), *[F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys])
        test = F.when(F.col(label) == F.lit(row["_l"]), here <= cut).otherwise(test)
    return df.withColumn(col, test)


def hash_split(df: DataFrame, keys: list[str], test_fraction: float = 0.2, seed: int = 42,
               col: str = "is_test") -> DataFrame:
    """Unstratified split (M2): u < fraction. No shuffle at all."""
    u, _ = hash_u(keys, seed)
    return df.withColumn(col, u < F.lit(float(test_fraction)))


def grouped_split(df: DataFrame, group: str, test_fraction: float = 0.2, seed: int = 42,
                  col: str = "is_test") -> DataFrame:
    """All rows of one customer on the same side (fixes the leak of D5)."""
    u, _ = hash_u([group], seed)
    return df.withColumn(col, u < F.lit(float(test_fraction)))


def time_split(df: DataFrame, time_col: str, cutoff: int, col: str = "is_test") -> DataFrame:
    """Rows at or after ``cutoff`` are the test set."""
    return df.withColumn(col, F.col(time_col) >= F.lit(cutoff))
