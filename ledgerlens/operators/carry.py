"""Carry rows: what the features of a customer's next months need of its past - the last
``lookback`` ledger rows, the number of rows, the defaults and the row of the last one, and the unpaid
sum behind the running balance. A stream takes a customer over from them (X3), and a refresh rebuilds
from them on instead of from the whole history (X2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

#: Ledger column of each field of a carried row.
ROW_FIELDS = {"month": "month", "util": "credit_utilization", "late": "late_payment", "ratio": "payment_ratio", "bal": "outstanding_balance",
              "ntx": "num_transactions", "amt": "avg_transaction_amount", "missed": "missed_due_flag"}
ROW = T.StructType([
    T.StructField("month", T.IntegerType()), T.StructField("util", T.DoubleType()),
    T.StructField("late", T.IntegerType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("bal", T.DoubleType()), T.StructField("ntx", T.IntegerType()),
    T.StructField("amt", T.LongType()), T.StructField("missed", T.IntegerType()),
])
CARRY = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("rows", T.ArrayType(ROW)), T.StructField("n_rows", T.LongType()),
    T.StructField("n_defaults", T.LongType()), T.StructField("last_default_rn", T.LongType()),
])
#: Columns of a ledger that continues a carried one: rows, defaults and row of the last default before its first row.
OFFSETS = ["_rn0", "_defaults0", "_last_default0"]


def row_struct() -> Column:
    return F.struct(*[F.col(c).cast(ROW[f].dataType).alias(f) for f, c in ROW_FIELDS.items()])


def carry_rows(ledger: DataFrame, lookback: int = S.LOOKBACK_MONTHS) -> DataFrame:
    """One carry row (``CARRY``) per customer, as of its last month. A ledger with ``OFFSETS`` continues the carry
    rows they come from. One shuffle by customer; a customer keeps ``lookback`` rows."""
    w = Window.partitionBy("customer_id").orderBy("month")
    rn0, defaults0, last0 = (F.col(c) if c in ledger.columns else F.lit(0) for c in OFFSETS)
    ranked = ledger.select("*", F.row_number().over(w).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy("customer_id")).alias("_n"))
    hit = F.col("default_event") == 1
    return ranked.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_at") > F.col("_n") - lookback, row_struct()))).alias("rows"),
        (F.max(rn0) + F.max("_n")).cast("long").alias("n_rows"),
        (F.max(defaults0) + F.count_if(hit)).cast("long").alias("n_defaults"),
        F.coalesce(F.max(F.when(hit, F.col("_at") + rn0)), F.max(last0), F.lit(0)).cast("long").alias("last_default_rn"))


def carried_ledger(carry: DataFrame) -> DataFrame:
    """The carried rows as ledger rows with ``OFFSETS``; their defaults are in the offsets, not in the rows."""
    r = F.col("r")
    return carry.select("customer_id", "n_rows", "n_defaults", "last_default_rn", F.size("rows").alias("k"), F.explode("rows").alias("r")).select(
        "customer_id", *[r[f].alias(c) for f, c in ROW_FIELDS.items()], F.lit(None).cast("int").alias("default_event"),
        (F.col("n_rows") - F.col("k")).alias("_rn0"), F.col("n_defaults").alias("_defaults0"), F.col("last_default_rn").alias("_last_default0"))
