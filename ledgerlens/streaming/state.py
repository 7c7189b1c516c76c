"""Per-customer running state over a ledger stream.

``applyInPandasWithState`` keeps, per customer, the last ``lookback`` ledger
rows plus three counters (rows seen, defaults seen, row number of the last
default) — O(lookback) state however long the history — and emits the window
part of the snapshot features for every new month with at least
``lookback`` earlier rows. The profile join and the row-level features then
run as ordinary Column expressions (``finish_snapshots``), so the stream and
the batch job share them. A month that is not after the customer's last
month (late or duplicate) is not applied to the state; it is emitted with
``late = true`` as a side output for quarantine.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S
from ..operators.features import window_features

STATE = T.StructType([
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("month", T.IntegerType()), T.StructField("util", T.DoubleType()),
        T.StructField("late", T.IntegerType()), T.StructField("ratio", T.DoubleType()),
        T.StructField("bal", T.DoubleType()), T.StructField("ntx", T.IntegerType()),
        T.StructField("amt", T.LongType()), T.StructField("missed", T.IntegerType()),
    ]))),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_defaults", T.LongType()),
    T.StructField("last_default_rn", T.LongType()),
])


def output_schema(spark: SparkSession) -> T.StructType:
    empty = spark.createDataFrame([], S.LEDGER)
    fields = list(window_features(empty).schema.fields)
    return T.StructType(fields + [T.StructField("late", T.BooleanType())])


def _ok(v) -> bool:
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def _avg(vals):
    xs = [float(v) for v in vals if _ok(v)]
    if not xs:
        return None
    s = 0.0
    for x in xs:
        s += x
    return s / len(xs)


def _sum(vals):
    xs = [int(v) for v in vals if _ok(v)]
    return sum(xs) if xs else 0


def _max(vals):
    xs = [v for v in vals if _ok(v)]
    return max(xs) if xs else None


def _min(vals):
    xs = [v for v in vals if _ok(v)]
    return min(xs) if xs else None


def _diff(a, b):
    return a - b if _ok(a) and _ok(b) else None


def _features(cid, cur, frame, rn, n_def, last_def_rn, lookback):
    """Window part of one snapshot row from the state (same rules as the batch)."""
    last, first = frame[-1], frame[0]
    streak = 0
    for r in reversed(frame):
        if r["missed"] == 1:
            streak += 1
        else:
            break
    active = [r for r in frame if _ok(r["ntx"]) and r["ntx"] > 0]
    return {
        "customer_id": cid, "snapshot_month": int(cur["month"]), "_rn": rn,
        "util_avg_3m": _avg([r["util"] for r in frame]),
        "payment_ratio_avg_3m": _avg([r["ratio"] for r in frame]),
        "max_outstanding_3m": _max([r["bal"] for r in frame]),
        "avg_txn_amt_3m": _avg([r["amt"] for r in frame]),
        "avg_txn_count_3m": _avg([r["ntx"] for r in frame]),
        "late_payments_3m": _sum([r["late"] for r in frame]),
        "missed_due_count_3m": _sum([r["missed"] for r in frame]),
        "missed_due_last_1m": last["missed"],
        "payment_ratio_last_1m": last["ratio"],
        "outstanding_delta_3m": _diff(last["bal"], first["bal"]),
        "bnpl_active_last_1m": int(_ok(last["ntx"]) and last["ntx"] > 0),
        "consecutive_missed_due": min(streak, lookback),
        "payment_ratio_min_3m": _min([r["ratio"] for r in frame]),
        "worst_util_3m": _max([r["util"] for r in frame]),
        "ever_defaulted": int(n_def > 0),
        "default_count_history": n_def,
        "months_since_last_default": (rn - 1 - last_def_rn) if last_def_rn else 0,
        "payment_ratio_trend": _diff(last["ratio"], first["ratio"]),
        "utilization_trend": _diff(last["util"], first["util"]),
        "_bal_first": first["bal"],
        "active_months_3m": len(active),
        "avg_util_when_active": _avg([r["util"] for r in active]) if active else 0.0,
        "_bal_now": cur["outstanding_balance"],
        S.LABEL: cur["default_event"],
        "late": False,
    }


def make_state_fn(columns: list[str], lookback: int = S.LOOKBACK_MONTHS):
    def fn(key, pdfs, state):
        cid = int(key[0])
        if state.exists:
            rows, n_rows, n_def, last_def = state.get
            rows = [dict(r.asDict()) if hasattr(r, "asDict") else dict(r) for r in (rows or [])]
        else:
            rows, n_rows, n_def, last_def = [], 0, 0, 0
        out = []
        new = pd.concat(list(pdfs)).sort_values("month")
        last_month = rows[-1]["month"] if rows else None
        for cur in new.to_dict("records"):
            m = int(cur["month"])
            if last_month is not None and m <= last_month:
                out.append({"customer_id": cid, "snapshot_month": m, "late": True})
                continue
            rn = n_rows + 1
            if rn > lookback:
                out.append(_features(cid, cur, rows[-lookback:], rn, n_def, last_def, lookback))
            d = cur["default_event"]
            if _ok(d) and int(d) == 1:
                n_def += 1
                last_def = rn
            rows.append({"month": m, "util": cur["credit_utilization"], "late": cur["late_payment"],
                         "ratio": cur["payment_ratio"], "bal": cur["outstanding_balance"],
                         "ntx": cur["num_transactions"], "amt": cur["avg_transaction_amount"],
                         "missed": cur["missed_due_flag"]})
            rows = rows[-lookback:]
            n_rows = rn
            last_month = m
        state.update((rows, n_rows, n_def, last_def))
        if out:
            yield pd.DataFrame(out, columns=columns)
    return fn


def stateful_window_features(spark: SparkSession, ledger_stream: DataFrame,
                             lookback: int = S.LOOKBACK_MONTHS) -> DataFrame:
    """Window part of the snapshot features, per new ledger month (+ ``late``)."""
    schema = output_schema(spark)
    out = ledger_stream.groupBy("customer_id").applyInPandasWithState(
        make_state_fn(schema.fieldNames(), lookback), schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return out


def split_late(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(on-time window features, late rows) of ``stateful_window_features``."""
    return features.where(~F.col("late")).drop("late"), features.where(F.col("late")).select(
        "customer_id", "snapshot_month")
