"""Per-customer features on a ledger stream that takes over from a batch.

``transformWithStateInPandas`` keeps each customer's last rows in a list state and its counters in a value state. The
initial state is the batch's carry table (``operators.carry``), so the first new month of a customer continues the
batch's history. A timer evicts customers without new rows for ``idle_ms``: their carry row goes to the output,
for the next handover, and only a mark stays. What arrives for an evicted customer goes to the output as it is, for the
batch refresh; so does a month that is not after the customer's last one. State is bounded by ``lookback`` rows and
four numbers per active customer, one flag per evicted one.

Output kinds: ``features`` (window part of a snapshot), ``late``, ``evicted`` (carry columns), ``returned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..operators.carry import CARRY, ROW, ROW_FIELDS
from ..operators.features import window_features
from .state import _features, _ok

COUNTERS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_rows", "n_defaults", "last_default_rn")])
EVICTED = T.StructType([T.StructField("evicted", T.BooleanType())])
KIND = "kind"


def output_schema(spark: SparkSession) -> T.StructType:
    feats = list(window_features(spark.createDataFrame([], S.LEDGER)).schema.fields)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in (T.StructField(KIND, T.StringType()), *feats, *CARRY.fields[1:])])


class CustomerState(StatefulProcessor):
    def __init__(self, columns: list[str], whole: list[str], lookback: int, idle_ms: int | None):
        self.columns, self.whole, self.lookback, self.idle_ms = columns, whole, lookback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)
        self.counters = handle.getValueState("counters", COUNTERS)
        self.gone = handle.getValueState("evicted", EVICTED)

    def _keep(self, rows: list[tuple], counters: tuple) -> None:
        self.rows.put(rows)
        self.counters.update(counters)

    def _table(self, out: list[dict]) -> pd.DataFrame:
        # whole numbers stay whole beside NULLs, and an absent list is None
        table = pd.DataFrame(out, columns=self.columns).astype({c: "Int64" for c in self.whole})
        return table.assign(rows=pd.Series([r.get("rows") for r in out], dtype=object, index=table.index))

    def _await(self, timers) -> None:
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        rows = [tuple(x[f.name] if isinstance(x, dict) else getattr(x, f.name) for f in ROW.fields) for x in r["rows"]]
        self._keep(rows, (int(r["n_rows"]), int(r["n_defaults"]), int(r["last_default_rn"])))
        self._await(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cid, out = int(key[0]), []
        new = pd.concat(list(rows)).sort_values("month")
        if self.gone.exists():
            out = [{KIND: "returned", "customer_id": cid, "snapshot_month": int(m)} for m in new["month"]]
            yield self._table(out)
            return
        names = [f.name for f in ROW.fields]
        rows = [dict(zip(names, r)) for r in self.rows.get()] if self.rows.exists() else []
        n_rows, n_def, last_def = (int(v) for v in self.counters.get()) if self.counters.exists() else (0, 0, 0)
        for cur in new.to_dict("records"):
            month = int(cur["month"])
            if rows and month <= rows[-1]["month"]:
                out.append({KIND: "late", "customer_id": cid, "snapshot_month": month})
                continue
            rn = n_rows + 1
            if rn > self.lookback:
                out.append(_features(cid, cur, rows[-self.lookback:], rn, n_def, last_def, self.lookback) | {KIND: "features"})
            if _ok(cur["default_event"]) and int(cur["default_event"]) == 1:
                n_def, last_def = n_def + 1, rn
            rows = [*rows, {f: cur[c] for f, c in ROW_FIELDS.items()}][-self.lookback:]
            n_rows = rn
        self._keep([_typed(r) for r in rows], (n_rows, n_def, last_def))
        self._await(timerValues)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [dict(zip([f.name for f in ROW.fields], r)) for r in self.rows.get()]
        n_rows, n_def, last_def = self.counters.get()
        self.rows.clear()
        self.counters.clear()
        self.gone.update((True,))
        yield self._table([{KIND: "evicted", "customer_id": int(key[0]), "rows": rows, "n_rows": n_rows, "n_defaults": n_def, "last_default_rn": last_def}])

    def close(self) -> None:
        pass


def _typed(row: dict) -> tuple:
    """A carried row with its fields' Python types."""
    kind = {"integer": int, "long": int, "double": float}
    return tuple(kind[f.dataType.typeName()](row[f.name]) if _ok(row[f.name]) else None for f in ROW.fields)


def continued_features(spark: SparkSession, ledger_stream: DataFrame, carry: DataFrame | None = None,
                       lookback: int = S.LOOKBACK_MONTHS, idle_ms: int | None = None) -> DataFrame:
    """The output rows (see above) of a ledger stream, from the batch's carry table on if one is given. The session's state store
    must be RocksDB (``use_rocksdb``)."""
    schema = output_schema(spark)
    whole = [f.name for f in schema.fields if f.dataType.typeName() in ("integer", "long")]
    first = carry.select(*[f.name for f in CARRY.fields]).groupBy("customer_id") if carry is not None else None
    return ledger_stream.groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=CustomerState(schema.fieldNames(), whole, lookback, idle_ms), outputStructType=schema,
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime", initialState=first)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def features_of(out: DataFrame) -> DataFrame:
    return out.where(F.col(KIND) == "features").drop(KIND, *[f.name for f in CARRY.fields[1:]])


def evicted_carry(out: DataFrame) -> DataFrame:
    return out.where(F.col(KIND) == "evicted").select(*[f.name for f in CARRY.fields])


def side_rows(out: DataFrame) -> DataFrame:
    """(kind, customer_id, month) of late rows and of rows of evicted customers."""
    return out.where(F.col(KIND).isin("late", "returned")).select(KIND, "customer_id", F.col("snapshot_month").alias("month"))
