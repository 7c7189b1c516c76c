"""Batch twins of the streaming jobs (X1–X4): the event-stream ledger and
snapshots computed over the whole ``events`` table. The streams themselves
are tested in pytest (a stream cannot be collected by a query runner)."""

from __future__ import annotations

from ..sources.tables import read_table
from ..streaming import refresh as R
from . import oracle as O
from .catalog import _LEDGER_COLS, _SNAPSHOT_COLS, profiles, query
from .q_scoring import ROUTER_SELECT, _text, router_sql


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")


@query("events_ledger", f"WITH {O.EVENT_LEDGER_CTES}\nSELECT {_LEDGER_COLS} FROM ledger")
def q_events_ledger(spark, sf_dir):
    return R.event_ledger(_events(spark, sf_dir))


@query("events_snapshots", f"WITH {O.snapshot_ctes(ledger_ctes=O.EVENT_LEDGER_CTES)}\n"
                           f"SELECT {', '.join(_SNAPSHOT_COLS)} FROM snapshots")
def q_events_snapshots(spark, sf_dir):
    return R.event_snapshots(_events(spark, sf_dir), profiles(spark, sf_dir))


@query("events_scored", router_sql(O.snapshot_ctes(ledger_ctes=O.EVENT_LEDGER_CTES)) + ROUTER_SELECT)
def q_events_scored(spark, sf_dir):
    """X4 over the batch twin: all router fields of each event-derived snapshot."""
    s = R.score_stream(R.event_snapshots(_events(spark, sf_dir), profiles(spark, sf_dir)))
    return s.withColumn("risk_warnings", _text("risk_warnings"))
