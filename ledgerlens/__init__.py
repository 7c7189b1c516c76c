"""ledgerlens — Spark-native credit-behaviour features, scoring and evaluation.

Layers:
  sources/    read and write tables (profiles, monthly ledger, snapshots, models)
  functions/  Column-returning helpers (score mapping, policy rules)
  operators/  DataFrame operators (window features, stats, metrics, audits, MLlib)
  plans/      jobs and the query registry used by ``__spark_entry__``
  streaming/  Structured Streaming refresh and per-customer state
"""

__version__ = "0.1.0"
