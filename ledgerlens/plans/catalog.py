"""Query registry: every operator of the inventory as a (spark, sf_dir) -> DataFrame
callable, with its DuckDB oracle SQL when the result is exactly reproducible.

Every query reads the driver tables (or what Spark derives from them) in full,
so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import features as FE
from ..sources import fixtures as FX
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.profiles(spark, sf_dir)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.ledger(spark, sf_dir)


def snapshots_live(spark: SparkSession, sf_dir: str, leak_safe: bool = False) -> DataFrame:
    """The feature job's plan: ledger -> windows -> profile join (computed)."""
    return FE.build_snapshots(ledger(spark, sf_dir), profiles(spark, sf_dir), leak_safe=leak_safe)


SNAPSHOT_INPUTS = ["orders", "customer"]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot table as consumers read it: written once by the tasks that make it,
    then read. Its consumers read all months, so its wide rows aren't dealt again by month."""
    from .materialize import materialized
    return materialized(spark, "snapshots", sf_dir, SNAPSHOT_INPUTS, lambda: snapshots_live(spark, sf_dir))


_SNAPSHOT_COLS = ["customer_id", "snapshot_month", *FE.SNAPSHOT_FEATURES, S.LABEL, *FE.PROFILE_COLUMNS]

# ---------------------------------------------------------------------------
# sources, ledger construction
# ---------------------------------------------------------------------------

_PROFILE_COLS = "customer_id, age, employment_status, education_level, monthly_income, city_tier, dependents, residence_type, account_age_months"
_LEDGER_COLS = ("customer_id, month, credit_utilization, late_payment, payment_ratio, outstanding_balance, "
                "default_event, num_transactions, avg_transaction_amount, missed_due_flag")


@query("profiles", O.with_profiles(f"SELECT {_PROFILE_COLS} FROM profiles"))
def q_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query("ledger", O.with_ledger(f"SELECT {_LEDGER_COLS} FROM ledger"))
def q_ledger(spark, sf_dir):
    return ledger(spark, sf_dir)


@query("default_hazard", O.with_ledger("""
SELECT customer_id, month,
  greatest(0.005e0, least(
      0.015e0
    + 0.18e0 * lag(missed_due_flag) OVER (PARTITION BY customer_id ORDER BY month)
    + 0.1e0 * (1e0 - lag(payment_ratio) OVER (PARTITION BY customer_id ORDER BY month))
    + 0.06e0 * least(lag(outstanding_balance) OVER (PARTITION BY customer_id ORDER BY month) / 1e4, 1e0)
    + 0.04e0 * lag(late_payment) OVER (PARTITION BY customer_id ORDER BY month), 0.45e0)) AS hazard,
  default_event
FROM ledger"""))
def q_default_hazard(spark, sf_dir):
    return FX.default_hazard(ledger(spark, sf_dir))


@query("default_rate_by_flag", O.with_ledger("""
SELECT missed_due_flag, count(*)::BIGINT AS n_rows, round(avg(default_event), 9) AS default_rate
FROM ledger GROUP BY missed_due_flag"""))
def q_default_rate_by_flag(spark, sf_dir):
    return (ledger(spark, sf_dir).groupBy("missed_due_flag")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.round(F.avg("default_event"), 9).alias("default_rate")))


@query("distinct_customers", O.with_ledger("SELECT DISTINCT customer_id FROM ledger"))
def q_distinct_customers(spark, sf_dir):
    return ledger(spark, sf_dir).select("customer_id").distinct()


# ---------------------------------------------------------------------------
# snapshot features
# ---------------------------------------------------------------------------

@query("snapshots", O.with_snapshots(f"SELECT {', '.join(_SNAPSHOT_COLS)} FROM snapshots"))
def q_snapshots(spark, sf_dir):
    return snapshots_live(spark, sf_dir)


def _family_query(fam: str):
    cols = ", ".join(["customer_id", "snapshot_month", *FE.FAMILIES[fam]])

    @query(f"feat_{fam}", O.with_snapshots(f"SELECT {cols} FROM snapshots"))
    def q(spark, sf_dir):
        if fam in ("basic", "recency", "risk"):     # windows alone: no profile is needed
            feats = FE.window_features(ledger(spark, sf_dir))
            return FE.feature_family(feats.where(F.col("_rn") > S.LOOKBACK_MONTHS), fam)
        return FE.feature_family(snapshots_live(spark, sf_dir), fam)
    q.__name__ = f"q_feat_{fam}"
    return q


for _fam in FE.FAMILIES:
    _family_query(_fam)


@query("snapshots_leak_safe", O.with_snapshots(
    "SELECT customer_id, snapshot_month, outstanding_to_income_pct, debt_burden_category, risk_score FROM snapshots",
    leak_safe=True))
def q_snapshots_leak_safe(spark, sf_dir):
    return snapshots_live(spark, sf_dir, leak_safe=True).select(
        "customer_id", "snapshot_month", "outstanding_to_income_pct", "debt_burden_category", "risk_score")


@query("risk_bands", O.with_snapshots("""
SELECT CASE WHEN risk_score < 20 THEN 'safe' WHEN risk_score < 50 THEN 'caution'
            WHEN risk_score >= 50 THEN 'high' END AS risk_band,
  count(*)::BIGINT AS n_rows, round(avg(default_next_1m), 9) AS default_rate,
  round(avg(risk_score), 6) AS avg_risk_score
FROM snapshots GROUP BY 1"""))
def q_risk_bands(spark, sf_dir):
    return _round(FE.risk_bands(snapshots_live(spark, sf_dir)), {"default_rate": 9, "avg_risk_score": 6})


@query("dq_snapshot_rules", O.with_snapshots("""
, faulty AS (SELECT * REPLACE (CASE WHEN customer_id % 97 = 0 THEN 4 ELSE missed_due_count_3m END AS missed_due_count_3m,
    CASE WHEN customer_id % 89 = 0 THEN 2 WHEN customer_id % 83 = 0 THEN NULL ELSE default_next_1m END AS default_next_1m,
    CASE WHEN customer_id % 79 = 0 THEN 7 ELSE consecutive_missed_due END AS consecutive_missed_due,
    CASE WHEN customer_id % 73 = 0 THEN -1 ELSE debt_burden_category END AS debt_burden_category) FROM snapshots)
SELECT rule, violations FROM (
  SELECT 'missed_due_count_3m_le_lookback' AS rule, count(*) FILTER (WHERE NOT coalesce(missed_due_count_3m <= 3, false))::BIGINT AS violations FROM faulty
  UNION ALL SELECT 'label_is_binary', count(*) FILTER (WHERE NOT coalesce(default_next_1m IN (0, 1), false))::BIGINT FROM faulty
  UNION ALL SELECT 'streak_le_lookback', count(*) FILTER (WHERE NOT coalesce(consecutive_missed_due <= 3, false))::BIGINT FROM faulty
  UNION ALL SELECT 'active_months_le_lookback', count(*) FILTER (WHERE NOT coalesce(active_months_3m <= 3, false))::BIGINT FROM faulty
  UNION ALL SELECT 'debt_burden_in_0_3', count(*) FILTER (WHERE NOT coalesce(debt_burden_category IN (0, 1, 2, 3), false))::BIGINT FROM faulty)"""))
def q_dq_snapshot_rules(spark, sf_dir):
    """Violations per rule, on snapshots some of which are made faulty by their key (the data is clean)."""
    snap = snapshots(spark, sf_dir)
    hit = lambda n: F.col("customer_id") % n == 0
    return FE.dq_snapshot_rules(snap.withColumns({
        "missed_due_count_3m": F.when(hit(97), F.lit(4)).otherwise(F.col("missed_due_count_3m")),
        S.LABEL: F.when(hit(89), F.lit(2)).when(~hit(83), F.col(S.LABEL)),
        "consecutive_missed_due": F.when(hit(79), F.lit(7)).otherwise(F.col("consecutive_missed_due")),
        "debt_burden_category": F.when(hit(73), F.lit(-1)).otherwise(F.col("debt_burden_category"))}))


@query("snapshot_profile", O.with_snapshots("""
SELECT count(*)::BIGINT AS n_rows, 39::INTEGER AS n_columns,
  round(avg(default_next_1m), 9) AS default_rate, sum(default_next_1m)::BIGINT AS n_defaults
FROM snapshots"""))
def q_snapshot_profile(spark, sf_dir):
    return _round(FE.snapshot_profile(snapshots(spark, sf_dir)), {"default_rate": 9})


@query("feature_quality", O.with_snapshots("""
SELECT round(avg(CASE WHEN consecutive_missed_due > 0 THEN 1 ELSE 0 END), 9) AS streak_rate,
  round(avg(ever_defaulted), 9) AS ever_defaulted_rate,
  round(avg(is_deteriorating), 9) AS deteriorating_rate,
  round(avg(risk_score), 6) AS avg_risk_score,
  round(avg(CASE WHEN outstanding_to_income_pct > 30 THEN 1 ELSE 0 END), 9) AS high_burden_rate
FROM snapshots"""))
def q_feature_quality(spark, sf_dir):
    return _round(FE.feature_quality(snapshots(spark, sf_dir)),
                  {"streak_rate": 9, "ever_defaulted_rate": 9, "deteriorating_rate": 9,
                   "avg_risk_score": 6, "high_burden_rate": 9})


@query("feature_groups", O.with_snapshots(
    "SELECT customer_id, snapshot_month, age, employment_status, education_level, monthly_income, city_tier, "
    "dependents, residence_type, account_age_months, default_next_1m FROM snapshots"))
def q_feature_groups(spark, sf_dir):
    """The static feature group (P3) plus the label (P4) of every snapshot row."""
    return FE.project_group(snapshots_live(spark, sf_dir), [*S.STATIC_FEATURES, S.LABEL], keys=["customer_id", "snapshot_month"])


@query("ledger_duplicates", O.with_ledger(
    ", twice AS (SELECT customer_id, month FROM ledger UNION ALL SELECT customer_id, month FROM ledger WHERE (customer_id + month) % 50 = 0) "
    "SELECT customer_id, month, count(*)::BIGINT AS n_rows FROM twice GROUP BY 1, 2 HAVING count(*) > 1"))
def q_ledger_duplicates(spark, sf_dir):
    """Duplicate (customer_id, month) keys (D16) of the ledger with every fiftieth row twice."""
    led = ledger(spark, sf_dir)
    return FE.duplicate_keys(led.unionByName(led.where((F.col("customer_id") + F.col("month")) % 50 == 0)))


@query("order_faults", """
WITH o AS (SELECT o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
    CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders),
f AS (SELECT 'no customer' AS fault FROM o WHERE o_custkey IS NULL UNION ALL SELECT 'no date' FROM o WHERE o_orderdate IS NULL
  UNION ALL SELECT 'no price' FROM o WHERE o_totalprice IS NULL
  UNION ALL SELECT 'unknown status' FROM o WHERE coalesce(o_orderstatus NOT IN ('F', 'P', 'O'), true))
SELECT fault, count(*)::BIGINT AS n_orders FROM f GROUP BY 1""")
def q_order_faults(spark, sf_dir):
    """Orders that can't be placed or whose status is unknown, on orders some of which are made so by their key."""
    from ..sources.tables import read_table
    hit = lambda n: F.col("o_orderkey") % n == 0
    return FX.order_faults(read_table(spark, sf_dir, "orders").withColumns({
        "o_custkey": F.when(~hit(11), F.col("o_custkey")), "o_orderdate": F.when(~hit(13), F.col("o_orderdate")),
        "o_orderstatus": F.when(hit(17), F.lit("X")).otherwise(F.col("o_orderstatus"))}))


def _far_orders(spark, sf_dir):
    """The orders, those of every 97th key dated a thousand years later."""
    from ..sources.tables import read_table
    date = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").withColumn(
        "o_orderdate", F.when(F.col("o_orderkey") % 97 == 0, date + F.expr("interval 1000 years")).otherwise(date))


@query("order_faults_far", O.with_far_orders("""
SELECT 'far date' AS fault, count(*)::BIGINT AS n_orders FROM placed JOIN cal ON month < lo OR month > hi HAVING count(*) > 0"""))
def q_order_faults_far(spark, sf_dir):
    """Far dates are reported."""
    return FX.order_faults(_far_orders(spark, sf_dir))


@query("ledger_far_orders", O.with_far_orders(f"SELECT {_LEDGER_COLS} FROM ledger"))
def q_ledger_far_orders(spark, sf_dir):
    """The ledger keeps its calendar whatever far dates the orders hold."""
    from ..sources.tables import read_table
    return FX.ledger_from_amounts(FX.ledger_amounts(_far_orders(spark, sf_dir), read_table(spark, sf_dir, "customer")))


@query("idle_spans", O.with_ledger("""
, marked AS (
  SELECT customer_id, month, month - row_number() OVER (PARTITION BY customer_id ORDER BY month) AS island
  FROM ledger WHERE num_transactions = 0)
SELECT customer_id, min(month)::INTEGER AS first_period, max(month)::INTEGER AS last_period
FROM marked GROUP BY customer_id, island""").replace("\n\n,", ","))
def q_idle_spans(spark, sf_dir):
    """Idle spans of every customer, read from the sparse ledger without expanding it."""
    from ..sources.tables import read_table
    return FX.idle_spans(FX.ledger_runs(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")))


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round report columns (sums of doubles differ in the last bits between
    engines that add in different orders)."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# Register the other query families (imported for their side effect).
from . import q_scoring  # noqa: E402,F401
from . import q_eval  # noqa: E402,F401
from . import q_models  # noqa: E402,F401
from . import q_audit  # noqa: E402,F401
from . import q_stream  # noqa: E402,F401
