"""Snapshot features — one row per customer-month with >= 3 earlier months.

All features come from window expressions over ONE window specification
``w = partitionBy(customer_id).orderBy(month)``; the frames used
(last three rows, all earlier rows) derive from it, so the plan has a single
shuffle by ``customer_id`` and a single sort, however many features there are.
Each window partition is one customer's months — bounded by the number of
periods, so a customer with a huge share of the raw orders cannot make a
straggler here (the ledger already collapsed them to one row per period).

The profile join runs *after* the windows, on the same key: when the profile
table is too large to broadcast (Catalyst checks its size against
``spark.sql.autoBroadcastJoinThreshold``), the sort-merge join reuses the
window's hash partitioning and only the profile side is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import account_age_bucket, debt_burden_category, flag, risk_band
from .carry import OFFSETS

SNAPSHOT_FEATURES = [
    "util_avg_3m", "payment_ratio_avg_3m", "max_outstanding_3m", "avg_txn_amt_3m",
    "avg_txn_count_3m", "late_payments_3m", "missed_due_count_3m",
    "missed_due_last_1m", "payment_ratio_last_1m", "outstanding_delta_3m", "bnpl_active_last_1m",
    "consecutive_missed_due", "payment_ratio_min_3m", "worst_util_3m", "ever_defaulted",
    "default_count_history", "months_since_last_default",
    "outstanding_to_income_pct", "income_affordability_score", "debt_burden_category",
    "payment_ratio_trend", "utilization_trend", "outstanding_growth_rate", "is_deteriorating",
    "active_months_3m", "avg_util_when_active", "account_age_bucket", "risk_score",
]

PROFILE_COLUMNS = [f.name for f in S.PROFILE.fields if f.name != "customer_id"]

# Feature families, each also exposed as its own query.
FAMILIES = {
    "basic": ["util_avg_3m", "payment_ratio_avg_3m", "max_outstanding_3m", "avg_txn_amt_3m",
              "avg_txn_count_3m", "late_payments_3m", "missed_due_count_3m"],
    "recency": ["missed_due_last_1m", "payment_ratio_last_1m", "outstanding_delta_3m",
                "bnpl_active_last_1m"],
    "risk": ["consecutive_missed_due", "payment_ratio_min_3m", "worst_util_3m", "ever_defaulted",
             "default_count_history", "months_since_last_default"],
    "afford": ["outstanding_to_income_pct", "income_affordability_score", "debt_burden_category"],
    "trend": ["payment_ratio_trend", "utilization_trend", "outstanding_growth_rate",
              "is_deteriorating"],
    "engage": ["active_months_3m", "avg_util_when_active", "account_age_bucket"],
    "risk_score": ["risk_score"],
}


def _windows(lookback: int):
    w = Window.partitionBy("customer_id").orderBy("month")
    frame = w.rowsBetween(-lookback, -1)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return w, frame, past


def window_features(ledger: DataFrame, lookback: int = S.LOOKBACK_MONTHS,
                    leak_safe: bool = False) -> DataFrame:
    """Window part of the features, before the profile join. Keeps the helper
    columns the row-level features need (``_bal_now``, ``_rn``). A ledger with the offsets
    of ``carry.OFFSETS`` continues one whose earlier rows are not here."""
    w, frame, past = _windows(lookback)
    lag = lambda c, k: F.lag(c, k).over(w)
    missed, ntx, util = F.col("missed_due_flag"), F.col("num_transactions"), F.col("credit_utilization")
    ratio, bal = F.col("payment_ratio"), F.col("outstanding_balance")

    # Stage 1: row number (the next stage's history aggregates refer to it).
    rn0, defaults0, last0 = (F.col(c) if c in ledger.columns else F.lit(None) for c in OFFSETS)
    carried = OFFSETS[0] in ledger.columns
    ranked = ledger.withColumn("_rn", F.row_number().over(w) + rn0.cast("int") if carried else F.row_number().over(w))
    rn = F.col("_rn")
    active = ntx > 0
    last_non_missed = F.max(F.when(~F.coalesce(missed == 1, F.lit(False)), rn)).over(past)
    last_default = F.max(F.when(F.col("default_event") == 1, rn)).over(past)
    defaults_before = F.sum("default_event").over(past)
    if carried:
        last_default = F.coalesce(last_default, F.when(last0 > 0, last0))
        defaults_before = F.coalesce(defaults_before, F.lit(0)) + defaults0

    return ranked.select(
        F.col("customer_id"),
        F.col("month").cast("int").alias("snapshot_month"),
        rn,
        # W1–W7 basic aggregates over the last `lookback` rows
        F.avg(util).over(frame).alias("util_avg_3m"),
        F.avg(ratio).over(frame).alias("payment_ratio_avg_3m"),
        F.max(bal).over(frame).alias("max_outstanding_3m"),
        F.avg("avg_transaction_amount").over(frame).alias("avg_txn_amt_3m"),
        F.avg(ntx).over(frame).alias("avg_txn_count_3m"),
        F.coalesce(F.sum("late_payment").over(frame), F.lit(0)).cast("long").alias("late_payments_3m"),
        F.coalesce(F.sum(missed).over(frame), F.lit(0)).cast("long").alias("missed_due_count_3m"),
        # W8–W11 recency
        lag("missed_due_flag", 1).cast("int").alias("missed_due_last_1m"),
        lag("payment_ratio", 1).alias("payment_ratio_last_1m"),
        (lag("outstanding_balance", 1) - lag("outstanding_balance", lookback)).alias("outstanding_delta_3m"),
        flag(lag("num_transactions", 1) > 0).alias("bnpl_active_last_1m"),
        # W12 streak of missed dues counted back from the newest frame row (NULL stops it)
        F.least(F.lit(lookback), rn - 1 - F.coalesce(last_non_missed, F.lit(0))).cast("int")
        .alias("consecutive_missed_due"),
        # W13–W17 worst case and default history
        F.min(ratio).over(frame).alias("payment_ratio_min_3m"),
        F.max(util).over(frame).alias("worst_util_3m"),
        flag(defaults_before > 0).alias("ever_defaulted"),
        F.coalesce(defaults_before, F.lit(0)).cast("long").alias("default_count_history"),
        F.coalesce(rn - 1 - last_default, F.lit(0)).cast("long").alias("months_since_last_default"),
        # W21–W22 trends (last minus first of the frame)
        (lag("payment_ratio", 1) - lag("payment_ratio", lookback)).alias("payment_ratio_trend"),
        (lag("credit_utilization", 1) - lag("credit_utilization", lookback)).alias("utilization_trend"),
        lag("outstanding_balance", lookback).alias("_bal_first"),
        # W25–W26 engagement
        F.coalesce(F.sum(active.cast("int")).over(frame), F.lit(0)).cast("int").alias("active_months_3m"),
        F.when(F.max(active).over(frame), F.avg(F.when(active, util)).over(frame))
        .otherwise(F.lit(0.0)).alias("avg_util_when_active"),
        # inputs of the row-level features
        (lag("outstanding_balance", 1) if leak_safe else bal).alias("_bal_now"),
        F.col("default_event").cast("int").alias(S.LABEL),
    )


def build_snapshots(ledger: DataFrame, profiles: DataFrame, lookback: int = S.LOOKBACK_MONTHS,
                    leak_safe: bool = False) -> DataFrame:
    """The snapshot table (A3): ids, 28 features, label, 8 profile columns.

    ``leak_safe=True`` divides the *previous* month's balance by income for
    ``outstanding_to_income_pct`` (and hence ``debt_burden_category`` and
    ``risk_score``); the default reproduces the current-month version.
    """
    feats = window_features(ledger, lookback, leak_safe).where(F.col("_rn") > lookback)
    return finish_snapshots(feats, profiles)


def finish_snapshots(feats: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile join + row-level features on top of the window part (shared by
    the batch job and the stateful stream)."""
    prof = profiles.select("customer_id", *PROFILE_COLUMNS).withColumn("_matched", F.lit(True))
    joined = feats.join(prof, "customer_id", "left")

    matched = F.col("_matched").isNotNull()
    # A missing profile means income 0 / account age 0 for the features; a matched
    # profile with a NULL income keeps NULL (the reference's NaN).
    income = F.when(matched, F.col("monthly_income")).otherwise(F.lit(0))
    acct_age = F.when(matched, F.col("account_age_months")).otherwise(F.lit(0))
    pct = F.when(income == 0, F.lit(100.0)).otherwise(F.col("_bal_now") * F.lit(100.0) / income)
    afford_div = F.col("max_outstanding_3m") + F.lit(1.0)
    afford = F.when(afford_div == 0, F.lit(0.0)).otherwise(income / afford_div)
    growth_div = F.col("_bal_first") + F.lit(1.0)
    growth = F.when(growth_div == 0, F.lit(0.0)).otherwise(F.col("outstanding_delta_3m") / growth_div)
    deteriorating = flag((F.col("payment_ratio_trend") < 0) & (F.col("utilization_trend") > 0))

    staged = joined.select(
        "*",
        pct.alias("outstanding_to_income_pct"),
        afford.alias("income_affordability_score"),
        debt_burden_category(pct).cast("int").alias("debt_burden_category"),
        growth.alias("outstanding_growth_rate"),
        deteriorating.alias("is_deteriorating"),
        account_age_bucket(acct_age).cast("int").alias("account_age_bucket"),
    )
    staged = staged.withColumn("risk_score", risk_score_expr())
    return staged.select("customer_id", "snapshot_month", *SNAPSHOT_FEATURES, S.LABEL, *PROFILE_COLUMNS)


def risk_score_expr() -> Column:
    """Composite 0–100 risk score, capped at 100, no floor (W28). A NULL debt
    ratio gives NULL (``least`` would otherwise skip it)."""
    pct = F.col("outstanding_to_income_pct")
    raw = (F.col("missed_due_last_1m") * 25
           + F.col("consecutive_missed_due") * 15
           + (F.lit(1.0) - F.col("payment_ratio_min_3m")) * F.lit(20.0)
           + F.least(pct / F.lit(100.0), F.lit(1.0)) * F.lit(15.0)
           + F.col("is_deteriorating") * 10
           + flag(F.col("payment_ratio_avg_3m") < F.lit(0.7)) * 10
           + F.col("ever_defaulted") * 5)
    return F.when(pct.isNull(), F.lit(None).cast("double")).otherwise(F.least(raw, F.lit(100.0)))


def feature_family(snapshots: DataFrame, family: str) -> DataFrame:
    return snapshots.select("customer_id", "snapshot_month", *FAMILIES[family])


# ---------------------------------------------------------------------------
# Checks and reports on the snapshot table
# ---------------------------------------------------------------------------

DQ_RULES = {
    "missed_due_count_3m_le_lookback": lambda n: F.col("missed_due_count_3m") <= n,
    "label_is_binary": lambda n: F.col(S.LABEL).isin(0, 1),
    "streak_le_lookback": lambda n: F.col("consecutive_missed_due") <= n,
    "active_months_le_lookback": lambda n: F.col("active_months_3m") <= n,
    "debt_burden_in_0_3": lambda n: F.col("debt_burden_category").isin(0, 1, 2, 3),
}


def dq_snapshot_rules(snapshots: DataFrame, lookback: int = S.LOOKBACK_MONTHS) -> DataFrame:
    """One row per rule with the number of violating rows (P6). An empty
    table passes. Computed in a single aggregate pass."""
    aggs = [F.sum(flag(~F.coalesce(rule(lookback), F.lit(False)))).cast("long").alias(name)
            for name, rule in DQ_RULES.items()]
    one = snapshots.agg(*aggs)
    stack = ", ".join(f"'{n}', {n}" for n in DQ_RULES)
    return one.selectExpr(f"stack({len(DQ_RULES)}, {stack}) as (rule, violations)").select(
        "rule", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def assert_snapshot_rules(snapshots: DataFrame, lookback: int = S.LOOKBACK_MONTHS) -> None:
    bad = [r for r in dq_snapshot_rules(snapshots, lookback).collect() if r["violations"] > 0]
    if bad:
        raise ValueError("snapshot data-quality rules failed: "
                         + ", ".join(f"{r['rule']}={r['violations']}" for r in bad))


def snapshot_profile(snapshots: DataFrame) -> DataFrame:
    """Rows, columns, default rate, defaults (A1)."""
    return snapshots.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.lit(len(snapshots.columns)).cast("int").alias("n_columns"),
        F.avg(S.LABEL).alias("default_rate"),
        F.sum(S.LABEL).cast("long").alias("n_defaults"),
    )


def feature_quality(snapshots: DataFrame) -> DataFrame:
    """Feature quality report (A2) in one pass."""
    return snapshots.agg(
        F.avg(flag(F.col("consecutive_missed_due") > 0)).alias("streak_rate"),
        F.avg("ever_defaulted").alias("ever_defaulted_rate"),
        F.avg("is_deteriorating").alias("deteriorating_rate"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.avg(flag(F.col("outstanding_to_income_pct") > 30)).alias("high_burden_rate"),
    )


def risk_bands(snapshots: DataFrame) -> DataFrame:
    """Rows and default rate per risk band of the 0–100 score."""
    return (snapshots.groupBy(risk_band("risk_score").alias("risk_band"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.avg(S.LABEL).alias("default_rate"),
                 F.avg("risk_score").alias("avg_risk_score")))


def project_group(df: DataFrame, group: list[str], keys: list[str] | None = None,
                  strict: bool = False) -> DataFrame:
    """Project a named feature group (P3): absent names are skipped silently,
    or raise when ``strict`` (the evaluation program's behaviour)."""
    missing = [c for c in group if c not in df.columns]
    if strict and missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*(keys or []), *[c for c in group if c in df.columns])


def duplicate_keys(ledger: DataFrame, keys: tuple[str, ...] = ("customer_id", "month")) -> DataFrame:
    """Ledger keys that occur more than once (D16): with duplicates the row
    order inside a customer is undefined, so they are quarantined, not scored."""
    return (ledger.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
            .where(F.col("n_rows") > 1))


def quarantine_duplicates(ledger: DataFrame, keys: tuple[str, ...] = ("customer_id", "month")):
    """(clean ledger, quarantined rows): a semi / anti join against the
    duplicate keys (an aggregate, so a hot key is one row before the join)."""
    dups = duplicate_keys(ledger, keys).select(*keys)
    return ledger.join(dups, list(keys), "left_anti"), ledger.join(dups, list(keys), "left_semi")
