"""Schemas, feature groups and the fixed policy values.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(names, thresholds, defaults, label texts); it is stated once here, in natural
order, and every operator reads it from this module.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

PROFILE = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("employment_status", T.StringType()),
    T.StructField("education_level", T.StringType()),
    T.StructField("monthly_income", T.LongType()),
    T.StructField("city_tier", T.StringType()),
    T.StructField("dependents", T.IntegerType()),
    T.StructField("residence_type", T.StringType()),
    T.StructField("account_age_months", T.IntegerType()),
])

LEDGER = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("credit_utilization", T.DoubleType()),
    T.StructField("late_payment", T.IntegerType()),
    T.StructField("payment_ratio", T.DoubleType()),
    T.StructField("outstanding_balance", T.DoubleType()),
    T.StructField("default_event", T.IntegerType()),
    T.StructField("num_transactions", T.IntegerType()),
    T.StructField("avg_transaction_amount", T.LongType()),
    T.StructField("missed_due_flag", T.IntegerType()),
])


def scoring_input_schema() -> T.StructType:
    """Batch of points to score (S4): static profile fields + behavioural
    features (types as the snapshot table), all nullable."""
    from .operators.features import SNAPSHOT_FEATURES  # local import: features imports schemas
    ints = {"missed_due_last_1m", "bnpl_active_last_1m", "consecutive_missed_due", "ever_defaulted",
            "debt_burden_category", "is_deteriorating", "active_months_3m", "account_age_bucket"}
    longs = {"late_payments_3m", "missed_due_count_3m", "default_count_history", "months_since_last_default"}
    fields = [f for f in PROFILE.fields if f.name != "customer_id"]
    for c in SNAPSHOT_FEATURES:
        t = T.IntegerType() if c in ints else T.LongType() if c in longs else T.DoubleType()
        fields.append(T.StructField(c, t))
    fields.append(T.StructField("snapshot_month", T.IntegerType()))
    return T.StructType(fields)


# ---------------------------------------------------------------------------
# FIXED VALUES — feature groups (names and order as the models expect them)
# ---------------------------------------------------------------------------

LOOKBACK_MONTHS = 3
LABEL = "default_next_1m"

STATIC_FEATURES = [
    "age", "employment_status", "education_level", "monthly_income",
    "city_tier", "dependents", "residence_type", "account_age_months",
]

BEHAVIORAL_FEATURES = [
    "util_avg_3m", "payment_ratio_avg_3m", "max_outstanding_3m",
    "avg_txn_amt_3m", "avg_txn_count_3m", "late_payments_3m",
    "missed_due_count_3m", "missed_due_last_1m", "payment_ratio_last_1m",
    "outstanding_delta_3m", "bnpl_active_last_1m",
    "consecutive_missed_due", "payment_ratio_min_3m", "worst_util_3m",
    "ever_defaulted", "default_count_history", "months_since_last_default",
    "outstanding_to_income_pct", "income_affordability_score", "debt_burden_category",
    "payment_ratio_trend", "utilization_trend", "outstanding_growth_rate",
    "is_deteriorating", "active_months_3m", "avg_util_when_active",
    "account_age_bucket", "risk_score", "snapshot_month",
]

ALL_FEATURES = STATIC_FEATURES + BEHAVIORAL_FEATURES

CATEGORICAL_STATIC = ["employment_status", "education_level", "city_tier", "residence_type"]

# History columns wiped by the cold-start what-if scenario.
HISTORY_COLUMNS = [
    "util_avg_3m", "payment_ratio_avg_3m", "max_outstanding_3m",
    "avg_txn_amt_3m", "avg_txn_count_3m", "late_payments_3m",
    "missed_due_count_3m", "missed_due_last_1m", "payment_ratio_last_1m",
    "outstanding_delta_3m", "bnpl_active_last_1m",
]

# What-if overrides of one base row.
HIGH_RISK_OVERRIDE = {
    "missed_due_last_1m": 1, "payment_ratio_last_1m": 0.3, "missed_due_count_3m": 3,
    "late_payments_3m": 3, "util_avg_3m": 0.9, "outstanding_delta_3m": 8000,
    "bnpl_active_last_1m": 1,
}
LOW_RISK_OVERRIDE = {
    "missed_due_last_1m": 0, "payment_ratio_last_1m": 1.0, "missed_due_count_3m": 0,
    "late_payments_3m": 0, "util_avg_3m": 0.2, "outstanding_delta_3m": 0,
    "bnpl_active_last_1m": 1,
}

# Columns that get log1p in the notebook pipeline.
LOG_COLUMNS = ["monthly_income", "avg_txn_amt_3m", "max_outstanding_3m", "outstanding_delta_3m"]

# Discrete and continuous columns of the exploratory report.
DISCRETE_COLUMNS = [
    "snapshot_month", "missed_due_count_3m", "late_payments_3m", "missed_due_last_1m",
    "bnpl_active_last_1m", "default_next_1m", "dependents",
]
# Plain numeric columns of the notebook pipeline.
NOTEBOOK_NUMERIC = [
    "age", "account_age_months", "util_avg_3m", "payment_ratio_avg_3m", "avg_txn_count_3m",
    "missed_due_count_3m", "late_payments_3m", "missed_due_last_1m", "bnpl_active_last_1m", "dependents",
]
CONTINUOUS_COLUMNS = [
    "age", "account_age_months", "util_avg_3m", "payment_ratio_avg_3m", "max_outstanding_3m",
    "avg_txn_count_3m", "avg_txn_amt_3m", "outstanding_delta_3m", "monthly_income",
]

# Fixed-edge histograms of the exploratory report (column -> edges).
HISTOGRAM_EDGES = {
    "age": [20, 30, 40, 50, 60, 70],
    "account_age_months": [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120],
    "util_avg_3m": [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1],
    "payment_ratio_avg_3m": [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1],
    "outstanding_delta_3m": [0, 1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000],
    "avg_txn_count_3m": [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5],
    "monthly_income": [0, 15000, 30000, 45000, 60000, 75000, 90000, 105000, 120000, 135000, 150000],
}

# ---------------------------------------------------------------------------
# FIXED VALUES — neutral behavioural defaults used when scoring without history
# ---------------------------------------------------------------------------

NEUTRAL_DEFAULTS = {
    "snapshot_month": 6, "util_avg_3m": 0.0, "payment_ratio_avg_3m": 1.0,
    "max_outstanding_3m": 0.0, "avg_txn_amt_3m": 0.0, "avg_txn_count_3m": 0.0,
    "late_payments_3m": 0, "missed_due_count_3m": 0, "missed_due_last_1m": 0,
    "payment_ratio_last_1m": 1.0, "outstanding_delta_3m": 0.0,
    "bnpl_active_last_1m": 0, "consecutive_missed_due": 0,
    "payment_ratio_min_3m": 1.0, "worst_util_3m": 0.0, "ever_defaulted": 0,
    "default_count_history": 0, "months_since_last_default": 0,
    "outstanding_to_income_pct": 0.0, "income_affordability_score": 1.0,
    "debt_burden_category": 0, "payment_ratio_trend": 0.0,
    "utilization_trend": 0.0, "outstanding_growth_rate": 0.0,
    "is_deteriorating": 0, "active_months_3m": 0, "avg_util_when_active": 0.0,
    "account_age_bucket": 0, "risk_score": 0.0,
}
# The audit variant differs in one default.
AUDIT_SNAPSHOT_MONTH_DEFAULT = 4

# ---------------------------------------------------------------------------
# FIXED VALUES — scoring policy
# ---------------------------------------------------------------------------

SCORE_MIN, SCORE_MAX = 300, 900
SCORE_SPAN = 600  # score = 900 - 600 * p
DECISIONS = ["Approve", "Approve_Low_Limit", "Conditional", "Reject"]
DECISION_CUTS = [(750, "Approve"), (650, "Approve_Low_Limit"), (550, "Conditional")]  # else Reject

TIER_1_MAX_MONTHS = 3
TIER_2_MAX_MONTHS = 6
TIER_DESCRIPTIONS = {1: "New Customer (Cold Start)", 2: "Building History", 3: "Established Customer"}
MAX_LIMIT_TIER_1 = 10000
MAX_LIMIT_TIER_2 = 25000
MAX_LIMIT_TIER_3 = 100000

FALLBACK_PROBABILITY = 0.2
BLEND_COLD_WEIGHT = 0.4
BLEND_FULL_WEIGHT = 0.6

RISKY_EMPLOYMENT = ["Daily Wage", "Unemployed"]
WARN_LOW_INCOME = "Low income - maximum limit capped"
WARN_DEPENDENCY = "High dependency ratio - limit reduced"
WARN_YOUNG = "Young borrower - limit capped"
WARN_SENIOR = "Senior borrower - limit adjusted to income"

MODEL_USED_COLD = "cold_start_model + guardrails"
MODEL_USED_FULL = "full_model"
MODEL_USED_BLEND = "blended (40% cold_start + 60% full)"
NOTE_COLD = "Cold start model has limited predictive power. Conservative limits applied."
NOTE_FULL = "Full model with behavioral features provides reliable predictions."
RECOMMEND_TIER_1 = ("New customer - monitor closely. Consider increasing limit after "
                    "3 months of good payment history.")
RECOMMEND_TIER_2 = "Building credit history. Good payment behavior will unlock higher limits."
RECOMMEND_TIER_3 = "Established customer - standard credit policies apply."

# Rule scorecard
SCORECARD_BASE = 600
SCORECARD_INCOME = [(100000, 100, "Excellent"), (60000, 70, "Good"), (35000, 40, "Fair"),
                    (20000, 10, "Low")]  # else -50, "Very Low"
SCORECARD_INCOME_ELSE = (-50, "Very Low")
SCORECARD_EMPLOYMENT = {"Salaried": 50, "Business": 30, "Self-Employed": 20, "Retired": 10,
                        "Daily Wage": -30, "Unknown": -20}
SCORECARD_EMPLOYMENT_ELSE = -20
SCORECARD_EDUCATION = {"Postgraduate": 30, "Graduate": 20, "High School": 10, "Secondary": 5,
                       "Primary": 0, "No Formal Education": -20, "Unknown": -10}
SCORECARD_EDUCATION_ELSE = -10
SCORECARD_RESIDENCE = {"Owned": 30, "Rented": 10}
SCORECARD_RESIDENCE_ELSE = -10
SCORECARD_CITY = {"Tier-1": 20, "Tier-2": 10}
SCORECARD_CITY_ELSE = 0
SCORECARD_DEPENDENT_PENALTY = 10

# Evaluation
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5]
AUC_GATE = 0.70
RECALL_GATE = 0.70

# Allowed ranges of the request fields: (name, lowest, highest)
STATIC_RULES = [
    ("age", 18, 100), ("employment_status", None, None), ("education_level", None, None),
    ("monthly_income", 0, None), ("city_tier", None, None), ("dependents", 0, None),
    ("residence_type", None, None), ("account_age_months", 0, None),
]

BEHAVIOURAL_RULES = [
    ("util_avg_3m", None, None), ("payment_ratio_avg_3m", None, None),
    ("max_outstanding_3m", None, None), ("avg_txn_amt_3m", None, None),
    ("avg_txn_count_3m", None, None), ("late_payments_3m", 0, None),
    ("missed_due_count_3m", 0, None), ("missed_due_last_1m", 0, 1),
    ("payment_ratio_last_1m", None, None), ("outstanding_delta_3m", None, None),
    ("bnpl_active_last_1m", 0, 1), ("consecutive_missed_due", 0, None),
    ("payment_ratio_min_3m", None, None), ("worst_util_3m", None, None),
    ("ever_defaulted", 0, 1), ("default_count_history", 0, None),
    ("months_since_last_default", 0, None), ("outstanding_to_income_pct", None, None),
    ("income_affordability_score", None, None), ("debt_burden_category", 0, 3),
    ("payment_ratio_trend", None, None), ("utilization_trend", None, None),
    ("outstanding_growth_rate", None, None), ("is_deteriorating", 0, 1),
    ("active_months_3m", 0, 3), ("avg_util_when_active", None, None),
    ("account_age_bucket", 0, 2), ("risk_score", 0, 100), ("snapshot_month", None, None),
]
