"""Scoring-policy queries (F1–F22, P7, P10, P11) on surrogate probabilities.

Every snapshot row is a full scoring request and every profile row a
cold-start request, so these run over the whole derived tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import policy as P
from . import oracle as O
from .catalog import profiles, query, snapshots


def _text(c):
    """array<string> -> '; '-joined text for comparison; NULL stays NULL."""
    return F.when(F.col(c).isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws("; ", c))


# ------------------------------- SQL helpers -------------------------------

def sql_p2s(p: str) -> str:
    return f"trunc(greatest(300e0, least(900e0, 900e0 - ({p}) * 600e0)))::INTEGER"


def sql_decision(s: str) -> str:
    return (f"(CASE WHEN {s} >= 750 THEN 'Approve' WHEN {s} >= 650 THEN 'Approve_Low_Limit' "
            f"WHEN {s} >= 550 THEN 'Conditional' ELSE 'Reject' END)")


SQL_SCORECARD = """least(900, greatest(300, 600
  + CASE WHEN monthly_income >= 100000 THEN 100 WHEN monthly_income >= 60000 THEN 70
         WHEN monthly_income >= 35000 THEN 40 WHEN monthly_income >= 20000 THEN 10 ELSE -50 END
  + CASE coalesce(employment_status, 'Unknown') WHEN 'Salaried' THEN 50 WHEN 'Business' THEN 30
         WHEN 'Self-Employed' THEN 20 WHEN 'Retired' THEN 10 WHEN 'Daily Wage' THEN -30 ELSE -20 END
  + CASE coalesce(education_level, 'Unknown') WHEN 'Postgraduate' THEN 30 WHEN 'Graduate' THEN 20
         WHEN 'High School' THEN 10 WHEN 'Secondary' THEN 5 WHEN 'Primary' THEN 0
         WHEN 'No Formal Education' THEN -20 ELSE -10 END
  + CASE residence_type WHEN 'Owned' THEN 30 WHEN 'Rented' THEN 10 ELSE -10 END
  + CASE city_tier WHEN 'Tier-1' THEN 20 WHEN 'Tier-2' THEN 10 ELSE 0 END
  + CASE WHEN age >= 25 AND age <= 55 THEN 20
         WHEN (age >= 21 AND age < 25) OR (age > 55 AND age <= 65) THEN 10 ELSE 0 END
  - dependents * 10))::INTEGER"""

SQL_SCORECARD_LIMIT = """(CASE WHEN rule_based_score >= 750 THEN trunc(least(monthly_income * 0.5e0, 50000e0))
  WHEN rule_based_score >= 650 THEN trunc(least(monthly_income * 0.25e0, 15000e0))
  WHEN rule_based_score >= 550 THEN trunc(least(monthly_income * 0.1e0, 5000e0)) ELSE 0 END)::INTEGER"""

SQL_GRADE = """CASE WHEN monthly_income >= 100000 THEN 'Excellent' WHEN monthly_income >= 60000 THEN 'Good'
  WHEN monthly_income >= 35000 THEN 'Fair' WHEN monthly_income >= 20000 THEN 'Low' ELSE 'Very Low' END"""

# cold-start record given columns: inc (double), p (probability), profile columns
SQL_COLD_CTE = """
c0 AS (SELECT *, coalesce(p_raw, 0.2e0) AS p, monthly_income::DOUBLE AS inc FROM cin),
c1 AS (SELECT *, {p2s} AS ml_score, least(inc * 0.3e0, 10000e0) AS initial_limit,
    coalesce(inc < 20000, false) AS r1,
    coalesce(dependents > 0 AND inc / (dependents + 1) < 15000, false) AS r2,
    coalesce(employment_status IN ('Daily Wage', 'Unemployed'), false) AS r3,
    coalesce(age < 23, false) AS r4, coalesce(age > 60, false) AS r5 FROM c0),
cold AS (SELECT *,
    least(ml_score, CASE WHEN r1 THEN 600 ELSE 100000 END, CASE WHEN r2 THEN 580 ELSE 100000 END,
          CASE WHEN r3 THEN 550 ELSE 100000 END)::INTEGER AS final_score,
    trunc(least(initial_limit, CASE WHEN r1 THEN 5000e0 ELSE 1e308 END, CASE WHEN r2 THEN 5000e0 ELSE 1e308 END,
          CASE WHEN r3 THEN 3000e0 ELSE 1e308 END, CASE WHEN r4 THEN 8000e0 ELSE 1e308 END,
          CASE WHEN r5 THEN inc * 0.25e0 ELSE 1e308 END))::INTEGER AS max_credit_limit,
    concat_ws('; ', CASE WHEN r1 THEN 'Low income - maximum limit capped' END,
          CASE WHEN r2 THEN 'High dependency ratio - limit reduced' END,
          CASE WHEN r3 THEN 'High-risk employment (' || employment_status || ') - conservative limits applied' END,
          CASE WHEN r4 THEN 'Young borrower - limit capped' END,
          CASE WHEN r5 THEN 'Senior borrower - limit adjusted to income' END) AS risk_warnings
  FROM c1)""".replace("{p2s}", sql_p2s("p"))

SQL_FULL_LIMIT = """(CASE WHEN fs >= 750 THEN trunc(least(inc * 1e0, 100000e0))
  WHEN fs >= 650 THEN trunc(least(inc * 0.5e0, 100000e0))
  WHEN fs >= 550 THEN trunc(least(inc * 0.25e0, 20000e0)) ELSE 0 END)::INTEGER"""


def _cold_sql(select: str, source: str = "profiles", extra_cols: str = "") -> str:
    return f"""WITH {O.snapshot_ctes() if source == 'snapshots' else O.PROFILE_CTE},
cin AS (SELECT *{extra_cols}, (900e0 - {SQL_SCORECARD}) / 600e0 AS p_raw FROM {source}),
{SQL_COLD_CTE}
{select}"""


# ------------------------------- queries -------------------------------

@query("safe_divide", O.with_snapshots("""
SELECT customer_id, snapshot_month,
  CASE WHEN max_outstanding_3m IS NULL OR max_outstanding_3m = 0 THEN 0e0
       ELSE outstanding_delta_3m / max_outstanding_3m END AS delta_share,
  CASE WHEN avg_txn_count_3m IS NULL OR avg_txn_count_3m = 0 THEN 0e0
       ELSE avg_txn_amt_3m / avg_txn_count_3m END AS amount_per_txn
FROM snapshots"""))
def q_safe_divide(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return s.select("customer_id", "snapshot_month",
                    C.safe_divide("outstanding_delta_3m", "max_outstanding_3m", 0.0).alias("delta_share"),
                    C.safe_divide("avg_txn_amt_3m", "avg_txn_count_3m", 0.0).alias("amount_per_txn"))


@query("prob_to_score", O.with_snapshots(f"""
SELECT customer_id, snapshot_month, risk_score / 100e0 AS probability,
  {sql_p2s('risk_score / 100e0')} AS credit_score FROM snapshots"""))
def q_prob_to_score(spark, sf_dir):
    p = P.surrogate_full_probability()
    return snapshots(spark, sf_dir).select("customer_id", "snapshot_month", p.alias("probability"),
                                           C.prob_to_score(p).alias("credit_score"))


@query("score_band", O.with_snapshots(f"""
SELECT customer_id, snapshot_month, {sql_p2s('risk_score / 100e0')} AS credit_score,
  {sql_decision(sql_p2s('risk_score / 100e0'))} AS decision FROM snapshots"""))
def q_score_band(spark, sf_dir):
    score = C.prob_to_score(P.surrogate_full_probability())
    return snapshots(spark, sf_dir).select("customer_id", "snapshot_month", score.alias("credit_score"),
                                           C.score_to_decision(score).alias("decision"))


@query("customer_tier", O.with_profiles("""
SELECT customer_id, account_age_months,
  (CASE WHEN account_age_months <= 3 THEN 1 WHEN account_age_months <= 6 THEN 2 ELSE 3 END)::INTEGER AS customer_tier,
  CASE WHEN account_age_months <= 3 THEN 'New Customer (Cold Start)'
       WHEN account_age_months <= 6 THEN 'Building History' ELSE 'Established Customer' END AS tier_description
FROM profiles"""))
def q_customer_tier(spark, sf_dir):
    tier = C.customer_tier("account_age_months")
    return profiles(spark, sf_dir).select("customer_id", "account_age_months", tier.alias("customer_tier"),
                                          C.tier_description(tier).alias("tier_description"))


@query("rule_scorecard", f"""WITH {O.PROFILE_CTE},
rs AS (SELECT *, {SQL_SCORECARD} AS rule_based_score FROM profiles)
SELECT customer_id, rule_based_score, {SQL_SCORECARD_LIMIT} AS credit_limit,
  {sql_decision('rule_based_score')} AS decision, {SQL_GRADE} AS income_grade FROM rs""")
def q_rule_scorecard(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    sc = P.scorecard_columns(prof.columns)
    return prof.select("customer_id", *[v.alias(k) for k, v in sc.items()])


_COLD_OUT = "customer_id, p AS ml_probability, ml_score, final_score, {dec} AS decision, max_credit_limit, risk_warnings"


@query("score_cold", _cold_sql(
    "SELECT " + _COLD_OUT.format(dec=sql_decision("final_score"))
    + ", 'cold_start_model + guardrails' AS model_used, "
      "'Cold start model has limited predictive power. Conservative limits applied.' AS note FROM cold"))
def q_score_cold(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    cold = P.cold_columns(prof.columns, P.surrogate_cold_probability(prof.columns))
    return prof.select("customer_id", *[v.alias(k) for k, v in cold.items()]).withColumn(
        "risk_warnings", _text("risk_warnings"))


@query("guardrails", _cold_sql(
    "SELECT customer_id, ml_score, final_score, " + sql_decision("final_score")
    + " AS decision, max_credit_limit, risk_warnings, "
      "(r1::INTEGER + r2::INTEGER + r3::INTEGER + r4::INTEGER + r5::INTEGER) AS n_warnings FROM cold"))
def q_guardrails(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    cold = P.cold_columns(prof.columns, P.surrogate_cold_probability(prof.columns))
    return prof.select("customer_id", cold["ml_score"].alias("ml_score"),
                       cold["final_score"].alias("final_score"), cold["decision"].alias("decision"),
                       cold["max_credit_limit"].alias("max_credit_limit"),
                       cold["risk_warnings"].alias("w")).select(
        "customer_id", "ml_score", "final_score", "decision", "max_credit_limit",
        F.concat_ws("; ", "w").alias("risk_warnings"), F.size("w").alias("n_warnings"))


@query("score_fallback", f"""WITH {O.PROFILE_CTE},
cin AS (SELECT *, NULL::DOUBLE AS p_raw FROM profiles),
{SQL_COLD_CTE}
SELECT {_COLD_OUT.format(dec=sql_decision('final_score'))} FROM cold""")
def q_score_fallback(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    cold = P.cold_columns(prof.columns, F.lit(None).cast("double"))  # model missing
    keep = ["ml_probability", "ml_score", "final_score", "decision", "max_credit_limit", "risk_warnings"]
    return prof.select("customer_id", *[cold[k].alias(k) for k in keep]).withColumn(
        "risk_warnings", _text("risk_warnings"))


_FULL_SQL = f"""WITH {O.snapshot_ctes()},
fin AS (SELECT *, coalesce(risk_score / 100e0, 0.2e0) AS p, monthly_income::DOUBLE AS inc FROM snapshots),
full1 AS (SELECT *, {sql_p2s('p')} AS fs FROM fin),
full2 AS (SELECT *, {sql_decision('fs')} AS fdec, {SQL_FULL_LIMIT} AS flim FROM full1)"""


@query("score_established", _FULL_SQL + """
SELECT customer_id, snapshot_month, p AS ml_probability, fs AS final_score, fdec AS decision,
  flim AS max_credit_limit, 'full_model' AS model_used,
  'Full model with behavioral features provides reliable predictions.' AS note FROM full2""")
def q_score_established(spark, sf_dir):
    snap = P.fill_defaults(snapshots(spark, sf_dir))
    full = P.established_columns(snap.columns, P.surrogate_full_probability())
    return snap.select("customer_id", "snapshot_month", *[v.alias(k) for k, v in full.items()])


def router_sql(snapshot_ctes: str) -> str:
    return f"""WITH {snapshot_ctes},
cin AS (SELECT *, (900e0 - {SQL_SCORECARD}) / 600e0 AS p_raw FROM snapshots),
{SQL_COLD_CTE},
f0 AS (SELECT *, coalesce(risk_score / 100e0, 0.2e0) AS fp FROM cold),
f1 AS (SELECT *, {sql_p2s('fp')} AS fs FROM f0),
f2 AS (SELECT *, {SQL_FULL_LIMIT} AS flim,
    trunc(0.4e0 * final_score + 0.6e0 * fs)::INTEGER AS bs,
    0.4e0 * p + 0.6e0 * fp AS bp,
    trunc(least(inc * 0.5e0, 25000e0))::INTEGER AS blim,
    (CASE WHEN account_age_months <= 3 THEN 1 WHEN account_age_months <= 6 THEN 2 ELSE 3 END)::INTEGER AS tier
  FROM f1)"""


_ROUTER_SQL = router_sql(O.snapshot_ctes())


@query("score_blended", _ROUTER_SQL + f"""
SELECT customer_id, snapshot_month, bp AS ml_probability, bs AS final_score,
  {sql_decision('bs')} AS decision, blim AS max_credit_limit FROM f2""")
def q_score_blended(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    cols = snap.columns
    cold = P.cold_columns(cols, P.surrogate_cold_probability(cols))
    full = P.established_columns(cols, P.surrogate_full_probability())
    blend = P.blended_columns(cols, cold, full)
    keep = ["ml_probability", "final_score", "decision", "max_credit_limit"]
    return snap.select("customer_id", "snapshot_month", *[blend[k].alias(k) for k in keep])


ROUTER_SELECT = f"""
SELECT customer_id, snapshot_month, tier AS customer_tier,
  CASE tier WHEN 1 THEN 'New Customer (Cold Start)' WHEN 2 THEN 'Building History' ELSE 'Established Customer' END AS tier_description,
  account_age_months,
  CASE tier WHEN 1 THEN p WHEN 2 THEN bp ELSE fp END AS ml_probability,
  CASE tier WHEN 1 THEN ml_score END AS ml_score,
  CASE tier WHEN 1 THEN final_score WHEN 2 THEN bs ELSE fs END AS final_score,
  CASE tier WHEN 1 THEN {sql_decision('final_score')} WHEN 2 THEN {sql_decision('bs')} ELSE {sql_decision('fs')} END AS decision,
  CASE tier WHEN 1 THEN max_credit_limit WHEN 2 THEN blim ELSE flim END AS max_credit_limit,
  CASE tier WHEN 1 THEN risk_warnings END AS risk_warnings,
  CASE tier WHEN 1 THEN 'cold_start_model + guardrails' WHEN 2 THEN 'blended (40% cold_start + 60% full)' ELSE 'full_model' END AS model_used,
  CASE tier WHEN 1 THEN 'Cold start model has limited predictive power. Conservative limits applied.'
            WHEN 3 THEN 'Full model with behavioral features provides reliable predictions.' END AS note,
  CASE tier WHEN 1 THEN 'New customer - monitor closely. Consider increasing limit after 3 months of good payment history.'
            WHEN 2 THEN 'Building credit history. Good payment behavior will unlock higher limits.'
            ELSE 'Established customer - standard credit policies apply.' END AS recommendation
FROM f2"""


@query("score_router", _ROUTER_SQL + ROUTER_SELECT)
def q_score_router(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    cols = snap.columns
    out = P.route(snap, P.surrogate_cold_probability(cols), P.surrogate_full_probability(),
                  keep=["customer_id", "snapshot_month"])
    return out.withColumn("risk_warnings", _text("risk_warnings"))


@query("response_cold", _cold_sql(f"""
SELECT customer_id, 'cold_start_guarded' AS model_type, round(p, 4) AS default_probability,
  final_score AS credit_score, {sql_decision('final_score')} AS decision, max_credit_limit, risk_warnings,
  'Cold start model has limited predictive power. Conservative limits applied.' AS recommendation FROM cold"""))
def q_response_cold(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    cold = P.cold_columns(prof.columns, P.surrogate_cold_probability(prof.columns))
    return prof.select(
        "customer_id", F.lit("cold_start_guarded").alias("model_type"),
        F.round(cold["ml_probability"], 4).alias("default_probability"),
        cold["final_score"].alias("credit_score"), cold["decision"].alias("decision"),
        cold["max_credit_limit"].alias("max_credit_limit"),
        F.concat_ws("; ", cold["risk_warnings"]).alias("risk_warnings"),
        cold["note"].alias("recommendation"))


@query("response_full", _FULL_SQL + """
SELECT customer_id, snapshot_month, 'full_model' AS model_type, round(p, 4) AS default_probability,
  fs AS credit_score, fdec AS decision, flim AS max_credit_limit,
  util_avg_3m AS risk_factor_utilization, missed_due_count_3m AS risk_factor_missed_payments,
  risk_score AS risk_factor_risk_score FROM full2""")
def q_response_full(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    full = P.established_columns(snap.columns, P.surrogate_full_probability())
    return snap.select(
        "customer_id", "snapshot_month", F.lit("full_model").alias("model_type"),
        F.round(full["ml_probability"], 4).alias("default_probability"),
        full["final_score"].alias("credit_score"), full["decision"].alias("decision"),
        full["max_credit_limit"].alias("max_credit_limit"),
        F.struct(F.col("util_avg_3m").alias("utilization"),
                 F.col("missed_due_count_3m").alias("missed_payments"),
                 F.col("risk_score").alias("risk_score")).alias("risk_factors"),
    ).select("*", *[F.col(f"risk_factors.{k}").alias(f"risk_factor_{k}")
                    for k in ("utilization", "missed_payments", "risk_score")]).drop("risk_factors")


def _violation_sql(rules) -> str:
    parts = []
    for name, lo, hi in rules:
        parts.append(f"CASE WHEN {name} IS NULL THEN '{name}: missing' END")
        if lo is not None:
            parts.append(f"CASE WHEN {name} < {lo} THEN '{name}: below {lo}' END")
        if hi is not None:
            parts.append(f"CASE WHEN {name} > {hi} THEN '{name}: above {hi}' END")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


# Every 7th customer breaks a rule, another one for each remainder: the data itself is clean.
_FAULTS = {"age": (1, "17"), "monthly_income": (2, "-5"), "city_tier": (3, "NULL"), "dependents": (4, "-1"), "account_age_months": (5, "NULL")}
_FULL_FAULTS = {"debt_burden_category": (1, "9"), "missed_due_last_1m": (2, "2"), "risk_score": (3, "101"), "util_avg_3m": (4, "NULL"), "late_payments_3m": (5, "-2")}


def with_faults(df, faults: dict):
    """Values of every 49th key made faulty, by the remainder of customer_id / 7."""
    types = dict(df.dtypes)
    turn = F.when(F.col("customer_id") % 7 == 0, (F.col("customer_id") / 7).cast("long") % 7)
    return df.withColumns({c: F.when(turn == r, F.lit(None if v == "NULL" else float(v)).cast(types[c])).otherwise(F.col(c))
                           for c, (r, v) in faults.items()})


def faults_sql(faults: dict) -> str:
    turn = "CASE WHEN customer_id % 7 = 0 THEN (customer_id // 7) % 7 END"
    return "* REPLACE (" + ", ".join(f"CASE WHEN {turn} = {r} THEN {v} ELSE {c} END AS {c}" for c, (r, v) in faults.items()) + ")"


@query("validate_static", O.with_profiles(f"""
SELECT customer_id, v AS violations, v = '' AS is_valid
FROM (SELECT customer_id, {_violation_sql(P.STATIC_RULES)} AS v FROM (SELECT {faults_sql(_FAULTS)} FROM profiles))"""))
def q_validate_static(spark, sf_dir):
    prof = with_faults(profiles(spark, sf_dir), _FAULTS)
    v = P.violations_column(prof.columns, P.STATIC_RULES)
    return prof.select("customer_id", F.concat_ws("; ", v).alias("violations"),
                       (F.size(v) == 0).alias("is_valid"))


@query("validate_full", O.with_snapshots(f"""
SELECT customer_id, snapshot_month, v AS violations, v = '' AS is_valid
FROM (SELECT customer_id, snapshot_month, {_violation_sql(P.STATIC_RULES + P.BEHAVIOURAL_RULES)} AS v
      FROM (SELECT {faults_sql(_FULL_FAULTS)} FROM snapshots))"""))
def q_validate_full(spark, sf_dir):
    snap = with_faults(snapshots(spark, sf_dir), _FULL_FAULTS)
    v = P.violations_column(snap.columns, P.STATIC_RULES + P.BEHAVIOURAL_RULES)
    return snap.select("customer_id", "snapshot_month", F.concat_ws("; ", v).alias("violations"),
                       (F.size(v) == 0).alias("is_valid"))


def _defaults_sql(audit: bool) -> str:
    cols = []
    for k, v in S.NEUTRAL_DEFAULTS.items():
        if k == "util_avg_3m":
            cols.append("CASE WHEN customer_id % 3 > 0 THEN customer_id % 3 / 10e0 END AS util_avg_3m")
            continue
        if audit and k == "snapshot_month":
            v = S.AUDIT_SNAPSHOT_MONTH_DEFAULT
        if audit and k == "income_affordability_score":
            cols.append("CASE WHEN monthly_income > 0 THEN monthly_income::DOUBLE / 1e0 ELSE 1e0 END AS income_affordability_score")
            continue
        lit = f"{float(v)!r}e0".replace(".0e0", "e0") if isinstance(v, float) else f"{v}::INTEGER"
        cols.append(f"{lit} AS {k}")
    return O.with_profiles(
        "SELECT customer_id, age, employment_status, education_level, monthly_income, city_tier, "
        "dependents, residence_type, account_age_months, " + ", ".join(cols) + " FROM profiles")


def _batch_with_one_feature(spark, sf_dir):
    """Profiles with one behavioural feature of their own, missing for every third: what a
    request brings is kept, its NULLs too; what it lacks gets the default."""
    n = F.col("customer_id") % 3
    return profiles(spark, sf_dir).withColumn("util_avg_3m", F.when(n > 0, n / F.lit(10.0)))


@query("defaults_fill", _defaults_sql(False))
def q_defaults_fill(spark, sf_dir):
    """A batch made ready for the full model (P10)."""
    return P.fill_defaults(_batch_with_one_feature(spark, sf_dir))


@query("defaults_fill_audit", _defaults_sql(True))
def q_defaults_fill_audit(spark, sf_dir):
    return P.fill_defaults(_batch_with_one_feature(spark, sf_dir), audit_variant=True)


@query("log_scaled", O.with_snapshots("""
SELECT customer_id, snapshot_month,
  round(CASE WHEN monthly_income > -1 THEN ln(1 + monthly_income) END, 9) AS log_monthly_income,
  round(CASE WHEN avg_txn_amt_3m > -1 THEN ln(1 + avg_txn_amt_3m) END, 9) AS log_avg_txn_amt_3m,
  round(CASE WHEN max_outstanding_3m > -1 THEN ln(1 + max_outstanding_3m) END, 9) AS log_max_outstanding_3m,
  round(CASE WHEN outstanding_delta_3m > -1 THEN ln(1 + outstanding_delta_3m) END, 9) AS log_outstanding_delta_3m
FROM snapshots"""))
def q_log_scaled(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    return snap.select("customer_id", "snapshot_month",
                       *[F.round(C.log1p_(c), 9).alias(f"log_{c}") for c in S.LOG_COLUMNS])
