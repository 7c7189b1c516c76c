"""Audit queries (P9, P12, A24–A28, J3, J4) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import policy as P
from ..operators import audit as AU
from . import oracle as O
from .catalog import _round, profiles, query, snapshots
from .q_eval import SPLIT_CTES, split_snapshots
from .q_scoring import SQL_SCORECARD, sql_decision, sql_p2s


def _risk_sql(m1="missed_due_last_1m", s="consecutive_missed_due", minr="payment_ratio_min_3m",
              pct="outstanding_to_income_pct", det="is_deteriorating", avgr="payment_ratio_avg_3m",
              ever="ever_defaulted") -> str:
    return (f"CASE WHEN ({pct}) IS NULL THEN NULL ELSE least(({m1}) * 25 + ({s}) * 15 + (1e0 - ({minr})) * 20e0 "
            f"+ least(({pct}) / 100e0, 1e0) * 15e0 + ({det}) * 10 + (CASE WHEN ({avgr}) < 0.7e0 THEN 1 ELSE 0 END) * 10 "
            f"+ ({ever}) * 5, 100e0) END")


def _model_sql(risk: str | None = None) -> str:
    """The surrogate model (see operators.audit) over columns in scope."""
    return (f"(({risk or _risk_sql()}) / 100e0 + (900e0 - {SQL_SCORECARD}) / 600e0 + (late_payments_3m / 3e0 + missed_due_count_3m / 3e0 "
            f"+ least(util_avg_3m, 1e0) + (1e0 - payment_ratio_last_1m) + least(greatest(outstanding_delta_3m / 10000e0, 0e0), 1e0) "
            f"+ (1 - bnpl_active_last_1m)) / 6e0) / 3e0")


# cold cohort: neutral defaults (audit variant) -> surrogate probability
_NEUTRAL = ", ".join(f"{float(v)!r}::DOUBLE AS {k}" if isinstance(v, float) else f"{v}::INTEGER AS {k}" for k, v in S.NEUTRAL_DEFAULTS.items())
_COLD_P = _EST_P = _model_sql()

AUDIT_CTES = f"""{O.snapshot_ctes()},
neutral AS (SELECT *, {_NEUTRAL} FROM profiles),
cold AS (SELECT *, {_COLD_P} AS probability, {sql_p2s(_COLD_P)} AS credit_score FROM neutral),
est AS (SELECT customer_id, {_EST_P} AS probability, {sql_p2s(_EST_P)} AS credit_score FROM snapshots),
cohorts AS (
  SELECT cohort, count(*)::BIGINT AS n_rows, avg(probability) AS mean_probability, avg(credit_score) AS mean_score,
    min(credit_score) AS min_score, max(credit_score) AS max_score, stddev_pop(credit_score) AS std_score
  FROM (SELECT 'cold_start' AS cohort, probability, credit_score FROM cold
        UNION ALL SELECT 'established', probability, credit_score FROM est) GROUP BY cohort),
labelled AS (
  SELECT customer_id, {sql_decision('credit_score')} AS decision,
    CASE {sql_decision(SQL_SCORECARD)} WHEN 'Approve' THEN 'Low Risk' WHEN 'Approve_Low_Limit' THEN 'Medium-Low Risk'
      WHEN 'Conditional' THEN 'Higher Risk' WHEN 'Reject' THEN 'High Risk' END AS profile
  FROM cold),
imp AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, abs(corr({f}::DOUBLE, default_next_1m::DOUBLE)) AS importance FROM snapshots"
                             for f in S.ALL_FEATURES if f not in S.CATEGORICAL_STATIC)}),
grp AS (SELECT * FROM (VALUES {', '.join([f"('{f}', 0)" for f in S.STATIC_FEATURES] + [f"('{f}', 1)" for f in S.BEHAVIORAL_FEATURES])})
        AS g(group_feature, priority)),
matched AS (SELECT feature, importance, min(priority) AS priority FROM imp JOIN grp ON starts_with(feature, group_feature)
            WHERE importance IS NOT NULL AND NOT isnan(importance) GROUP BY feature, importance),
shares AS (SELECT CASE WHEN priority = 0 THEN 'static' ELSE 'behavioral' END AS "group", sum(importance) AS importance
           FROM matched GROUP BY 1)"""


@query("cohort_compare", f"""WITH {AUDIT_CTES}
SELECT cohort, n_rows, round(mean_probability, 9) AS mean_probability, round(mean_score, 6) AS mean_score,
  min_score, max_score, round(std_score, 6) AS std_score FROM cohorts""")
def q_cohort_compare(spark, sf_dir):
    cold = AU.cold_cohort(profiles(spark, sf_dir))
    est = AU.established_cohort(snapshots(spark, sf_dir))
    return _round(AU.cohort_compare(cold, est), {"mean_probability": 9, "mean_score": 6, "std_score": 6})


@query("importance_share", f"""WITH {AUDIT_CTES}
SELECT "group", round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS share FROM shares""")
def q_importance_share(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    feats = [f for f in S.ALL_FEATURES if f not in S.CATEGORICAL_STATIC]
    imp = AU.correlation_importance(snap, feats)
    return _round(AU.importance_share(imp, AU.group_table(spark)), {"importance": 6, "share": 6})


def _terms_sql() -> str:
    """One row per value of a categorical: its term of the correlation ratio with the label."""
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{c}_' || coalesce({c}, 'Unknown') AS feature, count(*)::BIGINT AS n_rows, avg(default_next_1m) AS label_mean,
  sqrt(count(*) * (avg(default_next_1m) - (SELECT avg(default_next_1m) FROM snapshots)) ** 2
    / ((SELECT count(*) FROM snapshots) * (SELECT var_pop(default_next_1m) FROM snapshots))) AS importance FROM snapshots GROUP BY {c}"""
                              for c in S.CATEGORICAL_STATIC)


@query("categorical_association", O.with_snapshots(f"""SELECT "column", feature, n_rows, round(label_mean, 9) AS label_mean,
  round(importance, 9) AS importance, round(sqrt(sum(importance ** 2) OVER (PARTITION BY "column")), 9) AS eta FROM ({_terms_sql()})"""))
def q_categorical_association(spark, sf_dir):
    """Association of every category with the label and the correlation ratio of its column."""
    from pyspark.sql import Window
    a = AU.categorical_association(snapshots(spark, sf_dir), S.CATEGORICAL_STATIC)
    a = a.withColumn("eta", F.sqrt(F.sum(F.col("importance") ** 2).over(Window.partitionBy("column"))))     # one row per value
    return _round(a, {"label_mean": 9, "importance": 9, "eta": 9})


@query("importance_share_expanded", f"""WITH {AUDIT_CTES},
expanded AS (SELECT feature, importance FROM imp WHERE importance IS NOT NULL AND NOT isnan(importance)
  UNION ALL SELECT feature, importance FROM ({_terms_sql()})),
best AS (SELECT feature, importance, min(priority) AS priority FROM expanded JOIN grp ON starts_with(feature, group_feature) GROUP BY feature, importance),
per AS (SELECT CASE WHEN priority = 0 THEN 'static' ELSE 'behavioral' END AS "group", sum(importance) AS importance FROM best GROUP BY 1)
SELECT "group", round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS share FROM per""")
def q_importance_share_expanded(spark, sf_dir):
    """Static and behavioural share over one-hot names, which match their column by prefix."""
    imp = AU.expanded_importance(snapshots(spark, sf_dir), S.ALL_FEATURES)
    return _round(AU.importance_share(imp, AU.group_table(spark)), {"importance": 6, "share": 6})


@query("audit_flags", f"""WITH {AUDIT_CTES},
cs AS (SELECT max(CASE WHEN cohort = 'cold_start' THEN std_score END) AS cold_std,
              max(CASE WHEN cohort = 'cold_start' THEN mean_score END) AS cold_mean,
              max(CASE WHEN cohort = 'established' THEN mean_score END) AS est_mean FROM cohorts),
ls AS (SELECT count(*) FILTER (WHERE contains(profile, 'High Risk') AND decision = 'Approve')::BIGINT AS high_risk_approved,
              count(*) FILTER (WHERE contains(profile, 'Low Risk') AND decision = 'Reject')::BIGINT AS low_risk_rejected FROM labelled),
ss AS (SELECT coalesce(sum(CASE WHEN "group" = 'static' THEN importance END), 0e0) AS static_imp,
              coalesce(sum(CASE WHEN "group" = 'behavioral' THEN importance END), 0e0) AS beh_imp FROM shares),
flags AS (SELECT *, abs(cold_mean - est_mean) AS score_gap,
    [CASE WHEN cold_std < 50 THEN 'LOW VARIANCE' END, CASE WHEN abs(cold_mean - est_mean) > 100 THEN 'SCORE BIAS' END,
     CASE WHEN high_risk_approved > 0 THEN 'FALSE APPROVALS' END, CASE WHEN low_risk_rejected > 0 THEN 'FALSE REJECTIONS' END,
     CASE WHEN beh_imp > (static_imp + beh_imp) * 0.7e0 THEN 'FEATURE IMBALANCE' END] AS arr FROM cs, ls, ss)
SELECT round(cold_std, 6) AS cold_std, round(score_gap, 6) AS score_gap, high_risk_approved, low_risk_rejected,
  beh_imp > static_imp * 2 AS behavioral_over_2x_static,
  len(list_filter(arr, lambda x: x IS NOT NULL))::INTEGER AS n_issues,
  array_to_string(list_filter(arr, lambda x: x IS NOT NULL), '; ') AS issues FROM flags""")
def q_audit_flags(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    snap = snapshots(spark, sf_dir)
    cohorts = AU.cohort_compare(AU.cold_cohort(prof), AU.established_cohort(snap))
    feats = [f for f in S.ALL_FEATURES if f not in S.CATEGORICAL_STATIC]
    shares = AU.importance_share(AU.correlation_importance(snap, feats), AU.group_table(spark))
    return _round(AU.audit_flags(cohorts, AU.labelled_cold_cohort(prof), shares), {"cold_std": 6, "score_gap": 6})


@query("ml_vs_rule", f"""WITH {AUDIT_CTES}
SELECT customer_id, credit_score AS ml_score, {SQL_SCORECARD} AS rule_based_score,
  {sql_decision(SQL_SCORECARD)} AS rule_decision
FROM cold""")
def q_ml_vs_rule(spark, sf_dir):
    """ML (full model + neutral defaults) vs rule score per profile: an
    equi-join on the profile key (J3), not a positional pairing."""
    prof = profiles(spark, sf_dir)
    ml = AU.cold_cohort(prof).select("customer_id", F.col("credit_score").alias("ml_score"))
    sc = P.scorecard_columns(prof.columns)
    rule = prof.select("customer_id", sc["rule_based_score"].alias("rule_based_score"),
                       sc["decision"].alias("rule_decision"))
    return ml.join(rule, "customer_id")


@query("tier_monitor", O.with_snapshots("""
SELECT (CASE WHEN account_age_months <= 3 THEN 1 WHEN account_age_months <= 6 THEN 2 ELSE 3 END)::INTEGER AS customer_tier,
  snapshot_month, count(*)::BIGINT AS n_rows, round(avg(default_next_1m), 9) AS default_rate
FROM snapshots GROUP BY 1, 2"""))
def q_tier_monitor(spark, sf_dir):
    """Default rate per customer tier and month."""
    snap = snapshots(spark, sf_dir)
    return (snap.groupBy(C.customer_tier("account_age_months").alias("customer_tier"), "snapshot_month")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.round(F.avg(S.LABEL), 9).alias("default_rate")))


def _override_sql(over: dict) -> str:
    """A row with columns replaced."""
    return "* REPLACE (" + ", ".join(f"{v}::{'INTEGER' if isinstance(v, int) else 'DOUBLE'} AS {k}" for k, v in over.items()) + ")"


@query("whatif_scenarios", f"""WITH {SPLIT_CTES},
t AS (SELECT * FROM splitted WHERE is_test),
b AS (SELECT * FROM t ORDER BY customer_id, snapshot_month LIMIT 1),
v AS (SELECT 'baseline' AS scenario, {_EST_P} AS p FROM t
  UNION ALL SELECT 'history_wiped', {_EST_P} FROM (SELECT {_override_sql({c: 0 for c in S.HISTORY_COLUMNS})} FROM t)
  UNION ALL SELECT 'high_risk_override', {_EST_P} FROM (SELECT {_override_sql(S.HIGH_RISK_OVERRIDE)} FROM b)
  UNION ALL SELECT 'low_risk_override', {_EST_P} FROM (SELECT {_override_sql(S.LOW_RISK_OVERRIDE)} FROM b))
SELECT scenario, count(*)::BIGINT AS n_rows, round(avg(p), 9) AS avg_probability FROM v GROUP BY 1""")
def q_whatif_scenarios(spark, sf_dir):
    test = split_snapshots(spark, sf_dir).where("is_test").drop("is_test")
    return _round(AU.whatif_scenarios(test, ["customer_id", "snapshot_month"]), {"avg_probability": 9})


# ------------------------------- personas (re-aimed) -------------------------------
# The reference scores a few hand-made personas; here the personas come from the
# data: the lowest-id applicant of every employment x education x city segment
# (an aggregate by segment, then a key join), so the queries read the whole table.

_SEG = ["employment_status", "education_level", "city_tier"]


def personas(spark, sf_dir):
    prof = profiles(spark, sf_dir)
    reps = prof.groupBy(*_SEG).agg(F.min("customer_id").alias("customer_id"))
    return prof.join(reps.select("customer_id"), "customer_id", "left_semi").withColumn(
        "profile", F.concat_ws(" / ", *_SEG))


_PERSONA_CTE = f"""WITH {O.PROFILE_CTE},
reps AS (SELECT min(customer_id) AS customer_id FROM profiles GROUP BY employment_status, education_level, city_tier),
pers AS (SELECT p.*, concat_ws(' / ', employment_status, education_level, city_tier) AS profile
         FROM profiles p WHERE customer_id IN (SELECT customer_id FROM reps))"""


@query("personas_rules", f"""{_PERSONA_CTE},
rs AS (SELECT *, {SQL_SCORECARD} AS rule_based_score FROM pers)
SELECT customer_id, profile, rule_based_score,
  (CASE WHEN rule_based_score >= 750 THEN trunc(least(monthly_income * 0.5e0, 50000e0))
        WHEN rule_based_score >= 650 THEN trunc(least(monthly_income * 0.25e0, 15000e0))
        WHEN rule_based_score >= 550 THEN trunc(least(monthly_income * 0.1e0, 5000e0)) ELSE 0 END)::INTEGER AS credit_limit,
  {sql_decision('rule_based_score')} AS decision FROM rs""")
def q_personas_rules(spark, sf_dir):
    """Rule scorecard over representative applicants."""
    p = personas(spark, sf_dir)
    sc = P.scorecard_columns(p.columns)
    return p.select("customer_id", "profile", sc["rule_based_score"].alias("rule_based_score"),
                    sc["credit_limit"].alias("credit_limit"), sc["decision"].alias("decision"))


@query("personas_router", f"""{_PERSONA_CTE},
cin AS (SELECT *, (900e0 - {SQL_SCORECARD}) / 600e0 AS p_raw FROM pers),
{__import__('ledgerlens.plans.q_scoring', fromlist=['SQL_COLD_CTE']).SQL_COLD_CTE},
r AS (SELECT *, (CASE WHEN account_age_months <= 3 THEN 1 WHEN account_age_months <= 6 THEN 2 ELSE 3 END)::INTEGER AS tier,
        {sql_p2s('0e0')} AS fs, trunc(least(inc * 1e0, 100000e0))::INTEGER AS flim,
        trunc(least(inc * 0.5e0, 25000e0))::INTEGER AS blim FROM cold),
r2 AS (SELECT *, trunc(0.4e0 * final_score + 0.6e0 * fs)::INTEGER AS bs FROM r)
SELECT customer_id, profile, tier AS customer_tier,
  CASE tier WHEN 1 THEN final_score WHEN 2 THEN bs ELSE fs END AS final_score,
  CASE tier WHEN 1 THEN {sql_decision('final_score')} WHEN 2 THEN {sql_decision('bs')} ELSE {sql_decision('fs')} END AS decision,
  CASE tier WHEN 1 THEN max_credit_limit WHEN 2 THEN blim ELSE flim END AS max_credit_limit,
  CASE tier WHEN 1 THEN 'cold_start_model + guardrails' WHEN 2 THEN 'blended (40% cold_start + 60% full)' ELSE 'full_model' END AS model_used
FROM r2""")
def q_personas_router(spark, sf_dir):
    """Tier router over representative applicants with neutral behavioural
    defaults (M19, F17): cold p from the scorecard, full p from the risk score."""
    p = P.fill_defaults(personas(spark, sf_dir))
    out = P.route(p, P.surrogate_cold_probability(p.columns), P.surrogate_full_probability(),
                  keep=["customer_id", "profile"])
    return out.select("customer_id", "profile", "customer_tier", "final_score", "decision",
                      "max_credit_limit", "model_used")
