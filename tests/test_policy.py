"""Scoring policy: boundaries, guardrail properties, scorecard personas, router."""

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions import columns as C
from ledgerlens.functions import policy as P


def _one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_score_and_decision_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (1.7,), (0.25,), (0.2,)], "p double")
    got = [r["s"] for r in df.select(C.prob_to_score("p").alias("s")).collect()]
    assert got == [900, 300, 900, 300, 750, 780]
    sc = spark.createDataFrame([(s,) for s in (549, 550, 649, 650, 749, 750)], "s int")
    dec = [r["d"] for r in sc.select(C.score_to_decision("s").alias("d")).collect()]
    assert dec == ["Reject", "Conditional", "Conditional", "Approve_Low_Limit", "Approve_Low_Limit", "Approve"]


def test_tier_boundaries(spark):
    df = spark.createDataFrame([(a,) for a in (0, 3, 4, 6, 7)], "a int")
    assert [r["t"] for r in df.select(C.customer_tier("a").alias("t")).collect()] == [1, 1, 2, 2, 3]


def test_burden_and_age_buckets(spark):
    df = spark.createDataFrame([(9.99, 5), (10.0, 6), (30.0, 23), (50.0, 24), (None, None)], "p double, m int")
    r = df.select(C.debt_burden_category("p").alias("b"), C.account_age_bucket("m").alias("a")).collect()
    assert [x["b"] for x in r] == [0, 1, 2, 3, 3]
    assert [x["a"] for x in r] == [0, 1, 1, 2, 2]


PROFILE_DDL = ("age int, employment_status string, education_level string, monthly_income long, "
               "city_tier string, dependents int, residence_type string, account_age_months int")


def test_guardrails_fallback_daily_wage(spark):
    # income 15000, 4 dependents, Daily Wage, fallback probability 0.2 -> ml score 780
    df = _one(spark, [(40, "Daily Wage", "Primary", 15000, "Tier-3", 4, "Rented", 0)], PROFILE_DDL)
    c = P.cold_columns(df.columns, F.lit(None).cast("double"))
    r = df.select(*[v.alias(k) for k, v in c.items()]).collect()[0]
    assert r["ml_probability"] == 0.2 and r["ml_score"] == 780
    assert r["final_score"] == 550 and r["decision"] == "Conditional"
    assert r["max_credit_limit"] == 3000
    assert r["risk_warnings"] == [S.WARN_LOW_INCOME, S.WARN_DEPENDENCY,
                                  "High-risk employment (Daily Wage) - conservative limits applied"]


@pytest.mark.parametrize("income,age,expect_limit,n_warn", [
    (19999, 30, 5000, 1), (20000, 30, 6000, 0), (40000, 22, 8000, 1), (40000, 23, 10000, 0),
    (40000, 60, 10000, 0), (40000, 61, 10000, 1),
])
def test_guardrail_edges(spark, income, age, expect_limit, n_warn):
    df = _one(spark, [(age, "Salaried", "Graduate", income, "Tier-1", 0, "Owned", 1)], PROFILE_DDL)
    c = P.cold_columns(df.columns, F.lit(0.0))
    r = df.select(c["max_credit_limit"].alias("l"), F.size(c["risk_warnings"]).alias("n")).collect()[0]
    assert r["l"] == expect_limit and r["n"] == n_warn


def test_guardrails_never_raise(spark):
    rows = [(a, e, "Graduate", i, "Tier-2", d, "Rented", 1)
            for a in (19, 22, 40, 61, 80) for e in ("Salaried", "Daily Wage", "Unemployed")
            for i in (0, 15000, 19999, 20000, 90000) for d in (0, 1, 4)]
    df = _one(spark, rows, PROFILE_DDL).withColumn("p", F.lit(0.1))
    c = P.cold_columns(df.columns, F.col("p"))
    bad = df.select(c["ml_score"].alias("ml"), c["final_score"].alias("fs"), c["max_credit_limit"].alias("lim"),
                    F.least(F.col("monthly_income") * 0.3, F.lit(10000.0)).cast("int").alias("init")) \
        .where("fs > ml OR lim > init").count()
    assert bad == 0


# (name, age, employment, education, income, city, dependents, residence) -> (score, limit, decision)
PERSONAS = [
    ("Young Salaried Professional (Low Risk)", 28, "Salaried", "Graduate", 60000, "Tier-1", 0, "Rented", 790, 30000, "Approve"),
    ("Senior Executive (Very Low Risk)", 45, "Salaried", "Postgraduate", 150000, "Tier-1", 2, "Owned", 830, 50000, "Approve"),
    ("Daily Wage Worker (Higher Risk)", 32, "Daily Wage", "Secondary", 15000, "Tier-3", 3, "Rented", 525, 0, "Reject"),
    ("Fresh Graduate (Unknown Risk)", 22, "Salaried", "Graduate", 25000, "Tier-2", 0, "Rented", 710, 6250, "Approve_Low_Limit"),
    ("No Formal Education Worker (High Risk)", 40, "Daily Wage", "No Formal Education", 12000, "Tier-3", 4, "Rented", 490, 0, "Reject"),
]


def test_rule_scorecard_personas(spark):
    df = spark.createDataFrame(
        [p[:8] for p in PERSONAS],
        "profile string, age int, employment_status string, education_level string, monthly_income long, "
        "city_tier string, dependents int, residence_type string")
    sc = P.scorecard_columns(df.columns)
    got = {r["profile"]: (r["s"], r["l"], r["d"]) for r in
           df.select("profile", sc["rule_based_score"].alias("s"), sc["credit_limit"].alias("l"),
                     sc["decision"].alias("d")).collect()}
    for p in PERSONAS:
        assert got[p[0]] == (p[8], p[9], p[10])


def test_scorecard_field_defaults(spark):
    df = spark.createDataFrame([(1,)], "customer_id int")    # nothing known
    sc = P.scorecard_columns(df.columns)
    r = df.select(sc["rule_based_score"].alias("s"), sc["income_grade"].alias("g")).collect()[0]
    # 600 - 50 (income 0) - 20 (Unknown job) - 10 (Unknown education) - 10 (residence) + 0 + 20 (age 30)
    assert r["s"] == 530 and r["g"] == "Very Low"


def test_router_tiers_and_blend(spark):
    rows = [(35, "Salaried", "Graduate", 80000, "Tier-1", 1, "Owned", acct) for acct in (1, 5, 12)]
    df = _one(spark, rows, PROFILE_DDL)
    out = P.route(df, F.lit(0.1), F.lit(0.3)).collect()
    t1, t2, t3 = out
    assert (t1["customer_tier"], t2["customer_tier"], t3["customer_tier"]) == (1, 2, 3)
    assert t1["model_used"] == S.MODEL_USED_COLD and t1["ml_score"] == 840
    assert t3["final_score"] == 720 and t3["decision"] == "Approve_Low_Limit" and t3["max_credit_limit"] == 40000
    assert t2["final_score"] == int(0.4 * 840 + 0.6 * 720) and t2["ml_score"] is None and t2["note"] is None
    assert t2["max_credit_limit"] == 25000 and t2["ml_probability"] == pytest.approx(0.4 * 0.1 + 0.6 * 0.3)


def test_zero_on_reject(spark):
    rows = [(35, "Salaried", "Graduate", 80000, "Tier-1", 1, "Owned", acct) for acct in (1, 5, 12)]
    df = _one(spark, rows, PROFILE_DDL)
    out = P.route(df, F.lit(0.9), F.lit(0.9)).collect()
    assert {r["decision"] for r in out} == {"Reject"} and out[0]["max_credit_limit"] > 0
    assert {r["max_credit_limit"] for r in P.route(df, F.lit(0.9), F.lit(0.9), zero_on_reject=True).collect()} == {0}


def test_validation_quarantine(spark):
    rows = [(17, "Salaried", "Graduate", 1000, "Tier-1", 0, "Owned", 0),
            (30, None, "Graduate", -5, "Tier-1", 0, "Owned", 2),
            (30, "Salaried", "Graduate", 1000, "Tier-1", 0, "Owned", 2)]
    valid, quarantine = P.validate(_one(spark, rows, PROFILE_DDL))
    assert valid.count() == 1
    v = sorted(tuple(r["violations"]) for r in quarantine.collect())
    assert ("age: below 18",) in v
    assert ("employment_status: missing", "monthly_income: below 0") in v


def test_fill_defaults_absent_and_null(spark):
    df = spark.createDataFrame([(1, None)], "customer_id int, util_avg_3m double")
    out = P.fill_defaults(df).collect()[0]
    # a NULL that the request brings stays for the model's imputer
    assert out["util_avg_3m"] is None and out["payment_ratio_avg_3m"] == 1.0 and out["snapshot_month"] == 6
    audit = P.fill_defaults(spark.createDataFrame([(1, 5000)], "customer_id int, monthly_income long"),
                            audit_variant=True).collect()[0]
    assert audit["snapshot_month"] == 4 and audit["income_affordability_score"] == 5000.0
