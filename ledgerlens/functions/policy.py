"""Scoring policy as Column expressions.

Every rule is a CASE / least / greatest expression, so a batch of any size is
scored in one projection inside whole-stage codegen — no per-row Python and no
per-tier loops: the router computes the cold, blended and full results side by
side and picks fields with ``when(tier ...)``.

Field defaults (P11): an absent or NULL field takes the documented default
(income 0, employment 'Unknown', dependents 0, age 30, account age 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .columns import customer_tier, prob_to_score, score_to_decision, tier_description


# ---------------------------------------------------------------------------
# field access with defaults
# ---------------------------------------------------------------------------

def field(df_cols: list[str], name: str, default) -> Column:
    """``customer.get(name, default)``: the column when present (NULL -> default),
    otherwise the literal default."""
    if name in df_cols:
        return F.coalesce(F.col(name), F.lit(default))
    return F.lit(default)


def _income(cols):
    return field(cols, "monthly_income", 0).cast("double")


# ---------------------------------------------------------------------------
# guardrails
# ---------------------------------------------------------------------------

def guardrail_columns(cols: list[str], score: Column, limit: Column) -> dict[str, Column]:
    """Adjusted score, integer limit, decision and warnings (in rule order)."""
    income = _income(cols)
    employment = field(cols, "employment_status", "Unknown")
    dependents = field(cols, "dependents", 0)
    age = field(cols, "age", 30)

    r1 = income < 20000
    r2 = (dependents > 0) & (income / (dependents + F.lit(1)) < 15000)
    r3 = employment.isin(*S.RISKY_EMPLOYMENT)
    r4 = age < 23
    r5 = age > 60

    s = score
    s = F.when(r1, F.least(s, F.lit(600))).otherwise(s)
    s = F.when(r2, F.least(s, F.lit(580))).otherwise(s)
    s = F.when(r3, F.least(s, F.lit(550))).otherwise(s)

    lim = limit.cast("double")
    lim = F.when(r1, F.least(lim, F.lit(5000.0))).otherwise(lim)
    lim = F.when(r2, F.least(lim, F.lit(5000.0))).otherwise(lim)
    lim = F.when(r3, F.least(lim, F.lit(3000.0))).otherwise(lim)
    lim = F.when(r4, F.least(lim, F.lit(8000.0))).otherwise(lim)
    lim = F.when(r5, F.least(lim, income * F.lit(0.25))).otherwise(lim)

    employment_warning = F.concat(F.lit("High-risk employment ("), employment,
                                  F.lit(") - conservative limits applied"))
    warnings = F.filter(F.array(
        F.when(r1, F.lit(S.WARN_LOW_INCOME)),
        F.when(r2, F.lit(S.WARN_DEPENDENCY)),
        F.when(r3, employment_warning),
        F.when(r4, F.lit(S.WARN_YOUNG)),
        F.when(r5, F.lit(S.WARN_SENIOR)),
    ), lambda x: x.isNotNull())
    return {
        "final_score": s.cast("int"),
        "max_credit_limit": lim.cast("int"),
        "decision": score_to_decision(s),
        "risk_warnings": warnings,
    }


# ---------------------------------------------------------------------------
# cold start, established, blend, router
# ---------------------------------------------------------------------------

def with_fallback(prob: Column) -> Column:
    """Probability, or 0.2 when the model is missing / failed."""
    return F.coalesce(prob, F.lit(S.FALLBACK_PROBABILITY))


def cold_columns(cols: list[str], prob: Column) -> dict[str, Column]:
    """Cold-start scoring record (F12) for a cold-model probability column."""
    p = with_fallback(prob)
    ml_score = prob_to_score(p)
    initial_limit = F.least(_income(cols) * F.lit(0.3), F.lit(float(S.MAX_LIMIT_TIER_1)))
    g = guardrail_columns(cols, ml_score, initial_limit)
    return {
        "ml_probability": p,
        "ml_score": ml_score,
        "final_score": g["final_score"],
        "decision": g["decision"],
        "max_credit_limit": g["max_credit_limit"],
        "risk_warnings": g["risk_warnings"],
        "model_used": F.lit(S.MODEL_USED_COLD),
        "note": F.lit(S.NOTE_COLD),
    }


def established_limit(score: Column, income: Column) -> Column:
    """Limit of the full model (F14), truncated to int."""
    return (F.when(score >= 750, F.least(income * F.lit(1.0), F.lit(float(S.MAX_LIMIT_TIER_3))))
            .when(score >= 650, F.least(income * F.lit(0.5), F.lit(float(S.MAX_LIMIT_TIER_3))))
            .when(score >= 550, F.least(income * F.lit(0.25), F.lit(20000.0)))
            .otherwise(F.lit(0.0))).cast("int")


def established_columns(cols: list[str], prob: Column) -> dict[str, Column]:
    """Full-model scoring record (F15) for a full-model probability column."""
    p = with_fallback(prob)
    score = prob_to_score(p)
    return {
        "ml_probability": p,
        "final_score": score,
        "decision": score_to_decision(score),
        "max_credit_limit": established_limit(score, _income(cols)),
        "model_used": F.lit(S.MODEL_USED_FULL),
        "note": F.lit(S.NOTE_FULL),
    }


def blended_columns(cols: list[str], cold: dict[str, Column], full: dict[str, Column]) -> dict[str, Column]:
    """Tier-2 blend (F16): 40% cold + 60% full for score (truncated) and probability."""
    score = (F.lit(S.BLEND_COLD_WEIGHT) * cold["final_score"]
             + F.lit(S.BLEND_FULL_WEIGHT) * full["final_score"]).cast("int")
    prob = (F.lit(S.BLEND_COLD_WEIGHT) * cold["ml_probability"]
            + F.lit(S.BLEND_FULL_WEIGHT) * full["ml_probability"])
    limit = F.least(_income(cols) * F.lit(0.5), F.lit(float(S.MAX_LIMIT_TIER_2))).cast("int")
    return {
        "ml_probability": prob,
        "final_score": score,
        "decision": score_to_decision(score),
        "max_credit_limit": limit,
        "model_used": F.lit(S.MODEL_USED_BLEND),
    }


# ---------------------------------------------------------------------------
# rule scorecard
# ---------------------------------------------------------------------------

def _map_points(value: Column, mapping: dict[str, int], default: int) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(value == k, F.lit(v)) if expr is None else expr.when(value == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def scorecard_columns(cols: list[str]) -> dict[str, Column]:
    """Rule-based cold-start score, limit, decision and income grade."""
    income = _income(cols)
    employment = field(cols, "employment_status", "Unknown")
    education = field(cols, "education_level", "Unknown")
    residence = field(cols, "residence_type", "Unknown")
    city = field(cols, "city_tier", "Unknown")
    age = field(cols, "age", 30)
    dependents = field(cols, "dependents", 0)

    income_pts = None
    grade = None
    for cut, pts, label in S.SCORECARD_INCOME:
        income_pts = F.when(income >= cut, F.lit(pts)) if income_pts is None else income_pts.when(income >= cut, F.lit(pts))
        grade = F.when(income >= cut, F.lit(label)) if grade is None else grade.when(income >= cut, F.lit(label))
    income_pts = income_pts.otherwise(F.lit(S.SCORECARD_INCOME_ELSE[0]))
    grade = grade.otherwise(F.lit(S.SCORECARD_INCOME_ELSE[1]))
    age_pts = (F.when((age >= 25) & (age <= 55), F.lit(20))
               .when(((age >= 21) & (age < 25)) | ((age > 55) & (age <= 65)), F.lit(10))
               .otherwise(F.lit(0)))
    raw = (F.lit(S.SCORECARD_BASE) + income_pts
           + _map_points(employment, S.SCORECARD_EMPLOYMENT, S.SCORECARD_EMPLOYMENT_ELSE)
           + _map_points(education, S.SCORECARD_EDUCATION, S.SCORECARD_EDUCATION_ELSE)
           + _map_points(residence, S.SCORECARD_RESIDENCE, S.SCORECARD_RESIDENCE_ELSE)
           + _map_points(city, S.SCORECARD_CITY, S.SCORECARD_CITY_ELSE)
           + age_pts
           - dependents * S.SCORECARD_DEPENDENT_PENALTY)
    score = F.greatest(F.lit(S.SCORE_MIN), F.least(F.lit(S.SCORE_MAX), raw)).cast("int")
    limit = (F.when(score >= 750, F.least(income * F.lit(0.5), F.lit(50000.0)))
             .when(score >= 650, F.least(income * F.lit(0.25), F.lit(15000.0)))
             .when(score >= 550, F.least(income * F.lit(0.1), F.lit(5000.0)))
             .otherwise(F.lit(0.0))).cast("int")
    return {
        "rule_based_score": score,
        "credit_limit": limit,
        "decision": score_to_decision(score),
        "income_grade": grade,
    }


# ---------------------------------------------------------------------------
# surrogate probabilities (deterministic stand-ins for a learned model, so the
# policy has exact oracles): full p = risk_score / 100, cold p = (900 - rule score) / 600
# ---------------------------------------------------------------------------

def surrogate_full_probability(risk_score: Column | None = None) -> Column:
    r = F.col("risk_score") if risk_score is None else risk_score
    return r / F.lit(100.0)


def surrogate_cold_probability(cols: list[str]) -> Column:
    score = scorecard_columns(cols)["rule_based_score"]
    return (F.lit(float(S.SCORE_MAX)) - score) / F.lit(float(S.SCORE_SPAN))


# ---------------------------------------------------------------------------
# validation (P7) and defaults (P10)
# ---------------------------------------------------------------------------

STATIC_RULES, BEHAVIOURAL_RULES = S.STATIC_RULES, S.BEHAVIOURAL_RULES


def violations_column(cols: list[str], rules) -> Column:
    """array<string> of violated rules: '<field>: missing', '<field>: below <lo>',
    '<field>: above <hi>' — empty when the record is valid."""
    checks = []
    for name, lo, hi in rules:
        if name not in cols:
            checks.append(F.lit(f"{name}: missing"))
            continue
        c = F.col(name)
        checks.append(F.when(c.isNull(), F.lit(f"{name}: missing")))
        if lo is not None:
            checks.append(F.when(c < lo, F.lit(f"{name}: below {lo}")))
        if hi is not None:
            checks.append(F.when(c > hi, F.lit(f"{name}: above {hi}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split records into (valid, quarantine); quarantine rows carry ``violations``."""
    rules = STATIC_RULES + (BEHAVIOURAL_RULES if full else [])
    tagged = df.withColumn("violations", violations_column(df.columns, rules))
    valid = tagged.where(F.size("violations") == 0).drop("violations")
    quarantine = tagged.where(F.size("violations") > 0)
    return valid, quarantine


def fill_defaults(df: DataFrame, defaults: dict | None = None, feature_order: list[str] | None = None,
                  audit_variant: bool = False) -> DataFrame:
    """Neutral behavioural defaults before full-model scoring (P10): present
    columns keep their values, NULLs too (the model's imputer fills them), absent ones
    get the literal; the result is ordered as the model's feature list. The audit variant uses
    snapshot month 4 and affordability = income / 1 when income > 0."""
    d = dict(defaults or S.NEUTRAL_DEFAULTS)
    if audit_variant:
        d["snapshot_month"] = S.AUDIT_SNAPSHOT_MONTH_DEFAULT
    cols = df.columns
    filled = {}
    for name, v in d.items():
        lit = F.lit(v)
        filled[name] = F.col(name) if name in cols else lit
    if audit_variant:
        inc = field(cols, "monthly_income", 0)
        filled["income_affordability_score"] = F.when(
            inc > 0, inc.cast("double") / F.lit(1.0)).otherwise(filled["income_affordability_score"])
    out = df.withColumns(filled)
    order = feature_order or S.ALL_FEATURES
    keep = [c for c in cols if c not in order]
    return out.select(*keep, *[c for c in order if c in out.columns])


def route(df: DataFrame, cold_prob: Column, full_prob: Column, keep: list[str] | None = None,
          zero_on_reject: bool = False) -> DataFrame:
    """The tier router (F17) as staged projections: probabilities and scores,
    then the cold guardrails, then the blend, then the per-tier pick. Each
    stage references the previous stage's columns, so the generated code stays
    small (one flat expression for all tiers exceeds the 64 KB method limit and
    falls back to interpreted evaluation). A rejected request keeps the limit of its tier's rule;
    ``zero_on_reject`` makes it 0 in all tiers."""
    cols = df.columns
    x = df.withColumns({
        "_pc": with_fallback(cold_prob), "_pf": with_fallback(full_prob),
        "_tier": customer_tier(field(cols, "account_age_months", 0).cast("int")),
        "_acct": field(cols, "account_age_months", 0).cast("int"),
    })
    x = x.withColumns({
        "_ms": prob_to_score(F.col("_pc")), "_fs": prob_to_score(F.col("_pf")),
        "_lim0": F.least(_income(cols) * F.lit(0.3), F.lit(float(S.MAX_LIMIT_TIER_1))),
    })
    g = guardrail_columns(cols, F.col("_ms"), F.col("_lim0"))
    x = x.withColumns({"_cs": g["final_score"], "_cl": g["max_credit_limit"], "_cw": g["risk_warnings"],
                       "_flim": established_limit(F.col("_fs"), _income(cols)),
                       "_blim": F.least(_income(cols) * F.lit(0.5), F.lit(float(S.MAX_LIMIT_TIER_2))).cast("int")})
    x = x.withColumns({
        "_bs": (F.lit(S.BLEND_COLD_WEIGHT) * F.col("_cs") + F.lit(S.BLEND_FULL_WEIGHT) * F.col("_fs")).cast("int"),
        "_bp": F.lit(S.BLEND_COLD_WEIGHT) * F.col("_pc") + F.lit(S.BLEND_FULL_WEIGHT) * F.col("_pf"),
    })
    t = F.col("_tier")

    def pick(c1, c2, c3):
        return F.when(t == 1, c1).when(t == 2, c2).otherwise(c3)

    score = pick(F.col("_cs"), F.col("_bs"), F.col("_fs"))
    limit = pick(F.col("_cl"), F.col("_blim"), F.col("_flim"))
    if zero_on_reject:
        limit = F.when(score_to_decision(score) == S.DECISIONS[-1], F.lit(0)).otherwise(limit)
    null_s = F.lit(None).cast("string")
    out = {
        "customer_tier": t,
        "tier_description": tier_description(t),
        "account_age_months": F.col("_acct"),
        "ml_probability": pick(F.col("_pc"), F.col("_bp"), F.col("_pf")),
        "ml_score": F.when(t == 1, F.col("_ms")),
        "final_score": score,
        "decision": score_to_decision(score),
        "max_credit_limit": limit,
        "risk_warnings": F.when(t == 1, F.col("_cw")),
        "model_used": pick(F.lit(S.MODEL_USED_COLD), F.lit(S.MODEL_USED_BLEND), F.lit(S.MODEL_USED_FULL)),
        "note": F.when(t == 1, F.lit(S.NOTE_COLD)).when(t == 3, F.lit(S.NOTE_FULL)).otherwise(null_s),
        "recommendation": pick(F.lit(S.RECOMMEND_TIER_1), F.lit(S.RECOMMEND_TIER_2), F.lit(S.RECOMMEND_TIER_3)),
    }
    return x.select(*(keep or []), *[v.alias(k) for k, v in out.items()])
