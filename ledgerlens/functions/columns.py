"""Column-returning helpers — the UDF surface of the library.

All of these are native Catalyst expressions (CASE / arithmetic), so they stay
inside whole-stage codegen; none runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: Column | str, b: Column | str, default: float | int = 0) -> Column:
    """a / b, or ``default`` when b is NULL or 0 (F1). ANSI-safe: the division
    is only evaluated on the non-zero branch."""
    a, b = col_(a), col_(b)
    return F.when(b.isNull() | (b == 0), F.lit(default)).otherwise(a / b)


def prob_to_score(p: Column | str) -> Column:
    """Probability -> 300..900 score, truncated like Python ``int`` (F2)."""
    p = col_(p)
    raw = F.lit(float(S.SCORE_MAX)) - p * F.lit(float(S.SCORE_SPAN))
    return F.greatest(F.lit(float(S.SCORE_MIN)), F.least(F.lit(float(S.SCORE_MAX)), raw)).cast("int")


def score_to_decision(score: Column | str) -> Column:
    """Score -> lending decision ladder."""
    score = col_(score)
    expr = None
    for cut, label in S.DECISION_CUTS:
        expr = F.when(score >= cut, F.lit(label)) if expr is None else expr.when(score >= cut, F.lit(label))
    return expr.otherwise(F.lit("Reject"))


def customer_tier(account_age: Column | str) -> Column:
    """Tier from account age: <=3 -> 1, <=6 -> 2, else 3."""
    a = col_(account_age)
    return (F.when(a <= S.TIER_1_MAX_MONTHS, F.lit(1))
            .when(a <= S.TIER_2_MAX_MONTHS, F.lit(2)).otherwise(F.lit(3)))


def tier_description(tier: Column | str) -> Column:
    t = col_(tier)
    return (F.when(t == 1, F.lit(S.TIER_DESCRIPTIONS[1]))
            .when(t == 2, F.lit(S.TIER_DESCRIPTIONS[2])).otherwise(F.lit(S.TIER_DESCRIPTIONS[3])))


def debt_burden_category(pct: Column | str) -> Column:
    """<10 -> 0, <30 -> 1, <50 -> 2, else 3; a missing value falls to 3."""
    p = col_(pct)
    return (F.when(p < 10, F.lit(0)).when(p < 30, F.lit(1)).when(p < 50, F.lit(2))
            .otherwise(F.lit(3)))


def account_age_bucket(months: Column | str) -> Column:
    """<6 -> 0, <24 -> 1, else 2."""
    m = col_(months)
    return F.when(m < 6, F.lit(0)).when(m < 24, F.lit(1)).otherwise(F.lit(2))


def risk_band(risk: Column | str) -> Column:
    """0–20 safe, 20–50 caution, 50+ high; lower bound inclusive."""
    r = col_(risk)
    return (F.when(r < 20, F.lit("safe")).when(r < 50, F.lit("caution"))
            .when(r >= 50, F.lit("high")))


def log1p_(c: Column | str) -> Column:
    """log1p (F22): Spark gives NULL for x <= -1 where numpy gives NaN/-inf."""
    return F.log1p(col_(c))


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 where an unknown comparison counts as false, like a NaN
    comparison in pandas."""
    return F.coalesce(cond, F.lit(False)).cast("int")
