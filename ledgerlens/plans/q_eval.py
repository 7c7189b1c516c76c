"""Evaluation, statistics and split queries.

The evaluation frame is the stratified 20% hold-out of the snapshot table
scored with the surrogate full-model probability p = risk_score / 100, so
every metric has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import policy as P
from ..operators import metrics as M
from ..operators import splits as SP
from ..operators import stats as ST
from . import oracle as O
from .catalog import _round, query, snapshots
from .q_scoring import sql_decision, sql_p2s

SPLIT_KEYS = ["customer_id", "snapshot_month"]


def split_snapshots(spark, sf_dir) -> DataFrame:
    """Snapshot table + stored ``is_test`` column (written once, then read)."""
    from .catalog import SNAPSHOT_INPUTS
    from .materialize import materialized
    return materialized(spark, "snapshot_split", sf_dir, SNAPSHOT_INPUTS,
                        lambda: SP.stratified_split(snapshots(spark, sf_dir), S.LABEL, SPLIT_KEYS, 0.2, 42))


def eval_frame(spark, sf_dir) -> DataFrame:
    test = split_snapshots(spark, sf_dir).where("is_test")
    p = P.surrogate_full_probability()
    score = C.prob_to_score(p)
    return test.select("customer_id", "snapshot_month", F.col(S.LABEL).alias("y"), p.alias("p"),
                       (p >= 0.5).cast("int").alias("pred"), score.alias("score"),
                       C.score_to_decision(score).alias("decision"))


SPLIT_CTES = f"""{O.snapshot_ctes()},
spl AS (SELECT *, ('0x' || substr(md5(customer_id::VARCHAR || '|' || snapshot_month::VARCHAR || '|42'), 1, 8))::BIGINT
                  / 4294967296e0 AS u FROM snapshots),
spr AS (SELECT *, row_number() OVER (PARTITION BY default_next_1m ORDER BY u, customer_id, snapshot_month) AS srn,
               count(*) OVER (PARTITION BY default_next_1m) AS sn FROM spl),
splitted AS (SELECT *, srn <= round(sn * 0.2e0) AS is_test FROM spr),
evalf AS (SELECT customer_id, snapshot_month, default_next_1m AS y, risk_score / 100e0 AS p,
    (CASE WHEN risk_score / 100e0 >= 0.5e0 THEN 1 ELSE 0 END)::INTEGER AS pred,
    {sql_p2s('risk_score / 100e0')} AS score, {sql_decision(sql_p2s('risk_score / 100e0'))} AS decision
  FROM splitted WHERE is_test),
conf AS (SELECT
    count(*) FILTER (WHERE y = 0 AND pred = 0)::BIGINT AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1)::BIGINT AS fp,
    count(*) FILTER (WHERE y = 1 AND pred = 0)::BIGINT AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1)::BIGINT AS tp
  FROM evalf),
sc AS (SELECT p AS score, count(*) FILTER (WHERE y = 1)::BIGINT AS pos, count(*) FILTER (WHERE y = 0)::BIGINT AS neg
  FROM evalf GROUP BY p),
scd AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
                  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg,
                  sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg FROM sc)"""


def with_eval(body: str) -> str:
    return f"WITH {SPLIT_CTES}\n{body}"


def _d(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0e0 ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


# ------------------------------- splits -------------------------------

@query("split_stratified", with_eval("SELECT customer_id, snapshot_month, is_test FROM splitted"))
def q_split_stratified(spark, sf_dir):
    return split_snapshots(spark, sf_dir).select("customer_id", "snapshot_month", "is_test")


@query("split_hash", O.with_snapshots("""
SELECT customer_id, snapshot_month,
  ('0x' || substr(md5(customer_id::VARCHAR || '|' || snapshot_month::VARCHAR || '|42'), 1, 8))::BIGINT / 4294967296e0 < 0.2e0 AS is_test
FROM snapshots"""))
def q_split_hash(spark, sf_dir):
    return SP.hash_split(snapshots(spark, sf_dir), SPLIT_KEYS, 0.2, 42).select(
        "customer_id", "snapshot_month", "is_test")


# ------------------------------- metrics -------------------------------

@query("confusion", with_eval("SELECT tn, fp, fn, tp FROM conf"))
def q_confusion(spark, sf_dir):
    return M.confusion(eval_frame(spark, sf_dir))


@query("binary_metrics", with_eval(f"""
SELECT {_d('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_d('tp', 'tp + fp')} AS precision,
  {_d('tp', 'tp + fn')} AS recall, {_d('2e0 * tp', '2 * tp + fp + fn')} AS f1 FROM conf"""))
def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(eval_frame(spark, sf_dir))


@query("classification_report", with_eval(f"""
, cr AS (SELECT {_d('tn', 'tn + fn')} AS p0, {_d('tn', 'tn + fp')} AS r0, {_d('2e0 * tn', '2 * tn + fp + fn')} AS f0, tn + fp AS s0,
    {_d('tp', 'tp + fp')} AS p1, {_d('tp', 'tp + fn')} AS r1, {_d('2e0 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1 FROM conf)
SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM cr
UNION ALL SELECT '1', p1, r1, f1, s1 FROM cr
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM cr
UNION ALL SELECT 'weighted avg', {_d('p0 * s0 + p1 * s1', 's0 + s1')}, {_d('r0 * s0 + r1 * s1', 's0 + s1')},
  {_d('f0 * s0 + f1 * s1', 's0 + s1')}, s0 + s1 FROM cr""".replace("WITH", "WITH", 1).replace(
    "\n, cr AS", ",\ncr AS", 1)))
def q_classification_report(spark, sf_dir):
    return M.classification_report(eval_frame(spark, sf_dir))


@query("roc_auc", with_eval("""
, sca AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)
SELECT round(sum(pos * (below + 0.5e0 * neg)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 12) AS roc_auc FROM sca""".replace(
    "\n, sca AS", ",\nsca AS", 1)))
def q_roc_auc(spark, sf_dir):
    return _round(M.roc_auc(eval_frame(spark, sf_dir)), {"roc_auc": 12})


@query("roc_curve", with_eval(f"""
SELECT score AS threshold, {_d('cneg', 'tneg')} AS fpr, {_d('cpos', 'tpos')} AS tpr FROM scd
UNION ALL SELECT 'infinity'::DOUBLE, 0e0, 0e0"""))
def q_roc_curve(spark, sf_dir):
    return M.roc_curve(eval_frame(spark, sf_dir))


@query("pr_curve", with_eval(f"""
SELECT score AS threshold, {_d('cpos', 'cpos + cneg')} AS precision, {_d('cpos', 'tpos')} AS recall FROM scd
UNION ALL SELECT NULL::DOUBLE, 1e0, 0e0"""))
def q_pr_curve(spark, sf_dir):
    return M.pr_curve(eval_frame(spark, sf_dir))


@query("average_precision", with_eval("""
SELECT round(CASE WHEN max(tpos) = 0 THEN 0e0 ELSE sum(pos * (cpos::DOUBLE / (cpos + cneg)::DOUBLE)) / max(tpos) END, 12)
  AS average_precision FROM scd"""))
def q_average_precision(spark, sf_dir):
    return _round(M.average_precision(eval_frame(spark, sf_dir)), {"average_precision": 12})


@query("log_loss", with_eval("""
SELECT round(avg(-(y::DOUBLE * ln(greatest(2.220446049250313e-16, least(1e0 - 2.220446049250313e-16, p)))
  + (1e0 - y::DOUBLE) * ln(1e0 - greatest(2.220446049250313e-16, least(1e0 - 2.220446049250313e-16, p))))), 12) AS log_loss
FROM evalf"""))
def q_log_loss(spark, sf_dir):
    return _round(M.log_loss(eval_frame(spark, sf_dir)), {"log_loss": 12})


def _sweep_sql() -> str:
    parts = []
    for t in S.THRESHOLDS:
        ts = f"{t}e0"
        tp = f"count(*) FILTER (WHERE p >= {ts} AND y = 1)"
        fp = f"count(*) FILTER (WHERE p >= {ts} AND y = 0)"
        fn = f"count(*) FILTER (WHERE p < {ts} AND y = 1)"
        acc = f"count(*) FILTER (WHERE p < {ts})"
        parts.append(f"SELECT {ts} AS threshold, {_d(tp, f'{tp} + {fp}')} AS precision, "
                     f"{_d(tp, f'{tp} + {fn}')} AS recall, {_d(f'2e0 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, "
                     f"{_d(acc, 'count(*)')} * 100e0 AS accept_rate FROM evalf")
    return "\nUNION ALL ".join(parts)


@query("threshold_sweep", with_eval(_sweep_sql()))
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(eval_frame(spark, sf_dir))


@query("metric_gate", with_eval(f"""
, sca AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc),
auc AS (SELECT round(sum(pos * (below + 0.5e0 * neg)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 12) AS roc_auc FROM sca),
rec AS (SELECT {_d('tp', 'tp + fn')} AS recall FROM conf)
SELECT roc_auc, recall, roc_auc >= 0.7e0 AS auc_ok, recall >= 0.7e0 AS recall_ok,
  roc_auc >= 0.7e0 AND recall >= 0.7e0 AS model_good FROM auc, rec""".replace("\n, sca AS", ",\nsca AS", 1)))
def q_metric_gate(spark, sf_dir):
    ev = eval_frame(spark, sf_dir)
    return M.metric_gate(_round(M.roc_auc(ev), {"roc_auc": 12}), M.binary_metrics(ev))


def _decision_sql(rate: bool) -> str:
    parts = []
    for i, d in enumerate(S.DECISIONS):
        c = f"count(*) FILTER (WHERE decision = '{d}')"
        extra = (f", {_d(f'count(*) FILTER (WHERE decision = {chr(39)}{d}{chr(39)} AND y = 1)', c)} * 100e0 AS default_rate"
                 if rate else "")
        pos = "" if rate else f"{i + 1} AS position, "
        parts.append(f"SELECT {pos}'{d}' AS decision, {c}::BIGINT AS n_rows, {_d(c, 'count(*)')} * 100e0 AS pct{extra} FROM evalf")
    return "\nUNION ALL ".join(parts)


@query("decision_distribution", with_eval(_decision_sql(False)))
def q_decision_distribution(spark, sf_dir):
    return M.decision_distribution(eval_frame(spark, sf_dir))


@query("default_rate_by_decision", with_eval(_decision_sql(True)))
def q_default_rate_by_decision(spark, sf_dir):
    return M.default_rate_by_decision(eval_frame(spark, sf_dir))


@query("decile_table", with_eval("""
, edges AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM evalf)
SELECT len(list_filter(e, lambda x: x < p))::INTEGER AS decile, count(*)::BIGINT AS n_rows,
  round(avg(y), 12) AS default_rate
FROM evalf, edges GROUP BY 1""".replace("\n, edges AS", ",\nedges AS", 1)))
def q_decile_table(spark, sf_dir):
    return _round(M.decile_table(eval_frame(spark, sf_dir)), {"default_rate": 12})


@query("score_hist_by_label", with_eval("""
, rng AS (SELECT y, min(score)::DOUBLE AS mn, max(score)::DOUBLE AS mx FROM evalf GROUP BY y)
SELECT e.y AS label, (CASE WHEN mx = mn THEN 15 ELSE least(floor((score::DOUBLE - mn) / (mx - mn) * 30e0), 29) END)::INTEGER AS bin,
  count(*)::BIGINT AS n_rows
FROM evalf e JOIN rng r ON e.y = r.y GROUP BY 1, 2""".replace("\n, rng AS", ",\nrng AS", 1)))
def q_score_hist_by_label(spark, sf_dir):
    return M.score_hist_by_label(eval_frame(spark, sf_dir))


@query("score_range", with_eval("""
SELECT min(score) AS min_score, max(score) AS max_score, round(stddev_samp(score), 9) AS std_score FROM evalf"""))
def q_score_range(spark, sf_dir):
    return _round(ST.score_range(eval_frame(spark, sf_dir), "score"), {"std_score": 9})


# ------------------------------- statistics -------------------------------

def _cat_cols(spark, sf_dir):
    return ST.categorical_columns(snapshots(spark, sf_dir))


@query("value_counts", O.with_snapshots("""
SELECT "column", value, count(*)::BIGINT AS count FROM (
  UNPIVOT (SELECT employment_status, education_level, city_tier, residence_type FROM snapshots)
  ON employment_status, education_level, city_tier, residence_type INTO NAME "column" VALUE value)
WHERE value IS NOT NULL GROUP BY 1, 2"""))
def q_value_counts(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    return ST.value_counts(snap, ST.categorical_columns(snap))


def _numeric_snapshot_cols():
    from ..operators.features import PROFILE_COLUMNS, SNAPSHOT_FEATURES
    cols = ["snapshot_month", *SNAPSHOT_FEATURES, S.LABEL, *PROFILE_COLUMNS]
    return [c for c in cols if c not in S.CATEGORICAL_STATIC]


def _long_sql(cols) -> str:
    sel = ", ".join(f"{c}::DOUBLE AS {c}" for c in cols)
    return (f'(UNPIVOT (SELECT {sel} FROM snapshots) ON {", ".join(cols)} '
            f'INTO NAME "column" VALUE value)')


@query("describe", O.with_snapshots(f"""
SELECT "column", count(value)::BIGINT AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, round(quantile_cont(value, 0.25), 9) AS p25, round(quantile_cont(value, 0.5), 9) AS p50,
  round(quantile_cont(value, 0.75), 9) AS p75, max(value) AS max
FROM {_long_sql(_numeric_snapshot_cols())} WHERE value IS NOT NULL GROUP BY 1"""))
def q_describe(spark, sf_dir):
    snap = snapshots(spark, sf_dir)
    d = ST.describe(snap, _numeric_snapshot_cols())
    return _round(d, {"mean": 6, "std": 6, "p25": 9, "p50": 9, "p75": 9})


@query("box_stats", O.with_snapshots("""
, q AS (SELECT quantile_cont(max_outstanding_3m, 0.25) AS q1, quantile_cont(max_outstanding_3m, 0.75) AS q3 FROM snapshots),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS lower_fence, q3 + 1.5e0 * (q3 - q1) AS upper_fence FROM q)
SELECT round(q1, 9) AS q1, round(q3, 9) AS q3, round(iqr, 9) AS iqr, round(lower_fence, 9) AS lower_fence,
  round(upper_fence, 9) AS upper_fence,
  min(CASE WHEN max_outstanding_3m >= lower_fence THEN max_outstanding_3m END) AS lower_whisker,
  max(CASE WHEN max_outstanding_3m <= upper_fence THEN max_outstanding_3m END) AS upper_whisker
FROM snapshots, f GROUP BY q1, q3, iqr, lower_fence, upper_fence""".replace("\n, q AS", ",\nq AS", 1)))
def q_box_stats(spark, sf_dir):
    b = ST.box_stats(snapshots(spark, sf_dir), "max_outstanding_3m")
    return _round(b, {k: 9 for k in ("q1", "q3", "iqr", "lower_fence", "upper_fence")})


def _edges_sql() -> str:
    parts = []
    for c, edges in S.HISTOGRAM_EDGES.items():
        cases = []
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            op = "<=" if i == len(edges) - 2 else "<"
            cases.append(f"WHEN {c} >= {lo}e0 AND {c} {op} {hi}e0 THEN {i}")
        parts.append(f"SELECT '{c}' AS \"column\", CASE {' '.join(cases)} END AS bin FROM snapshots")
    return "SELECT \"column\", bin::INTEGER AS bin, count(*)::BIGINT AS count FROM (\n" + \
        "\nUNION ALL ".join(parts) + ") WHERE bin IS NOT NULL GROUP BY 1, 2"


@query("histogram_edges", O.with_snapshots(_edges_sql()))
def q_histogram_edges(spark, sf_dir):
    return ST.histogram_edges(snapshots(spark, sf_dir), S.HISTOGRAM_EDGES)


@query("histogram_equal", O.with_snapshots(f"""
, lng AS (SELECT * FROM {_long_sql(S.CONTINUOUS_COLUMNS)} WHERE value IS NOT NULL),
rng AS (SELECT "column", min(value) AS mn, max(value) AS mx FROM lng GROUP BY 1)
SELECT l."column", (CASE WHEN mx = mn THEN 10 ELSE least(floor((value - mn) / (mx - mn) * 20e0), 19) END)::INTEGER AS bin,
  count(*)::BIGINT AS count
FROM lng l JOIN rng r ON l."column" = r."column" GROUP BY 1, 2""".replace("\n, lng AS", ",\nlng AS", 1)))
def q_histogram_equal(spark, sf_dir):
    return ST.histogram_equal(snapshots(spark, sf_dir), S.CONTINUOUS_COLUMNS)


def _corr_cols():
    return [c for c in _numeric_snapshot_cols()]


def _corr_sql() -> str:
    cols = _corr_cols()
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM snapshots")
    return "\nUNION ALL ".join(parts)


@query("correlation", O.with_snapshots(_corr_sql()))
def q_correlation(spark, sf_dir):
    c = ST.correlation(snapshots(spark, sf_dir), _corr_cols())
    return c.select("col_a", "col_b", F.round(F.when(F.isnan("corr"), None).otherwise(F.col("corr")), 6).alias("corr"))


@query("sample_hash", O.with_snapshots("""
SELECT customer_id, snapshot_month, md5(customer_id::VARCHAR || '|' || snapshot_month::VARCHAR || '|42') AS sample_key
FROM snapshots ORDER BY sample_key, customer_id, snapshot_month LIMIT 1000"""))
def q_sample_hash(spark, sf_dir):
    return ST.sample_hash(snapshots(spark, sf_dir), SPLIT_KEYS, 1000, 42).select(
        "customer_id", "snapshot_month", "sample_key")


def demo_output(spark, sf_dir) -> DataFrame:
    """(demo_customer_id 1..n, credit_score, final_decision) of the hold-out in
    key order (P13); ids from a distributed running count."""
    ids = ST.row_ids(eval_frame(spark, sf_dir), ["customer_id", "snapshot_month"], "demo_customer_id")
    return ids.select("demo_customer_id", F.col("score").alias("credit_score"),
                      F.col("decision").alias("final_decision"))


@query("demo_output", with_eval("""
SELECT row_number() OVER (ORDER BY customer_id, snapshot_month)::BIGINT AS demo_customer_id,
  score AS credit_score, decision AS final_decision FROM evalf"""))
def q_demo_output(spark, sf_dir):
    return demo_output(spark, sf_dir)


@query("demo_head", with_eval("""
SELECT * FROM (SELECT row_number() OVER (ORDER BY customer_id, snapshot_month)::BIGINT AS demo_customer_id,
  score AS credit_score, decision AS final_decision FROM evalf) ORDER BY demo_customer_id LIMIT 10"""))
def q_demo_head(spark, sf_dir):
    return ST.top_k(demo_output(spark, sf_dir), [F.col("demo_customer_id")], 10)


@query("split_grouped", O.with_snapshots("""
SELECT customer_id, snapshot_month,
  ('0x' || substr(md5(customer_id::VARCHAR || '|42'), 1, 8))::BIGINT / 4294967296e0 < 0.2e0 AS is_test
FROM snapshots"""))
def q_split_grouped(spark, sf_dir):
    """Customer-grouped split (D5): all months of a customer on one side, so
    no customer's history leaks from training into the hold-out."""
    return SP.grouped_split(snapshots(spark, sf_dir), "customer_id", 0.2, 42).select(
        "customer_id", "snapshot_month", "is_test")


@query("split_time", O.with_snapshots(
    "SELECT customer_id, snapshot_month, snapshot_month >= 22 AS is_test FROM snapshots"))
def q_split_time(spark, sf_dir):
    """Time-based split (D5): the last periods are the hold-out."""
    return SP.time_split(snapshots(spark, sf_dir), "snapshot_month", 22).select(
        "customer_id", "snapshot_month", "is_test")


@query("value_counts_discrete", O.with_snapshots(f"""
SELECT "column", value, count(*)::BIGINT AS count FROM (
  UNPIVOT (SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in S.DISCRETE_COLUMNS)} FROM snapshots)
  ON {', '.join(S.DISCRETE_COLUMNS)} INTO NAME "column" VALUE value)
WHERE value IS NOT NULL GROUP BY 1, 2"""))
def q_value_counts_discrete(spark, sf_dir):
    """Counts of the discrete columns (A3, the count plots), one unpivot pass."""
    return ST.value_counts(snapshots(spark, sf_dir), S.DISCRETE_COLUMNS)
