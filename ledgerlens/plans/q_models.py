"""Model queries (M1–M19, S12, S13, A27, T2, T3) — learned models, so the
row-level results have no exact oracle (rows-only check), except the
preprocessing fits (medians, scaling, one-hot, class weights), which do.

Fitted roles are memoised by the stored split table they were fitted on, so the
queries of one session do not refit the same model, and new input does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import policy as P
from ..operators import audit as AU
from ..operators import model_tables as MT
from ..operators import models as MD
from ..operators import prep as PR
from ..operators import stats as ST
from ..operators.order_stats import written
from ..session import side_by_side, warehouse_path
from . import oracle as O
from .catalog import _round, query, snapshots
from .q_eval import SPLIT_CTES, SPLIT_KEYS, split_snapshots

_FIT_CACHE: dict = {}


def _split(spark, sf_dir):
    s = split_snapshots(spark, sf_dir)
    return s.where(~F.col("is_test")).drop("is_test"), s.where("is_test").drop("is_test")


def _fit_key(spark, sf_dir, role: str) -> tuple:
    table = split_snapshots(spark, sf_dir)
    return spark.sparkContext.applicationId, table.inputFiles()[0].rsplit("/", 1)[0], role


def trained_role(spark, sf_dir, role: str) -> tuple[dict[str, MD.Fitted], str]:
    key = _fit_key(spark, sf_dir, role)
    if key not in _FIT_CACHE:
        train, test = _split(spark, sf_dir)
        _FIT_CACHE[key] = MD.train_role(train, test, role)
    return _FIT_CACHE[key]


def trained_roles(spark, sf_dir) -> list[tuple[dict[str, MD.Fitted], str]]:
    """``trained_role`` of both roles, side by side."""
    split_snapshots(spark, sf_dir)      # stored once, before the threads
    return side_by_side(spark, [lambda role=role: trained_role(spark, sf_dir, role) for role in ("cold", "full")])


def fitted(spark, sf_dir, role: str, name: str | None = None) -> MD.Fitted:
    """A candidate of the role, by default the selected one. A candidate that is named doesn't depend on the others: it is
    fitted alone where the role isn't trained yet."""
    key = _fit_key(spark, sf_dir, role)
    if name is None or key in _FIT_CACHE:
        fits, best = trained_role(spark, sf_dir, role)
        return fits[name or best]
    if (*key, name) not in _FIT_CACHE:
        train, _ = _split(spark, sf_dir)
        _FIT_CACHE[(*key, name)] = MD.fit_candidate(train, role, name)
    return _FIT_CACHE[(*key, name)]


# ------------------------------- preprocessing (exact) -------------------------------

def _train_numeric():
    return [c for c in S.ALL_FEATURES if c not in S.CATEGORICAL_STATIC]


def _train_long_sql(cols) -> str:
    sel = ", ".join(f"{c}::DOUBLE AS {c}" for c in cols)
    return (f'(UNPIVOT (SELECT {sel} FROM splitted WHERE NOT is_test) ON {", ".join(cols)} '
            f'INTO NAME "column" VALUE value)')


@query("impute_median", f"""WITH {SPLIT_CTES}
SELECT "column", round(quantile_cont(value, 0.5), 9) AS median FROM {_train_long_sql(_train_numeric())}
WHERE value IS NOT NULL GROUP BY 1""")
def q_impute_median(spark, sf_dir):
    """Fitted medians of the numeric features on the training rows (M3)."""
    from ..operators.order_stats import exact_quantiles
    train, _ = _split(spark, sf_dir)
    long = ST.unpivot(train, _train_numeric())
    q = exact_quantiles(long, "value", [0.5], by=["column"])
    return q.select("column", F.round("quantile", 9).alias("median"))


def _with_gaps(df):
    """Some values missing, by key: the data itself has none."""
    return df.withColumns({"employment_status": F.when(F.col("customer_id") % 5 > 0, F.col("employment_status")),
                           "city_tier": F.when(F.col("customer_id") % 7 > 0, F.col("city_tier")),
                           "monthly_income": F.when(F.col("customer_id") % 3 > 0, F.col("monthly_income")),
                           "util_avg_3m": F.when(F.col("snapshot_month") % 4 > 0, F.col("util_avg_3m"))})


@query("impute_constant", O.with_snapshots("""
SELECT customer_id, snapshot_month,
  coalesce(employment_status, 'Unknown') AS employment_status, coalesce(education_level, 'Unknown') AS education_level,
  coalesce(city_tier, 'Unknown') AS city_tier, coalesce(residence_type, 'Unknown') AS residence_type,
  (employment_status IS NULL)::INTEGER AS employment_status_missing, (education_level IS NULL)::INTEGER AS education_level_missing,
  (city_tier IS NULL)::INTEGER AS city_tier_missing, (residence_type IS NULL)::INTEGER AS residence_type_missing
FROM (SELECT * REPLACE (CASE WHEN customer_id % 5 > 0 THEN employment_status END AS employment_status,
  CASE WHEN customer_id % 7 > 0 THEN city_tier END AS city_tier) FROM snapshots)"""))
def q_impute_constant(spark, sf_dir):
    """'Unknown' for missing categoricals plus missing indicators (M4)."""
    snap = _with_gaps(snapshots(spark, sf_dir)).select("customer_id", "snapshot_month", *S.CATEGORICAL_STATIC)
    return PR.ConstantImputer(inputCols=S.CATEGORICAL_STATIC, indicators=True).transform(snap)


@query("standardize", f"""WITH {SPLIT_CTES}
SELECT "column", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM {_train_long_sql(_train_numeric())} GROUP BY 1""")
def q_standardize(spark, sf_dir):
    """Fitted mean and population std per numeric feature (M5)."""
    train, _ = _split(spark, sf_dir)
    m = PR.PopulationScaler(inputCols=_train_numeric()).fit(train)
    rows = list(zip(m.getInputCols(), m.getOrDefault(m.means), m.getOrDefault(m.stds)))
    df = spark.createDataFrame(rows, "column string, mean double, std double")
    return _round(df, {"mean": 6, "std": 6})


@query("standardize_apply", f"""WITH {SPLIT_CTES},
st AS (SELECT avg(risk_score) AS m1, stddev_pop(risk_score) AS s1, avg(util_avg_3m) AS m2, stddev_pop(util_avg_3m) AS s2
       FROM splitted WHERE NOT is_test)
SELECT customer_id, snapshot_month,
  round((risk_score - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1e0 END, 6) AS risk_score_z,
  round((util_avg_3m - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1e0 END, 6) AS util_avg_3m_z
FROM splitted, st WHERE is_test""")
def q_standardize_apply(spark, sf_dir):
    """Scaling fitted on the training rows applied to the hold-out (M5)."""
    train, test = _split(spark, sf_dir)
    cols = ["risk_score", "util_avg_3m"]
    m = PR.PopulationScaler(inputCols=cols).fit(train)
    out = m.transform(test.select("customer_id", "snapshot_month", *cols))
    return out.select("customer_id", "snapshot_month",
                      *[F.round(c, 6).alias(f"{c}_z") for c in cols])


def _onehot_sql() -> str:
    from ..sources.fixtures import CITY_TIERS, EDUCATION_LEVELS, RESIDENCE_TYPES
    emp = ["Business", "Daily Wage", "Retired", "Salaried", "Self-Employed"]
    cats = {"employment_status": emp, "education_level": sorted(EDUCATION_LEVELS),
            "city_tier": sorted(CITY_TIERS), "residence_type": sorted(RESIDENCE_TYPES)}
    cols = []
    for c, vals in cats.items():
        for v in vals:
            cols.append(f"(CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END) AS \"{c}_{v}\"")
    return f"WITH {SPLIT_CTES}\nSELECT customer_id, snapshot_month, {', '.join(cols)} FROM splitted WHERE is_test"


@query("onehot_wide", _onehot_sql())
def q_onehot_wide(spark, sf_dir):
    """One-hot of the categoricals fitted on the training rows, sorted
    categories, unseen -> all zeros (M6), applied to the hold-out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array
    train, test = _split(spark, sf_dir)
    cats = S.CATEGORICAL_STATIC
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc")
              for c in cats]
    stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in cats], outputCols=[f"{c}__v" for c in cats],
                                dropLast=True))
    model = Pipeline(stages=stages).fit(train.select(*cats))
    out = model.transform(test.select("customer_id", "snapshot_month", *cats))
    sel = ["customer_id", "snapshot_month"]
    labels = {s.getInputCol(): s.labels for s in model.stages[:-1]}
    for c in cats:
        arr = vector_to_array(F.col(f"{c}__v"))
        sel += [arr[i].alias(f"{c}_{v}") for i, v in enumerate(labels[c])]
    return out.select(*sel)


@query("class_weights", f"""WITH {SPLIT_CTES}
SELECT default_next_1m, count(*)::BIGINT AS n_class,
  (sum(count(*)) OVER ())::DOUBLE / (2e0 * count(*)) AS weight
FROM splitted WHERE NOT is_test GROUP BY 1""")
def q_class_weights(spark, sf_dir):
    """Balanced class weights of the training rows (M8)."""
    train, _ = _split(spark, sf_dir)
    return PR.class_weights(train, S.LABEL)


# ------------------------------- training (rows-only) -------------------------------

@query("train_full_lr")
def q_train_full_lr(spark, sf_dir):
    """Standardised coefficients of the full logistic regression, by expanded feature."""
    f = fitted(spark, sf_dir, "full", "logistic_regression")
    names = PR.expanded_feature_names(f.model, f.categorical, f.numeric)
    rows = [*zip(names, map(float, f.model.stages[-1].coefficients.toArray()), strict=True), ("(intercept)", float(f.model.stages[-1].intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def _lr_gradient_sql() -> str:
    parts = []
    for role in ("cold", "full"):
        feats = MD.role_features(role)
        names = ["(intercept)", *[c for c in feats if c not in S.CATEGORICAL_STATIC]]
        parts.append(f"SELECT '{role}' AS role, unnest([{', '.join(map(repr, names))}]) AS feature")
        parts += [f"SELECT DISTINCT '{role}', '{c}_' || coalesce({c}, 'Unknown') FROM splitted WHERE NOT is_test"
                  for c in feats if c in S.CATEGORICAL_STATIC]
    return f"""WITH {SPLIT_CTES}
SELECT role, feature, (SELECT count(*) FROM splitted WHERE NOT is_test)::BIGINT AS n_train, true AS stationary
FROM ({' UNION ALL '.join(parts)})"""


@query("lr_gradient", _lr_gradient_sql())
def q_lr_gradient(spark, sf_dir):
    """Whether the objective's gradient over all training rows vanishes at the fitted coefficients (M9), per role and expanded feature."""
    train, _ = _split(spark, sf_dir)
    out = None
    for role in ("cold", "full"):
        g = MT.lr_gradient(spark, MD.fit_candidate(train, role, "logistic_regression"), train)
        g = g.select(F.lit(role).alias("role"), "feature", "n_train", (F.abs("gradient") <= MT.GRADIENT_BOUND).alias("stationary"))
        out = g if out is None else out.unionByName(g)
    return out


WALK_SQL = f"WITH {SPLIT_CTES}\nSELECT customer_id, snapshot_month, true AS agrees FROM splitted WHERE is_test"


@query("tree_walk_gbt", WALK_SQL)
def q_tree_walk_gbt(spark, sf_dir):
    """Hold-out rows whose score by joins over the boosted trees' nodes equals the model's."""
    _, test = _split(spark, sf_dir)
    return MT.walk_agreement(spark, fitted(spark, sf_dir, "full", "gradient_boosting"), test, SPLIT_KEYS, warehouse_path(spark, "node_tables"))


@query("tree_walk_rf", WALK_SQL)
def q_tree_walk_rf(spark, sf_dir):
    """Hold-out rows whose score by joins over the forest's nodes equals the model's."""
    _, test = _split(spark, sf_dir)
    return MT.walk_agreement(spark, fitted(spark, sf_dir, "full", "random_forest"), test, SPLIT_KEYS, warehouse_path(spark, "node_tables"))


@query("train_full_rf")
def q_train_full_rf(spark, sf_dir):
    """Impurity importance of the full random forest, by expanded feature."""
    return MD.feature_importance(spark, fitted(spark, sf_dir, "full", "random_forest"))


@query("train_full_gbt")
def q_train_full_gbt(spark, sf_dir):
    """Impurity importance of the full boosted trees, by expanded feature."""
    return MD.feature_importance(spark, fitted(spark, sf_dir, "full", "gradient_boosting"))


@query("train_cold")
def q_train_cold(spark, sf_dir):
    fits, best = trained_role(spark, sf_dir, "cold")
    return MD.comparison_frame(spark, fits, best)


@query("train_full")
def q_train_full(spark, sf_dir):
    fits, best = trained_role(spark, sf_dir, "full")
    return MD.comparison_frame(spark, fits, best)


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    (cold, cb), (full, fb) = trained_roles(spark, sf_dir)
    return MD.comparison_frame(spark, cold, cb).unionByName(MD.comparison_frame(spark, full, fb))


@query("predict_test")
def q_predict_test(spark, sf_dir):
    """Hold-out predictions of the selected full model."""
    _, test = _split(spark, sf_dir)
    f = fitted(spark, sf_dir, "full")
    return MD.predict(f, test, keep=["customer_id", "snapshot_month", S.LABEL])


@query("top_features")
def q_top_features(spark, sf_dir):
    """Top 15 expanded features of the selected full model."""
    f = fitted(spark, sf_dir, "full")
    return MD.top_features(MD.feature_importance(spark, f), 15)


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """Score a whole batch, keep the input columns + probability, score,
    decision (M17); display subset (P14)."""
    f = fitted(spark, sf_dir, "full")
    out = MD.predict(f, snapshots(spark, sf_dir), keep=["customer_id", "snapshot_month", "age",
                                                        "monthly_income", "util_avg_3m"])
    return out.select("customer_id", "snapshot_month", "age", "monthly_income", "util_avg_3m",
                      F.col("probability").alias("default_prob"), "credit_score", "decision")


@query("sample_scores")
def q_sample_scores(spark, sf_dir):
    """Ten hash-sampled hold-out rows with actual, probability, score, decision."""
    _, test = _split(spark, sf_dir)
    sample = ST.sample_hash(test, SPLIT_KEYS, 10, seed=7)
    f = fitted(spark, sf_dir, "full")
    return MD.predict(f, sample, keep=["customer_id", "snapshot_month", F.col(S.LABEL).alias("actual")])


@query("run_metrics")
def q_run_metrics(spark, sf_dir):
    """Params and metrics of a training run as rows."""
    full, fb = trained_role(spark, sf_dir, "full")
    return MD.run_metric_rows(spark, "run", full, fb).drop("ts")


@query("cold_vs_full_auc")
def q_cold_vs_full_auc(spark, sf_dir):
    """Selected cold and full model against the quality gates, and what behaviour adds."""
    rows = []
    for role, (fits, best) in zip(("cold", "full"), trained_roles(spark, sf_dir), strict=True):
        m = fits[best].metrics
        rows.append((role, best, m["roc_auc"], m["recall"], (m["roc_auc"] or 0) >= S.AUC_GATE, m["recall"] >= S.RECALL_GATE))
    return spark.createDataFrame(rows, "role string, model string, roc_auc double, recall double, auc_ok boolean, recall_ok boolean")


@query("evaluation_report")
def q_evaluation_report(spark, sf_dir):
    """Confusion, class report, curves, threshold sweep, decisions and score bins of the selected cold and full model on one hold-out."""
    _, test = _split(spark, sf_dir)
    trained_roles(spark, sf_dir)
    out = None
    for role in ("cold", "full"):
        pred = written(MD.predict(fitted(spark, sf_dir, role), test, keep=[F.col(S.LABEL).alias("y")]), "predictions")
        rep = MD.evaluation_report(pred, role)
        out = rep if out is None else out.unionByName(rep)
    return out


@query("learned_router")
def q_learned_router(spark, sf_dir):
    """The tier router over the learned probabilities of both selected models, on every snapshot."""
    from .jobs import _probability
    trained_roles(spark, sf_dir)
    snap = snapshots(spark, sf_dir)
    x = _probability(snap, fitted(spark, sf_dir, "cold").model, S.STATIC_FEATURES, "_p_cold")
    x = _probability(x, fitted(spark, sf_dir, "full").model, S.ALL_FEATURES, "_p_full")
    return P.route(x, F.col("_p_cold"), F.col("_p_full"), keep=["customer_id", "snapshot_month"]).withColumn(
        "risk_warnings", F.concat_ws("; ", "risk_warnings"))


@query("learned_importance_share")
def q_learned_importance_share(spark, sf_dir):
    """Static and behavioural share of the selected full model's stored importance: one-hot names match their column by prefix."""
    imp = written(MD.feature_importance(spark, fitted(spark, sf_dir, "full")), "importance")
    return AU.importance_share(imp, AU.group_table(spark))


@query("learned_whatif")
def q_learned_whatif(spark, sf_dir):
    """The what-if scenarios (P12) scored by the selected full model."""
    _, test = _split(spark, sf_dir)
    return AU.whatif_scenarios(test, SPLIT_KEYS, lambda u: MD.predict(fitted(spark, sf_dir, "full"), u, keep=["scenario"]))


@query("feature_lists")
def q_feature_lists(spark, sf_dir):
    """The inputs of the selected models in order."""
    trained_roles(spark, sf_dir)
    return MD.feature_list(spark, fitted(spark, sf_dir, "cold"), "run").unionByName(MD.feature_list(spark, fitted(spark, sf_dir, "full"), "run"))


def _notebook_sql() -> str:
    num = S.LOG_COLUMNS + S.NOTEBOOK_NUMERIC
    train, out = [], []
    for c in num:
        x = f"coalesce({c}::DOUBLE, (SELECT median({c}::DOUBLE) FROM tr))"
        train.append((c, f"CASE WHEN {x} > -1 THEN ln(1 + {x}) END" if c in S.LOG_COLUMNS else x))
    step = f"nb AS (SELECT customer_id, snapshot_month, is_test, employment_status, city_tier, {', '.join(f'{e} AS {c}' for c, e in train)} FROM gaps)"
    step += ",\nnb2 AS (SELECT * REPLACE (" + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM nb WHERE NOT is_test)) AS {c}" for c in S.LOG_COLUMNS) + ") FROM nb)"
    for c in num:
        out.append(f"round(({c} - (SELECT avg({c}) FROM nb2 WHERE NOT is_test)) / (SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1e0 END FROM nb2 WHERE NOT is_test), 6) AS {c}")
    for c, vals in (("employment_status", ["Business", "Daily Wage", "Retired", "Salaried", "Self-Employed", "Unknown"]), ("city_tier", ["Tier-1", "Tier-2", "Tier-3", "Unknown"])):
        out += [f"(CASE WHEN coalesce({c}, 'Unknown') = '{v}' THEN 1e0 ELSE 0e0 END) AS \"{c}_{v}\"" for v in vals]
        out.append(f"({c} IS NULL)::INTEGER::DOUBLE AS {c}_missing")
    return f"""WITH {SPLIT_CTES},
gaps AS (SELECT * REPLACE (CASE WHEN customer_id % 5 > 0 THEN employment_status END AS employment_status,
  CASE WHEN customer_id % 7 > 0 THEN city_tier END AS city_tier, CASE WHEN customer_id % 3 > 0 THEN monthly_income END AS monthly_income,
  CASE WHEN snapshot_month % 4 > 0 THEN util_avg_3m END AS util_avg_3m) FROM splitted),
tr AS (SELECT * FROM gaps WHERE NOT is_test),
{step}
SELECT customer_id, snapshot_month, {', '.join(out)} FROM nb2 WHERE is_test"""


@query("notebook_features", _notebook_sql())
def q_notebook_features(spark, sf_dir):
    """The notebook's preprocessing (M7: log branch, plain branch, indicators) fitted on training
    rows with missing values and applied to the hold-out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    train, test = (_with_gaps(x) for x in _split(spark, sf_dir))
    num, cats = S.LOG_COLUMNS + S.NOTEBOOK_NUMERIC, ["employment_status", "city_tier"]
    model = Pipeline(stages=PR.notebook_preprocessor(S.LOG_COLUMNS, S.NOTEBOOK_NUMERIC, cats)).fit(train)
    v = vector_to_array("features")
    names = [*PR.expanded_feature_names(model, cats, num), *[f"{c}_missing" for c in cats]]
    out = model.transform(test).select("customer_id", "snapshot_month", v.alias("v"))
    return out.select("customer_id", "snapshot_month", *[(F.round(F.get("v", F.lit(i)), 6) if n in num else F.get("v", F.lit(i))).alias(n) for i, n in enumerate(names)])
