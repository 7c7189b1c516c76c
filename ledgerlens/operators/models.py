"""Model training, selection, importance and scoring with Spark MLlib.

Two roles share one split (J6): ``cold`` on the 8 static features and
``full`` on all 37. Each role fits three candidates — logistic regression
(balanced weights, L2 with C = 1), random forest (100 trees, balanced) and
gradient-boosted trees (100 rounds, rate 0.1, depth 5, unweighted) — and
keeps the best by ROC-AUC (strict >, first wins ties).

Parity notes: sklearn's L2 logistic regression minimises
½‖w‖² + C·Σ wᵢ·lossᵢ; MLlib minimises (1/Σw)·Σ wᵢ·lossᵢ + ½·λ‖w‖², so
λ = 1 / (C·Σw) (Σw = n with balanced weights) and ``standardization=False``
since the pipeline scales already. Trees cannot match row by row (different
split search); sklearn trees are unbounded, MLlib's stop at depth 30 at most
(``rf_max_depth``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import prob_to_score, score_to_decision
from ..session import ship, side_by_side
from . import metrics as M
from .boosting import TableBoosted
from .forest import TableForest
from .prep import expanded_feature_names, preprocessor, split_roles, with_class_weights

CANDIDATE_ORDER = ["logistic_regression", "random_forest", "gradient_boosting"]
CANDIDATE_TYPE = {"logistic_regression": "LogisticRegression", "random_forest": "RandomForestClassifier",
                  "gradient_boosting": "GBTClassifier"}
RF_MAX_DEPTH = 30     # MLlib's limit


def make_classifier(name: str, n_train: int, label: str = S.LABEL, rf_max_depth: int = RF_MAX_DEPTH):
    if name == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=1000,
                                  regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
                                  family="binomial", tol=1e-6)
    if name == "random_forest":
        return TableForest(featuresCol="features", labelCol=label, weightCol="weight", numTrees=100, maxDepth=rf_max_depth, seed=42)
    if name == "gradient_boosting":
        return TableBoosted(featuresCol="features", labelCol=label, maxIter=100, stepSize=0.1, maxDepth=5)
    raise ValueError(name)


def role_features(role: str) -> list[str]:
    return list(S.STATIC_FEATURES if role == "cold" else S.ALL_FEATURES)


@dataclass
class Fitted:
    name: str
    role: str
    model: PipelineModel
    categorical: list[str]
    numeric: list[str]
    metrics: dict = field(default_factory=dict)


def fit_candidates(train: DataFrame, role: str, names: list[str], label: str = S.LABEL, after: Callable[[Fitted], object] | None = None) -> dict[str, Fitted]:
    """The preprocessing is fitted once; every candidate is fitted on the encoded vectors, side by side, and given to ``after``.
    The vectors are kept for several candidates only: each fit keeps its own copy (blocks of rows, binned rows) for its
    rounds, and a second one of all rows goes to disk."""
    feats = role_features(role)
    data = with_class_weights(train.select(*feats, label), label)
    cat, num = split_roles(data, feats)
    prep = Pipeline(stages=preprocessor(cat, num)).fit(data)
    enc = prep.transform(data).select("features", label, "weight")
    if len(names) > 1:
        enc.persist()
    try:
        n_train = enc.count()
        ship(train.sparkSession)

        def fit(name: str) -> Fitted:
            f = Fitted(name, role, PipelineModel(prep.stages + [make_classifier(name, n_train, label).fit(enc)]), cat, num)
            if after is not None:
                after(f)
            return f

        return dict(zip(names, side_by_side(train.sparkSession, [lambda name=name: fit(name) for name in names]), strict=True))
    finally:
        enc.unpersist()


def fit_candidate(train: DataFrame, role: str, name: str, label: str = S.LABEL) -> Fitted:
    return fit_candidates(train, role, [name], label)[name]


def predict(fitted: Fitted | PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Probability of class 1 and the 0.5-threshold label (M12), plus score
    and decision (F2, F3), beside the columns of ``keep`` as they are in ``df``: the
    model's imputation and scaling work in place on the names it shares with them."""
    model = fitted.model if isinstance(fitted, Fitted) else fitted
    cols = list(keep or [])
    out = model.transform(df.withColumn("_kept", F.struct(*cols)) if cols else df)
    p = vector_to_array("probability")[1]
    return out.select(*(["_kept.*"] if cols else []), p.alias("probability"), F.col("prediction").cast("int").alias("predicted"),
                      prob_to_score(p).alias("credit_score"),
                      score_to_decision(prob_to_score(p)).alias("decision"))


def evaluate(fitted: Fitted, test: DataFrame, label: str = S.LABEL) -> dict:
    pred = predict(fitted, test, keep=[label]).select(
        F.col(label).alias("y"), F.col("probability").alias("p"), F.col("predicted").alias("pred"))
    pred = pred.persist()
    try:
        m = M.binary_metrics(pred).head().asDict()
        m["roc_auc"] = M.roc_auc(pred).head()["roc_auc"]
        m["average_precision"] = M.average_precision(pred).head()["average_precision"]
    finally:
        pred.unpersist()
    fitted.metrics = m
    return m


def train_role(train: DataFrame, test: DataFrame, role: str, candidates: list[str] | None = None,
               label: str = S.LABEL) -> tuple[dict[str, Fitted], str]:
    """Fit and evaluate every candidate; best by AUC, strict >, first wins."""
    fitted = fit_candidates(train, role, candidates or CANDIDATE_ORDER, label, after=lambda f: evaluate(f, test, label))
    best, best_auc = None, None
    for name, f in fitted.items():
        auc = f.metrics["roc_auc"]
        if best is None or (auc is not None and (best_auc is None or auc > best_auc)):
            best, best_auc = name, auc
    return fitted, best


def comparison_frame(spark: SparkSession, fitted: dict[str, Fitted], best: str) -> DataFrame:
    """Model comparison table (A27); a metric that the hold-out doesn't define is NULL."""
    value = lambda f, k: None if f.metrics[k] is None else float(f.metrics[k])
    rows = [(f.role, f.name, CANDIDATE_TYPE[f.name], *[value(f, k) for k in ("roc_auc", "recall", "f1", "precision", "accuracy")], f.name == best)
            for f in fitted.values()]
    return spark.createDataFrame(rows, "role string, model string, model_type string, roc_auc double, "
                                       "recall double, f1 double, precision double, accuracy double, is_best boolean")


def feature_importance(spark: SparkSession, f: Fitted) -> DataFrame:
    """|coefficient| for LR, impurity importance for trees, zeros otherwise,
    with expanded one-hot names (M15)."""
    names = expanded_feature_names(f.model, f.categorical, f.numeric)
    clf = f.model.stages[-1]
    if hasattr(clf, "coefficients"):
        imp = [abs(float(x)) for x in clf.coefficients.toArray()]
    elif hasattr(clf, "featureImportances"):
        imp = [float(x) for x in clf.featureImportances.toArray()]
    else:
        imp = [0.0] * len(names)
    return spark.createDataFrame(list(zip(names, imp, strict=True)), "feature string, importance double")


def feature_list(spark: SparkSession, f: Fitted, run_id: str) -> DataFrame:
    """The model's inputs in order, with their kind."""
    rows = [(run_id, f.role, i, c, "categorical" if c in f.categorical else "numeric") for i, c in enumerate(role_features(f.role))]
    return spark.createDataFrame(rows, "run_id string, role string, position int, feature string, kind string")


def evaluation_report(pred: DataFrame, role: str) -> DataFrame:
    """All evaluation tables of one model's stored predictions (y, probability, predicted,
    credit_score, decision) in long form: (role, section, item, metric, value)."""
    ev = pred.select("y", F.col("probability").alias("p"), F.col("predicted").alias("pred"), F.col("credit_score").alias("score"), "decision")
    auc, binary = M.roc_auc(ev), M.binary_metrics(ev)
    parts = [
        ("summary", auc, None), ("summary", binary, None), ("summary", M.average_precision(ev), None), ("summary", M.log_loss(ev), None),
        ("confusion", M.confusion(ev), None), ("gate", M.metric_gate(auc, binary), None),
        ("class", M.classification_report(ev), "label"), ("threshold", M.threshold_sweep(ev), "threshold"),
        ("decision", M.default_rate_by_decision(ev), "decision"), ("score", _score_bins(ev), "bin"),
        ("roc_curve", M.roc_curve(ev).where("threshold <> double('inf')"), "threshold"), ("pr_curve", M.pr_curve(ev).where("threshold is not null"), "threshold"),
    ]
    out = None
    for section, df, item in parts:
        values = [c for c in df.columns if c != item]
        long = df.select((F.col(item).cast("string") if item else F.lit("all")).alias("item"),
                         F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m"))
        long = long.select(F.lit(role).alias("role"), F.lit(section).alias("section"), "item", "m.metric", "m.value")
        out = long if out is None else out.unionByName(long)
    return out


def _score_bins(ev: DataFrame) -> DataFrame:
    """Rows and default rate per 60 points of the score: defined for tied probabilities too, where deciles aren't."""
    b = F.least(F.floor((F.col("score") - S.SCORE_MIN) / 60), F.lit(9)).cast("int")
    return ev.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("y").alias("default_rate"))


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """Top-n by importance, ties by name."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


# ---------------------------------------------------------------------------
# persistence (S12) and run metrics
# ---------------------------------------------------------------------------

def save_model(f: Fitted, base_path: str, run_id: str | None = None) -> str:
    """Model path keyed by role and run id (fixes the shared-file clash D14)."""
    run_id = run_id or uuid.uuid4().hex[:12]
    path = f"{base_path.rstrip('/')}/{f.role}/{run_id}"
    f.model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_metric_rows(spark: SparkSession, run_id: str, fitted: dict[str, Fitted], best: str) -> DataFrame:
    ts = time.time()
    rows = []
    for f in fitted.values():
        rows += [(run_id, f.role, f.name, "param", k, float(v)) for k, v in _params(f).items()]
        rows += [(run_id, f.role, f.name, "metric", k, float(v)) for k, v in f.metrics.items() if v is not None]
    rows.append((run_id, next(iter(fitted.values())).role, best, "selection", "best", 1.0))
    return spark.createDataFrame(rows, "run_id string, role string, model string, kind string, key string, "
                                       "value double").withColumn("ts", F.lit(ts).cast("timestamp"))


def _params(f: Fitted) -> dict:
    clf = f.model.stages[-1]
    keys = ["maxIter", "regParam", "numTrees", "maxDepth", "stepSize"]
    out = {}
    for k in keys:
        if clf.hasParam(k):
            p = clf.getParam(k)
            if clf.isDefined(p):
                out[k] = clf.getOrDefault(p)
    return out


def append_run_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
