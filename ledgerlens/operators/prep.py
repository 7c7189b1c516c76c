"""Preprocessing as MLlib pipeline stages.

* ``MedianImputer``   exact, interpolated median per numeric column (the
  built-in ``Imputer`` returns a non-interpolated approximate median);
  medians come from ``exact_quantiles`` — distributed, no collect of values.
* ``PopulationScaler`` (x - mean) / population std, 0 for a constant column
  (the built-in ``StandardScaler`` uses the sample std).
* ``ConstantImputer`` categorical NULL -> 'Unknown', optional 0/1 indicators.
* one-hot: ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``:
  the extra "unseen" slot is exactly the dropped one, so an unseen category
  encodes as all zeros (the encoder takes the slot from the indexer's metadata;
  its own handleInvalid="keep" would add a second one).

Custom stages persist through ``DefaultParamsWritable`` (fitted values are
params), so a ``PipelineModel`` with them saves and loads.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_stats import exact_quantiles


class _HasValues(Params):
    values = Param(Params._dummy(), "values", "fitted value per input column",
                   typeConverter=TypeConverters.toListFloat)


class MedianImputerModel(Model, HasInputCols, _HasValues, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, vals = self.getInputCols(), self.getOrDefault(self.values)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(cols, vals)})


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.getInputCols()
        medians = column_medians(df, cols)
        return MedianImputerModel(inputCols=cols, values=[medians.get(c, 0.0) for c in cols])


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians of many columns in one distributed pass (unpivot + grouped
    exact quantile). Only the per-column result reaches the driver."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value")
    q = exact_quantiles(long, "value", [0.5], by=["column"])
    return {r["column"]: r["quantile"] for r in q.collect()}


class PopulationScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, m, s in zip(self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            scale = s if s and s > 0 else 1.0  # constant column -> (x - mean) / 1 = 0
            out[c] = (F.col(c).cast("double") - F.lit(m)) / F.lit(scale)
        return df.withColumns(out)


class PopulationScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).head()
        return PopulationScalerModel(inputCols=cols, means=[float(row[f"m{i}"] or 0.0) for i in range(len(cols))],
                                     stds=[float(row[f"s{i}"] or 0.0) for i in range(len(cols))])


class ConstantImputer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    fill = Param(Params._dummy(), "fill", "fill value", typeConverter=TypeConverters.toString)
    indicators = Param(Params._dummy(), "indicators", "add <col>_missing 0/1 columns",
                       typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, fill="Unknown", indicators=False):
        super().__init__()
        self._setDefault(fill="Unknown", indicators=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        fill = self.getOrDefault(self.fill)
        out = {}
        if self.getOrDefault(self.indicators):
            out.update({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})
        out.update({c: F.coalesce(F.col(c), F.lit(fill)) for c in cols})
        return df.withColumns(out)


def split_roles(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) by type: strings are categorical."""
    types = dict(df.dtypes)
    cat = [c for c in features if c in types and types[c] == "string"]
    num = [c for c in features if c in types and types[c] != "string"]
    return cat, num


def preprocessor(categorical: list[str], numeric: list[str], output: str = "features") -> list:
    """Column-wise preprocessing stages (M7): median + population scaling for
    numerics, 'Unknown' + sorted one-hot for categoricals, then one vector."""
    stages: list = [MedianImputer(inputCols=numeric), PopulationScaler(inputCols=numeric),
                    ConstantImputer(inputCols=categorical)]
    oh_cols = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        oh_cols.append(f"{c}__oh")
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=oh_cols,
                                    dropLast=True))
    stages.append(VectorAssembler(inputCols=numeric + oh_cols, outputCol=output))
    return stages


class Log1p(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """log(1 + x) in place; NULL at or below -1, where it is undefined."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(c) > -1, F.log1p(F.col(c).cast("double"))) for c in self.getInputCols()})


def notebook_preprocessor(log_columns: list[str], numeric: list[str], categorical: list[str], output: str = "features") -> list:
    """The notebook's variant (M7): median, log1p and scaling for skewed columns, median and scaling for the
    other numerics, 'Unknown' with missing indicators (of the columns given) and one-hot for categoricals."""
    stages: list = [MedianImputer(inputCols=log_columns + numeric), Log1p(inputCols=log_columns), MedianImputer(inputCols=log_columns),
                    PopulationScaler(inputCols=log_columns + numeric), ConstantImputer(inputCols=categorical, indicators=True)]
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"{c}__oh" for c in categorical],
                                dropLast=True))
    stages.append(VectorAssembler(inputCols=log_columns + numeric + [f"{c}__oh" for c in categorical] + [f"{c}_missing" for c in categorical],
                                  outputCol=output))
    return stages


def expanded_feature_names(model, categorical: list[str], numeric: list[str]) -> list[str]:
    """Names of the assembled vector slots: numeric names, then
    ``<column>_<category>`` per one-hot slot in alphabetical order."""
    names = list(numeric)
    labels = {s.getInputCol(): s.labels for s in model.stages if hasattr(s, "labels") and hasattr(s, "getInputCol")}
    for c in categorical:
        names += [f"{c}_{v}" for v in labels.get(c, [])]
    return names


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 · n_class) (M8) — a two-row aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    n = F.sum("n_class").over(Window.partitionBy())      # over <= 2 class rows
    return counts.select(F.col(label), F.col("n_class").cast("long").alias("n_class"),
                         (n.cast("double") / (F.lit(2.0) * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """``df`` with the balanced weight of its class. A NULL label is an error."""
    known = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"{label} holds NULLs")).cast(df.schema[label].dataType)).otherwise(F.col(label))
    df = df.withColumn(label, known)
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)   # one row per class: bounded
