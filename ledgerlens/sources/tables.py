"""Readers for the driver tables and for stored results.

Reads are lazy and column-pruned: callers select what they need and Catalyst
pushes the projection and filters into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (``region nation customer ... conversations``)."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


@dataclass
class ReadResult:
    """Outcome of a guarded read: a DataFrame or a failure message."""
    df: DataFrame | None
    ok: bool
    message: str = ""


def try_read_parquet(spark: SparkSession, path: str) -> ReadResult:
    """Read a Parquet table; a missing path is reported instead of raised, so the
    caller can keep the last good output (S7)."""
    try:
        df = spark.read.parquet(path)
        return ReadResult(df, True)
    except AnalysisException as e:  # PATH_NOT_FOUND and friends
        return ReadResult(None, False, str(e).splitlines()[0])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in a floating column is a missing value, hence NULL."""
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, (T.FloatType, T.DoubleType))})


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """Required-column check (P5): raise when a name is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
