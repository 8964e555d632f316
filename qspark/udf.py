"""User functions: Column-composing Python functions first, Arrow-batched functions second, grouped functions last."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register(name: str, f: Callable[..., Column]) -> None:
    """A function of Columns; it stays inside generated code."""
    FUNCTIONS[name] = f


def vectorized(f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A function of pandas Series, in Arrow batches."""
    return F.pandas_udf(f, returns)


def grouped(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of each group's rows; a group must fit in a task."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def load_java(spark: SparkSession, name: str, class_name: str, returns: str | None = None) -> None:
    """A compiled function by class name; without `returns`, its type is the class's own."""
    spark.udf.registerJavaFunction(name, class_name, returns)
