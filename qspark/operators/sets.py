"""Set operations on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import semi_join


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return concat(a, b).distinct()


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns go by name."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"value: columns differ: {a.columns}, {b.columns}")
    return a.unionByName(b)


def sect(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of a that occur in b, with a's repeats."""
    return semi_join(list(keys or a.columns), a, b)


def except_(a: DataFrame, b: DataFrame | Sequence[str] | str, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows of a that do not occur in b, with a's repeats; of a table and names, the table without those columns."""
    if isinstance(b, str):
        return a.drop(b)
    if not isinstance(b, DataFrame):
        return a.drop(*b)
    return semi_join(list(keys or a.columns), a, b, anti=True)


def distinct(a: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (a.select(*columns) if columns else a).distinct()


def raze(a: DataFrame, column: str) -> DataFrame:
    """One row an element."""
    return a.withColumn(column, F.explode(column))


def remove(a: DataFrame, rid: str, rows: Sequence) -> DataFrame:
    return a.where(~F.col(rid).isin(list(rows)))


def filter_(a: DataFrame, mask) -> DataFrame:
    return a.where(mask)
