"""Aggregates with the language's null rules. Order-sensitive ones take the order from a column, never from partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col


def sum_(x, nulls: str = "skip", empty_zero: bool = False) -> Column:
    """nulls='propagate': null if any is. empty_zero: 0 for no value, as over a whole column."""
    x = col(x)
    s = F.sum(x)
    if nulls == "propagate":
        return F.when(F.count(x) == F.count(F.lit(1)), s)
    return F.coalesce(s, F.lit(0)) if empty_zero else s


def avg(x) -> Column:
    return F.avg(col(x))


def min_(x) -> Column:
    return F.min(col(x))


def max_(x) -> Column:
    return F.max(col(x))


def count(x=None) -> Column:
    """All rows, nulls included."""
    return F.count(F.lit(1))


def med(x) -> Column:
    return F.median(col(x))


def dev(x) -> Column:
    return F.stddev_pop(col(x))


def first(x, rid) -> Column:
    """Of the first row."""
    return F.min_by(F.struct(col(x).alias("x")), col(rid))["x"]


def last(x, rid) -> Column:
    """The last that isn't null."""
    x = col(x)
    return F.max_by(x, F.when(x.isNotNull(), col(rid)))


def collected(x, rid, nulls: str = "first") -> Column:
    """The group's values in row order, nulls kept: the language's list of a group. nulls='last': rows without a rid at the end, as SQL has them."""
    rid = col(rid)
    row = F.struct(rid.alias("r"), col(x).alias("x"))
    if nulls == "last":
        pairs = F.concat(*(F.array_sort(F.collect_list(F.when(known, row))) for known in (rid.isNotNull(), rid.isNull())))
    else:
        pairs = F.array_sort(F.collect_list(row))
    return F.transform(pairs, lambda p: p["x"])


def rows(rid) -> Column:
    return F.array_sort(F.collect_list(col(rid)))


def distinct(x) -> Column:
    return F.array_sort(F.collect_set(col(x)))


def count_distinct(x) -> Column:
    return F.count_distinct(col(x)) + F.max(col(x).isNull().cast("long"))
