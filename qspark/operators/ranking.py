"""Order, ranks and buckets of whole columns.

Global ranks are counted by ranges: boundaries are fixed values, taken once from a sample; a row's range is searched among them, so
it is the same in every branch of a plan, whatever the exchanges do. Rows are numbered within their range, and the rows of the
ranges before are added. No task holds all rows. Within groups a window does it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(columns: Sequence[str], ascending: bool = True) -> list[Column]:
    """Nulls are smallest."""
    return [F.asc_nulls_first(c) if ascending else F.desc_nulls_last(c) for c in columns]


#: Sampled rows a range: the more, the more even the ranges.
SAMPLED = 20
#: Most ranges; the sample that is sent to the driver has SAMPLED times as many rows, about.
MOST_RANGES = 5_000


def _sorts(v) -> tuple:
    """The engine's order of a value: nulls first, NaN last."""
    nan = isinstance(v, float) and v != v
    return (v is not None, nan, 0 if v is None or nan else v)


def boundaries(df: DataFrame, keys: Sequence[Column]) -> tuple[Column, int]:
    """An array of structs of keys in ascending order that cuts the rows into about as many ranges as the session has shuffle partitions, and its size."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    ranges = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.count()
    picked = df.select(key.alias("k"))
    kind = picked.schema["k"].dataType
    if rows > SAMPLED * ranges:
        picked = picked.sample(SAMPLED * ranges / rows, seed=1)
    ordered = sorted((tuple(r["k"]) for r in picked.collect()), key=lambda t: tuple(map(_sorts, t)))
    step = max(1, len(ordered) // ranges)
    made = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(t, kind.fields, strict=True))) for t in ordered[step::step]]
    return F.array(*made) if made else F.array().cast(f"array<{kind.simpleString()}>"), len(made)


def range_of(keys: Sequence[Column], bounds: Column, n: int) -> Column:
    """How many of the n boundaries are at or below the keys: binary search, within the row."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    if not n:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))


def ranged(df: DataFrame, keys: Sequence[Column], out: str = "_range") -> DataFrame:
    """The rows with the number of their range of keys."""
    return df.withColumn(out, range_of(keys, *boundaries(df, keys)))


def _before(d: DataFrame, agg: Column) -> DataFrame:
    """For each range, the sum over all ranges before it; one row a range meets here."""
    own = d.groupBy("_range").agg(agg.alias("_own"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return own.select(F.col("_range").alias("_r"), F.sum("_own").over(w).alias("_before"))


def _numbered(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool], out: str) -> DataFrame:
    """Row number from 0 in the given order."""
    order = [ordering([c], up)[0] for c, up in zip(columns, ascending, strict=True)]
    lead = [F.col(c) for c, up in zip(columns, ascending, strict=True) if up == ascending[0]] if len(set(ascending)) == 1 else [F.col(columns[0])]
    d = ranged(df, lead)
    if not ascending[0]:
        d = d.withColumn("_range", -F.col("_range"))
    own = d.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long") - 1)
    before = _before(d, F.count(F.lit(1)))
    return own.join(before, F.col("_range") == F.col("_r")).withColumn(out, F.col("_in") + F.coalesce("_before", F.lit(0))).select(*df.columns, out)


def rank(df: DataFrame, column: str, tie: Sequence[str] = (), by: Sequence[str] = (), out: str = "rank", ascending: bool = True) -> DataFrame:
    """0-based place of each row in stable order. tie: columns that settle equal values."""
    if by:
        order = ordering([column], ascending) + ordering(tie)
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    return _numbered(df, [column, *tie], [ascending] + [True] * len(tie), out)


def xrank(df: DataFrame, column: str, n: int, tie: Sequence[str] = (), by: Sequence[str] = (), out: str = "xrank") -> DataFrame:
    """Bucket floor(rank * n / rows)."""
    if n <= 0:
        raise ValueError("domain: the number of buckets must be positive")
    r = rank(df, column, tie, by, "_rank")
    if by:
        size = F.count(F.lit(1)).over(Window.partitionBy(*by))
        return r.withColumn(out, F.floor(F.col("_rank") * n / size)).drop("_rank")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return r.crossJoin(F.broadcast(total)).withColumn(out, F.floor(F.col("_rank") * n / F.col("_total"))).drop("_rank", "_total")  # one row


def iasc(df: DataFrame, column: str, row: str, ascending: bool = True) -> DataFrame:
    """The sort permutation of a column: for each place in sorted order (`place`), the number of the row that stands there (`index`).

    Rows are numbered from 0 in the order of the column `row`, which settles equal values, too.
    """
    numbered = rank(df.select(column, row), row, out="index")
    return rank(numbered, column, [row], out="place", ascending=ascending).select("place", "index")


def xasc(df: DataFrame, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*ordering(columns), *ordering(tie))


def xdesc(df: DataFrame, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*ordering(columns, False), *ordering(tie))


def reverse(df: DataFrame, rid: str) -> DataFrame:
    return df.orderBy(F.desc(rid))


def running(df: DataFrame, column: str, order: Sequence[str], by: Sequence[str] = (), agg=F.sum, out: str = "running") -> DataFrame:
    """Prefix results of an aggregate in row order, within groups or over all."""
    if by:
        w = Window.partitionBy(*by).orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, agg(F.col(column)).over(w))
    d = ranged(df, [F.col(c) for c in order])
    own = d.withColumn("_own", agg(F.col(column)).over(Window.partitionBy("_range").orderBy(*ordering(order)).rowsBetween(Window.unboundedPreceding, 0)))
    ends = d.groupBy("_range").agg(agg(F.col(column)).alias("_end"))
    before = ends.select(F.col("_range").alias("_r"), agg(F.col("_end")).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    joined = own.join(before, F.col("_range") == F.col("_r"))
    plus = F.col("_own") + F.col("_before") if agg is F.sum else (F.greatest if agg is F.max else F.least)("_own", "_before")
    # a range without values so far has no result of its own
    total = F.coalesce(plus, "_own", "_before")
    return joined.withColumn(out, total).select(*df.columns, out)
