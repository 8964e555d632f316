"""Lookup, as-of and window joins.

Lookup joins return at most one match a left row: the first right row with its keys. Null keys match null keys. A same-named
non-key column takes the right value where there is a match, even a null one, else the left value. No join broadcasts by hint:
sides under the session's size threshold are broadcast by the planner, which knows their size; others are sort-merged, and AQE
splits skewed partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking

RID = "_rid"
#: Time slots of an as-of join over the whole span of times.
SLOTS = 64
WEEK_US = 7 * 24 * 3600 * 1_000_000


def with_rid(df: DataFrame, order: str | Sequence[str] | None = None) -> tuple[DataFrame, Column]:
    """A column that gives the row order: the given ones, or an id in order of the scan."""
    if order is None:
        return df.withColumn(RID, F.monotonically_increasing_id()), F.col(RID)
    names = [order] if isinstance(order, str) else list(order)
    return df, F.struct(*names) if len(names) > 1 else F.col(names[0])


def first_rows(df: DataFrame, keys: Sequence[str], order: str | Sequence[str] | None = None) -> DataFrame:
    """The first row of each key: an aggregate with partial results, so a hot key is no problem."""
    rest = [c for c in df.columns if c not in keys]
    d, rid = with_rid(df, order)
    row = F.struct(*(F.col(c) for c in rest)) if rest else F.struct(F.lit(True).alias("x"))
    got = d.groupBy(*keys).agg(F.min_by(row, rid).alias("_row"))
    return got.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def _lookup(keys: Sequence[str], left: DataFrame, right: DataFrame, order, how: str) -> DataFrame:
    rest = [c for c in right.columns if c not in keys]
    one = first_rows(right, keys, order).select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_r_{c}") for c in rest), F.lit(True).alias("_hit"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    j = left.join(one, on, how)
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = [F.col(k) for k in keys]
    for c in left.columns:
        if c not in keys:
            out.append(F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c))
    out += [F.col(f"_r_{c}").alias(c) for c in rest if c not in left.columns]
    return j.select(*out)


def left_join(keys: Sequence[str], left: DataFrame, right: DataFrame, order=None) -> DataFrame:
    """Every left row once. order: the right side's row order."""
    return _lookup(list(keys), left, right, order, "left")


def inner_join(keys: Sequence[str], left: DataFrame, right: DataFrame, order=None) -> DataFrame:
    """Left rows with a match, once each."""
    return _lookup(list(keys), left, right, order, "inner")


def find_rows(keys: Sequence[str], left: DataFrame, right: DataFrame, order: str, out: str = "row") -> DataFrame:
    """The order value of the first right row with the left row's keys, null if none."""
    first = right.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.min(order).alias(out))
    return left.join(first, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*(f"_k_{k}" for k in keys))


def semi_join(keys: Sequence[str], left: DataFrame, right: DataFrame, anti: bool = False) -> DataFrame:
    """Left rows with (or without) a match."""
    r = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti" if anti else "left_semi")


def _long(c: Column, kind: str) -> Column:
    """An orderable whole number of a time column: microseconds, days or the number itself."""
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.unix_date(c).cast("long")
    return c


def _width(time: str, kind: str, *tables: DataFrame) -> int:
    """Slots for as-of joins: a week of timestamps, some days, or of numbers a part of the span that they take."""
    if kind.startswith("timestamp"):
        return WEEK_US
    if kind == "date":
        return SLOTS
    spans = [t.select(F.col(time).alias("t")) for t in tables]
    r = functools.reduce(DataFrame.unionByName, spans).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return 1 if r["a"] is None else max(1, int((r["b"] - r["a"]) // SLOTS) + 1)


def asof_join(keys: Sequence[str], time: str, left: DataFrame, right: DataFrame, order: str | None = None, slot: int | None = None) -> DataFrame:
    """Backward as-of: of the right rows with equal keys and time <= the left time, the latest (of equal times the last by order).

    One shuffle: both sides in one table, the last right row so far in a window of each key and time slot, so a hot key is spread
    over tasks; a slot begins with the last row of earlier slots, one row a slot. slot: width of the slots (in microseconds for
    timestamps, else in the column's unit); without it, a part of the times' span.
    """
    slot = slot or _width(time, dict(left.dtypes)[time], left, right)
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys and c != time]
    shared = [c for c in payload if c in left.columns]
    r, rid = with_rid(right, order)
    kinds = dict(left.dtypes)
    a = left.select(*keys, F.col(time), F.lit(1).alias("_side"), F.lit(None).cast(r.select(rid).schema[0].dataType).alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    b = r.select(*keys, F.col(time).cast(kinds[time]), F.lit(0).alias("_side"), rid.alias("_tie"), F.lit(None).alias("_l"), F.struct(*(F.col(c) for c in payload), F.lit(True).alias("_hit")).alias("_r"))
    types = {x.name: x.dataType for x in a.schema}
    b = b.withColumn("_l", F.lit(None).cast(types["_l"]))
    a = a.withColumn("_r", F.lit(None).cast({x.name: x.dataType for x in b.schema}["_r"]))
    both = a.unionByName(b)
    both = both.withColumn("_slot", F.floor(_long(F.col(time), kinds[time]) / slot))
    by = [*keys, "_slot"]
    was = F.col("_side") == 0
    ends = both.groupBy(*by).agg(F.max_by(F.when(was, F.col("_r")), F.when(was, F.struct(F.col(time), "_tie"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_r", F.last("_end", ignorenulls=True).over(earlier)).where("_r is not null").select(*by, F.lit(-1).alias("_side"), "_r")
    w = Window.partitionBy(*by).orderBy(F.col("_side") >= 0, F.col(time), "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    got = both.unionByName(carried, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.coalesce(F.col("_m")["_hit"], F.lit(False))
    out = []
    for c in left.columns:
        v = F.col("_l")[c]
        out.append((F.when(hit, F.col("_m")[c]).otherwise(v) if c in shared else v).alias(c))
    return got.select(*out, *(F.col("_m")[c].alias(c) for c in payload if c not in left.columns))


def _windows(keys: Sequence[str], time: str, lo: Column, hi: Column, left: DataFrame, right: DataFrame, aggs: Mapping[str, Column], prevailing: bool, width: int | None) -> DataFrame:
    keys = list(keys)
    kind = dict(right.dtypes)[time]
    l = left.withColumn("_id", F.monotonically_increasing_id()).withColumn("_lo", _long(lo, kind)).withColumn("_hi", _long(hi, kind))
    names = [c for c in right.columns if c not in keys]
    if width is None:  # a bucket as wide as the widest window: each window touches two at most
        width = max(1, int(left.select(F.max(_long(hi, kind) - _long(lo, kind)).alias("w")).first()["w"] or 1))
    r = right.withColumn("_t", _long(F.col(time), kind)).withColumn("_b", F.floor(F.col("_t") / width))
    r = r.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_t", "_b", *(F.col(c).alias(f"_r_{c}") for c in names))
    asked = l.where("_lo <= _hi").select(*keys, "_id", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_w"))
    on = [F.col("_w") == F.col("_b"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.col("_t") >= F.col("_lo"), F.col("_t") <= F.col("_hi")]
    hits = asked.join(r, on).select("_id", *(F.col(f"_r_{c}").alias(c) for c in names))
    if prevailing:
        at = l.select(*keys, F.col("_lo").alias("_t"), "_id").where("_t is not null")
        own = right.select(*keys, _long(F.col(time), kind).alias("_t"), F.struct(*names).alias("_row"), F.lit(True).alias("_p"))
        before = asof_join(keys, "_t", at, own, slot=_width(time, kind, left, right)).where("_p").withColumn("_time", _long(F.col("_row")[time], kind)).where("_time < _t")
        hits = hits.unionByName(before.select("_id", *(F.col("_row")[c].alias(c) for c in names)))
    made = hits.groupBy("_id").agg(*(e.alias(n) for n, e in aggs.items()))
    return l.join(made, "_id", "left").select(*left.columns, *aggs)


def window_join1(keys: Sequence[str], time: str, lo: Column, hi: Column, left: DataFrame, right: DataFrame, aggs: Mapping[str, Column], width: int | None = None) -> DataFrame:
    """Left rows with aggregates over the right rows of equal keys and lo <= time <= hi. An equi-join on time buckets, no cross join."""
    return _windows(keys, time, lo, hi, left, right, aggs, False, width)


def window_join(keys: Sequence[str], time: str, lo: Column, hi: Column, left: DataFrame, right: DataFrame, aggs: Mapping[str, Column], width: int | None = None) -> DataFrame:
    """As window_join1, and the row that prevails at lo (the last before it) belongs to the window, too."""
    return _windows(keys, time, lo, hi, left, right, aggs, True, width)


def bin_join(left: DataFrame, column: str, points: DataFrame, point: str, out: str, right: bool = False) -> DataFrame:
    """Place of the last point <= the value (-1: none), or with right of the first point >= it (number of points: none).

    Each distinct value is placed once, so a hot value costs nothing. Values and points are dealt by ranges of the value; a range
    counts its points up to each value, and the points of the ranges before are added. Null points are left out; a null value is
    before all points.
    """
    kind = dict(left.dtypes)[column]
    v = left.select(F.col(column).alias("_v"), F.lit(0).cast("long").alias("_n")).distinct()
    p = points.select(F.col(point).cast(kind).alias("_v")).where("_v is not null").withColumn("_n", F.lit(1).cast("long"))
    both = v.unionByName(p).withColumn("_range", ranking.range_of([F.col("_v")], *ranking.boundaries(v, [F.col("_v")])))
    before = ranking._before(both, F.sum("_n"))
    order = [F.asc_nulls_first("_v"), F.asc("_n") if right else F.desc("_n")]  # of equal ones, points count for bin, not for binr
    seen = F.sum("_n").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_seen", seen).where("_n = 0").join(before, F.col("_range") == F.col("_r"))
    place = F.col("_seen") + F.coalesce("_before", F.lit(0)) - (0 if right else 1)
    return left.join(placed.select("_v", place.alias(out)), F.col(column).eqNullSafe(F.col("_v")), "left").select(*left.columns, out)
