"""Scalar semantics as Column compositions: two-valued comparisons, floor division, buckets, globs, casts.

Nulls: arithmetic gives null; comparisons treat null as the smallest value, equal to itself, and never give null.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import SPARK

EPOCH = "2000-01-01"
EPOCH_US = 946_684_800_000_000


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# comparisons
def eq(a, b) -> Column:
    return col(a).eqNullSafe(col(b))


def ne(a, b) -> Column:
    return ~eq(a, b)


def lt(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def gt(a, b) -> Column:
    return lt(b, a)


def le(a, b) -> Column:
    return ~lt(b, a)


def ge(a, b) -> Column:
    return ~lt(a, b)


def and_(*p) -> Column:
    return functools.reduce(operator.and_, map(col, p))


def or_(*p) -> Column:
    return functools.reduce(operator.or_, map(col, p))


def not_(p) -> Column:
    return ~col(p)


def in_(a, values: Sequence) -> Column:
    """Membership; a null is found if the set has one."""
    known = [v for v in values if v is not None]
    a = col(a)
    found = F.coalesce(a.isin(known), F.lit(False)) if known else F.lit(False)
    return found | a.isNull() if len(known) < len(values) else found


def within(a, lo, hi) -> Column:
    return ge(a, lo) & le(a, hi)


def nil(a) -> Column:
    return col(a).isNull()


def if_(c, a, b=None) -> Column:
    return F.when(col(c), col(a)).otherwise(col(b))


# arithmetic
def add(a, b) -> Column:
    return F.try_add(col(a), col(b))


def sub(a, b) -> Column:
    return F.try_subtract(col(a), col(b))


def mul(a, b) -> Column:
    return F.try_multiply(col(a), col(b))


def true_div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def _whole(a: Column) -> Column:
    """Is this a column of whole numbers? Known when the plan is made."""
    return F.typeof(a).isin("tinyint", "smallint", "int", "bigint")


def floor_div(a, b, like: str | None = None) -> Column:
    """Floor of the quotient; null for a zero divisor. Exact for whole numbers. like: a type to give the result, of the left operand by the language's rule."""
    a, b = col(a), col(b)
    q = F.when(_whole(a) & _whole(b), int_floor_div(a, b)).otherwise(F.floor(F.try_divide(a, b)))
    return q.cast(like) if like else q


def int_floor_div(a, b) -> Column:
    """Exact for whole numbers of any size, where a quotient as double is not."""
    a, b = col(a).cast("long"), F.nullif(col(b).cast("long"), F.lit(0).cast("long"))
    r = a % b
    r = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    return F.call_function("div", a - r, b)


def floor_mod(a, b) -> Column:
    """Remainder with the divisor's sign; null for a zero divisor."""
    a, b = col(a), F.nullif(col(b), F.lit(0))
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def neg(a) -> Column:
    return -col(a)


def round_(a) -> Column:
    return F.round(col(a), 0)


def floor_(a) -> Column:
    return F.floor(col(a)).cast("double")


def ceil_(a) -> Column:
    return F.ceil(col(a)).cast("double")


def xbar(a, w) -> Column:
    """Down to a multiple of w; null if w is 0."""
    a, w = col(a), F.nullif(col(w), F.lit(0))
    return a - floor_mod(a, w)


def xbar_date(a, days: int) -> Column:
    """Date buckets of whole days, counted from 2000-01-01."""
    since = F.datediff(col(a), F.lit(EPOCH).cast("date"))
    return F.date_add(F.lit(EPOCH).cast("date"), xbar(since, F.lit(days)).cast("int"))


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def xbar_ts(ts, width_us: int) -> Column:
    """Timestamp buckets counted from 2000-01-01; the session's zone is UTC."""
    us = micros(ts) - F.lit(EPOCH_US)
    return F.timestamp_micros(xbar(us, F.lit(width_us)) + F.lit(EPOCH_US)).cast("timestamp_ntz")


def ts_add(ts, us) -> Column:
    return F.timestamp_micros(micros(ts) + col(us)).cast("timestamp_ntz")


def ts_sub(a, b) -> Column:
    """Difference in nanoseconds."""
    return (micros(a) - micros(b)) * 1000


def date_time(d, ms) -> Column:
    """DATE + TIME."""
    return ts_add(col(d).cast("timestamp"), col(ms).cast("long") * 1000)


# strings
def glob_regex(pattern: str) -> str:
    """* any run, ? any one, [set] and [^set] classes, all else itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end]
            flip = inner.startswith("^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner[flip:])
            out.append(f"[{'^' if flip else ''}{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def like(a, pattern: str) -> Column:
    """Glob match; patterns of * and ? alone stay a LIKE, which the scan can use."""
    a = col(a)
    if not set(pattern) & set("[%_\\"):
        return F.coalesce(a.like(pattern.replace("*", "%").replace("?", "_")), F.lit(False))
    return F.coalesce(a.rlike(glob_regex(pattern)), F.lit(False))


def split(a, sep: str) -> Column:
    return F.split(col(a), re.escape(sep), -1)


def cut(a, at: Sequence[int]) -> Column:
    """An array cut at ascending indices."""
    a = col(a)
    ends = [*at[1:], None]
    return F.array(*(F.slice(a, i + 1, (F.size(a) - i) if e is None else F.lit(e - i)) for i, e in zip(at, ends, strict=True)))


def format_(pattern: str, *args) -> Column:
    """Each % is an argument's text."""
    parts = pattern.split("%")
    out = [F.lit(parts[0])]
    for k, p in enumerate(parts[1:]):
        out.append(col(args[k]).cast("string") if k < len(args) else F.lit("%"))
        out.append(F.lit(p))
    return F.concat(*out)


def cast(kind: str, a) -> Column:
    """Between the language's types; what can't be read is null."""
    a, kind = col(a), kind.upper()
    if kind == "DATE":
        text = F.regexp_replace(F.substring(a.cast("string"), 1, 10), r"\D", "-")
        return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(a.cast("string"))).cast("date")
    if kind == "TIMESTAMP":
        text = F.regexp_replace(a.cast("string"), r"^(\d{4})\D(\d{2})\D(\d{2})[DT ]", "$1-$2-$3T")
        return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4})\D(\d{2})\D(\d{2})$", "$1-$2-$3"))).cast("timestamp_ntz")
    if kind == "TIME":
        p = F.regexp_extract_all(a.cast("string"), F.lit(r"^(-?)(\d+):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$"), F.lit(0))
        part = lambda k: F.regexp_extract(a.cast("string"), r"^(-?)(\d+):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$", k)
        ms = (part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60 + part(4).try_cast("int")) * 1000 + F.coalesce(F.rpad(part(5), 3, "0").try_cast("int"), F.lit(0))
        return F.coalesce(F.when(F.size(p) > 0, F.when(part(1) == "-", -ms).otherwise(ms)), a.try_cast("int"))
    if kind == "B8":
        return F.coalesce(a.try_cast("boolean"), F.length(a.cast("string")) > 0)
    if kind == "GUID":
        return F.when(a.cast("string").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(a.cast("string")))
    return a.try_cast(SPARK[kind])
