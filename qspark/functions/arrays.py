"""Vector functions on array columns: maps, folds, scans, search, sets, sorting, slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col, eq

Fn = Callable[..., Column]


def _let(value: Column, f: Fn) -> Column:
    """f of a value that is made once, not for each element of the lambdas inside."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def til(n) -> Column:
    n = col(n).cast("long")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def map_(f: Fn, *xs) -> Column:
    if len(xs) == 1:
        return F.transform(col(xs[0]), f)
    zipped = F.arrays_zip(*(col(x).alias(f"x{k}") for k, x in enumerate(xs)))
    return F.transform(zipped, lambda p: f(*(p.getField(f"x{k}") for k in range(len(xs)))))


def map_left(f: Fn, x, ys) -> Column:
    """f of the atom on the left with each on the right."""
    return F.transform(col(ys), lambda y: f(col(x), y))


def map_right(f: Fn, xs, y) -> Column:
    return F.transform(col(xs), lambda x: f(x, col(y)))


def fold(f: Fn, xs) -> Column:
    """Reduce from the first element; an empty array gives null."""
    xs = col(xs)
    return F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), f))


def fold_left(f: Fn, xs, init) -> Column:
    """The function gets (element, accumulated)."""
    return F.aggregate(col(xs), col(init), lambda acc, x: f(x, acc))


def fold_right(f: Fn, init, xs) -> Column:
    return F.aggregate(F.reverse(col(xs)), col(init), lambda acc, x: f(x, acc))


#: Results that a scan gathers before they are put to the others: what one step copies.
SCAN_PART = 64


def _scanned(xs: Column, first: Column, f: Fn) -> Column:
    """first and all f(last result, x). Results are gathered in parts, so that a step doesn't copy all results so far."""
    start = F.struct(F.slice(F.array(first), 1, 0).alias("done"), first.alias("part"))

    def step(acc, x):
        more = F.concat(acc["part"], F.array(f(F.element_at(acc["part"], -1), x)))
        full = F.size(acc["part"]) >= SCAN_PART
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"), F.when(full, F.slice(more, -1, 1)).otherwise(more).alias("part"))

    return F.aggregate(xs, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["part"]))


def scan(f: Fn, xs) -> Column:
    """All the running results of fold."""
    return _let(col(xs), lambda v: F.when(F.size(v) > 0, _scanned(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1), f)).otherwise(v))


def scan_left(f: Fn, xs, init) -> Column:
    return _let(_scanned(col(xs), F.array(col(init)), lambda acc, x: f(x, acc)), lambda out: F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0))))


def scan_right(f: Fn, init, xs) -> Column:
    return F.reverse(scan_left(f, F.reverse(col(xs)), init))


def find(xs, y) -> Column:
    """First place, from 0; null if it isn't there. A null finds a null."""
    return F.nullif(F.array_position(F.transform(col(xs), lambda x: eq(x, y)), F.lit(True)), F.lit(0).cast("long")) - 1


def at(xs, i) -> Column:
    return F.get(col(xs), col(i))


def where(mask) -> Column:
    """Places of the true ones."""
    return F.transform(F.filter(F.transform(col(mask), lambda m, i: F.struct(m.alias("m"), i.cast("long").alias("i"))), lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["i"])


def filter_(xs, mask) -> Column:
    return F.transform(F.filter(F.arrays_zip(col(xs).alias("x"), col(mask).alias("m")), lambda p: F.coalesce(p["m"], F.lit(False))), lambda p: p["x"])


def take(xs, n: int, cyclic: bool = True) -> Column:
    """First n, last -n; beyond the length it begins again."""
    xs = col(xs)
    size = F.size(xs)
    m = abs(n)
    if not cyclic:
        return F.slice(xs, 1, m) if n >= 0 else F.slice(xs, F.greatest(size - m, F.lit(0)) + 1, m)
    start = F.lit(0) if n >= 0 else F.pmod(-F.lit(m), size)
    return F.when(size > 0, F.transform(til(m), lambda i: F.get(xs, F.pmod(i + start, size).cast("int")))).otherwise(xs)


def asc(xs) -> Column:
    """Nulls first."""
    return F.sort_array(col(xs), True)


def desc(xs) -> Column:
    return F.sort_array(col(xs), False)


def _places(xs, ascending: bool) -> Column:
    xs = col(xs)
    size = F.size(xs)
    pairs = F.transform(xs, lambda x, i: F.struct(x.alias("x"), (i if ascending else size - i).alias("i")))
    return F.transform(F.sort_array(pairs, ascending), lambda p: (p["i"] if ascending else size - p["i"]).cast("long"))


def iasc(xs) -> Column:
    return _places(xs, True)


def idesc(xs) -> Column:
    return _places(xs, False)


def _firsts(xs: Column) -> Column:
    """For each place of a sorted array, the first place with an equal value."""
    begin = F.filter(til(F.size(xs)), lambda k: (k == 0) | ~eq(F.get(xs, k.cast("int")), F.get(xs, k.cast("int") - 1)))
    return _let(begin, lambda b: F.flatten(F.transform(b, lambda s, k: F.array_repeat(s, (F.coalesce(F.get(b, k + 1), F.size(xs).cast("long")) - s).cast("int")))))


def rank(xs, ties: str = "place") -> Column:
    """Place in ascending order. Equal values stand there in their own order, or with ties='least' share the least of their places:
    how many values are smaller, as SQL counts them, so a null is neither smaller nor larger than any."""
    places = iasc(iasc(xs))
    if ties == "place":
        return places
    if ties != "least":
        raise ValueError(f"domain: no way to rank ties: {ties}")
    nulls = F.size(F.filter(col(xs), lambda x: x.isNull()))
    made = F.struct(_let(asc(xs), _firsts).alias("at"), nulls.alias("nulls"))
    return _let(made, lambda m: F.transform(places, lambda r: F.greatest(F.get(m["at"], r.cast("int")) - m["nulls"], F.lit(0).cast("long"))))


def xrank(xs, n, ties: str = "place") -> Column:
    xs = col(xs)
    return F.transform(rank(xs, ties), lambda r: F.floor(r * col(n) / F.size(xs)))


def bin_(xs, y) -> Column:
    """Last place with a value <= y in an ascending array, -1 if none."""
    return F.aggregate(col(xs), F.lit(-1).cast("long"), lambda acc, x: acc + (x <= col(y)).cast("long"))


def binr(xs, y) -> Column:
    """First place with a value >= y."""
    return F.aggregate(col(xs), F.lit(0).cast("long"), lambda acc, x: acc + (x < col(y)).cast("long"))


def reverse(xs) -> Column:
    return F.reverse(col(xs))


def distinct(xs) -> Column:
    return F.array_sort(F.array_distinct(col(xs)))


def union(a, b) -> Column:
    return F.array_union(col(a), col(b))


def _has(b, x: Column) -> Column:
    return F.exists(col(b), lambda y: eq(x, y))


def sect(a, b) -> Column:
    """Repeats and order of a stay."""
    return F.filter(col(a), lambda x: _has(b, x))


def except_(a, b) -> Column:
    return F.filter(col(a), lambda x: ~_has(b, x))


def concat(a, b) -> Column:
    return F.concat(col(a), col(b))


def raze(xs) -> Column:
    return F.flatten(col(xs))


def remove(xs, i) -> Column:
    return F.filter(col(xs), lambda x, k: k != col(i))


def alter(xs, f: Fn, i, v) -> Column:
    """f of the element at i and v in its place."""
    return F.transform(col(xs), lambda x, k: F.when(k == col(i), f(x, col(v))).otherwise(x))


def enlist(*xs) -> Column:
    return F.array(*map(col, xs))


def dict_(keys, values) -> Column:
    return F.map_from_arrays(col(keys), col(values))


def key(m) -> Column:
    return F.map_keys(col(m))


def value(m) -> Column:
    return F.map_values(col(m))


def group(xs) -> Column:
    """Value → places, values in order of first sight. By one sort of the array."""
    pairs = F.array_sort(F.transform(col(xs), lambda x, i: F.struct(x.alias("v"), i.cast("long").alias("i"))))

    def runs(p: Column) -> Column:
        begin = F.filter(til(F.size(p)), lambda k: (k == 0) | ~eq(F.get(p, k.cast("int"))["v"], F.get(p, k.cast("int") - 1)["v"]))
        own = lambda b: F.transform(b, lambda s, k: F.slice(p, s.cast("int") + 1, (F.coalesce(F.get(b, k + 1), F.size(p).cast("long")) - s).cast("int")))
        return _let(begin, own)

    made = F.transform(_let(pairs, runs), lambda g: F.struct(F.get(g, F.lit(0))["i"].alias("at"), F.get(g, F.lit(0))["v"].alias("v"), F.transform(g, lambda x: x["i"]).alias("places")))
    return _let(F.array_sort(made), lambda g: F.map_from_arrays(F.transform(g, lambda x: x["v"]), F.transform(g, lambda x: x["places"])))


def unify(xs, kind: str) -> Column:
    return col(xs).cast(f"array<{kind}>")
