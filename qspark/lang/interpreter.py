"""Evaluates forms: plain values on the driver, tables as DataFrames, query expressions as Columns.

An expression over a query's columns becomes an Expr. Aggregates make aggregate Exprs; under `by`, an Expr that isn't one is the
group's list. Everything that touches a table stays a plan until a result is asked for.
"""

from __future__ import annotations

import datetime
import os
import platform
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import udf
from ..functions import aggs, arrays, expr
from ..operators import joins, ranking, sets
from ..operators.table import Table
from ..sources import io
from . import vectors as V
from .reader import EPOCH, Call, Name, Quoted, Stamp, Sym, Time, Vec, parse


class Expr:
    """A Column with what it is in a query: a row's value, an aggregate, or a set of distinct values."""

    def __init__(self, c: Column, agg: bool = False, kind: str = ""):
        self.c, self.agg, self.kind = c, agg, kind


class Return(Exception):
    def __init__(self, value: Any):
        self.value = value


class Raised(Exception):
    """An error that a script raised."""


class Lambda:
    def __init__(self, params: list[str], body: list, scope: dict):
        self.params, self.body, self.scope = params, body, scope


class Enum(Vec):
    """Symbols as places in a named domain."""

    def __init__(self, domain: str, known: list, places: list[int]):
        super().__init__(known[k] for k in places)
        self.domain, self.places = domain, Vec(places)


def literal(x: Any) -> Column:
    if isinstance(x, Expr):
        return x.c
    if isinstance(x, Column):
        return x
    if isinstance(x, Stamp):
        return F.lit(EPOCH + datetime.timedelta(microseconds=int(x) // 1000)).cast("timestamp_ntz")
    if isinstance(x, list):
        return F.array(*map(literal, x))
    return F.lit(int(x) if isinstance(x, Time) else str(x) if isinstance(x, str) else x)


def sample(t: DataFrame, name: str) -> list:
    """A column of a table as a plain vector; for results and scripts, not inside operators."""
    kind = dict(t.dtypes)[name]
    out = [r[0] for r in t.select(name).collect()]
    if kind.startswith("timestamp"):
        return Vec(None if v is None else Stamp(int((v.replace(tzinfo=None) - EPOCH) / datetime.timedelta(microseconds=1)) * 1000) for v in out)
    return Vec(Vec(v) if isinstance(v, list) else v for v in out)


FORMS = {"select", "update", "set", "let", "do", "if", "fn", "quote", "try", "timeit", "window-join", "window-join1"}


class Interpreter:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.globals: dict[str, Any] = {}
        self.functions = self._functions()

    # evaluation
    def run(self, text: str) -> Any:
        """Value of a script's last form."""
        out = None
        for form in parse(text):
            out = self.eval(form, {})
        return out

    def lookup(self, name: str, scope: dict) -> Any:
        if name in scope:
            return scope[name]
        if name in self.globals:
            return self.globals[name]
        if name in self.functions or name in FORMS:
            return self.functions.get(name, Name(name))
        raise NameError(f"value: {name} is not defined")

    def eval(self, x: Any, scope: dict) -> Any:
        if isinstance(x, Name):
            return self.lookup(x, scope)
        if isinstance(x, Quoted):
            return x.what
        if isinstance(x, Vec):
            return Vec(Sym(v) if isinstance(v, Name) else self.eval(v, scope) for v in x)
        if isinstance(x, dict):
            return {k: self.eval(v, scope) for k, v in x.items()}
        if not isinstance(x, Call):
            return x
        if not x:
            return None
        head = x[0]
        if isinstance(head, Name) and head in FORMS and head not in scope:
            return getattr(self, "form_" + head.replace("-", "_"))(x[1:], scope)
        f = self.eval(head, scope)
        return self.call(f, [self.eval(a, scope) for a in x[1:]])

    def call(self, f: Any, args: list) -> Any:
        if isinstance(f, Lambda):
            if len(args) != len(f.params):
                raise TypeError(f"arity: expected {len(f.params)} arguments")
            scope = f.scope | dict(zip(f.params, args, strict=True)) | {"self": f}
            try:
                out = None
                for b in f.body:
                    out = self.eval(b, scope)
                return out
            except Return as r:
                return r.value
        if isinstance(f, (Vec, dict, Table)):
            return self.functions["at"](f, *args)
        return f(*args)

    def columnwise(self, f: Any) -> Callable[..., Column]:
        """A function of the language as one of Columns."""
        return lambda *cs: literal(self.call(f, [Expr(c) for c in cs]))

    # special forms
    def form_set(self, a, scope):
        value = self.eval(a[1], scope)
        if isinstance(a[0], str) and not isinstance(a[0], (Name, Sym)):
            self._save(a[0], value)
        else:
            self.globals[str(a[0])] = value
        return value

    def form_let(self, a, scope):
        scope[str(a[0])] = self.eval(a[1], scope)
        return scope[str(a[0])]

    def form_do(self, a, scope):
        out, inner = None, scope
        for x in a:
            out = self.eval(x, inner)
        return out

    def form_if(self, a, scope):
        c = self.eval(a[0], scope)
        if isinstance(c, Expr):
            return Expr(expr.if_(c.c, literal(self.eval(a[1], scope)), literal(self.eval(a[2], scope)) if len(a) > 2 else None), c.agg)
        return self.eval(a[1], scope) if c else self.eval(a[2], scope) if len(a) > 2 else None

    def form_fn(self, a, scope):
        return Lambda([str(p) for p in a[0]], a[1:], dict(scope))

    def form_quote(self, a, scope):
        return a[0]

    def form_try(self, a, scope):
        try:
            return self.eval(a[0], scope)
        except Return:
            raise
        except Exception as e:  # noqa: BLE001  the language hands any error to the handler
            h = self.eval(a[1], scope)
            return self.call(h, [str(e)]) if isinstance(h, Lambda) or callable(h) else h

    def form_timeit(self, a, scope):
        n = a[0] if len(a) > 1 and isinstance(a[0], int) else 1
        began = time.perf_counter()
        for _ in range(n):
            x = self.eval(a[-1], scope)
            if isinstance(x, Table):
                x.df.write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - began) * 1000

    def _columns(self, t: Table, scope: dict) -> dict:
        return scope | {c: Expr(F.col(c), kind="timestamp" if k.startswith("timestamp") else "") for c, k in t.df.dtypes}

    def _by(self, what: Any, t: Table, inner: dict) -> dict[str, Column]:
        if isinstance(what, dict):
            return {k: literal(self.eval(v, inner)) for k, v in what.items()}
        if isinstance(what, Name):
            return {str(what): literal(self.eval(what, inner))}
        if isinstance(what, Vec):
            return {str(v): F.col(str(v)) for v in what}
        used = [str(v) for v in _names(what) if str(v) in t.columns]
        return {(used or ["By"])[0]: literal(self.eval(what, inner))}

    def form_select(self, a, scope):
        q = dict(a[0])
        t = self.table(self.eval(q.pop("from"), scope))
        inner = self._columns(t, scope)
        where, by, take = q.pop("where", None), q.pop("by", None), q.pop("take", None)
        cond = None if where is None else literal(self.eval(where, inner))
        keys = None if by is None else self._by(by, t, inner)
        made = {n: self.eval(e, inner) for n, e in q.items()}
        made = {n: e if isinstance(e, Expr) else Expr(literal(e), agg=not isinstance(e, list)) for n, e in made.items()}
        n = None if take is None else self.eval(take, scope)
        if keys is not None:
            out = {k: e.c if e.agg else aggs.distinct(e.c) if e.kind == "distinct" else aggs.collected(e.c, F.col(t.rid)) for k, e in made.items()}
            return t.select(out, cond, keys, n)
        if any(e.kind == "distinct" for e in made.values()) and len(made) == 1:
            (name, e), = made.items()
            return Table((t.full if cond is None else t.full.where(cond)).select(e.c.alias(name)).distinct())
        whole = bool(made) and all(e.agg for e in made.values()) and any(_mentions(q[k], t.columns) for k in made)
        return t.select({k: e.c for k, e in made.items()}, cond, None, n, aggregated=whole)

    def form_update(self, a, scope):
        q = dict(a[0])
        source = q.pop("from")
        t = self.table(self.eval(source, scope))
        inner = self._columns(t, scope)
        where, by = q.pop("where", None), q.pop("by", None)
        keys = None if by is None else self._by(by, t, inner)
        out = {n: literal(self.eval(e, inner)) for n, e in q.items()}
        return self._back(source, t.update(out, None if where is None else literal(self.eval(where, inner)), keys))

    def _back(self, source: Any, t: Table) -> Table:
        if isinstance(source, (Sym, Quoted)):
            self.globals[str(source.what if isinstance(source, Quoted) else source)] = t
        return t

    def _window(self, a, scope, f):
        keys = [str(k) for k in self.eval(a[0], scope)]
        l, r = self.table(self.eval(a[2], scope)), self.table(self.eval(a[3], scope))
        bounds = self.eval(a[1], scope)
        inner = self._columns(r, scope)
        made = {n: self.eval(e, inner).c for n, e in a[4].items()}
        left = l.full
        if isinstance(bounds[0], list):  # plain vectors, one value a row
            lo, hi = (F.array(*map(literal, b)) for b in bounds)
            rows = ranking.rank(left, l.rid, out="_n")
            left, at = rows, F.col("_n").cast("int")
            lo, hi = F.get(lo, at), F.get(hi, at)
        else:
            lo, hi = literal(bounds[0]), literal(bounds[1])
        out = f(keys[:-1], keys[-1], lo, hi, left, r.df, made)
        keep = [c for c in out.columns if c != "_n"]
        t = Table(out.select(*keep), l.rid)
        t.hidden = l.hidden
        return t

    def form_window_join(self, a, scope):
        return self._window(a, scope, joins.window_join)

    def form_window_join1(self, a, scope):
        return self._window(a, scope, joins.window_join1)

    # values
    def table(self, x: Any) -> Table:
        if isinstance(x, Table):
            return x
        if isinstance(x, DataFrame):
            return Table(x)
        if isinstance(x, str):
            return self.table(self.globals[x] if x in self.globals else self.spark.table(x))
        raise TypeError("type: a table is needed")

    def _save(self, path: str, value: Any) -> None:
        if isinstance(value, Table):
            io.set_splayed(value.df, path if path.endswith("/") else path + "/")
        else:
            with open(path, "wb") as f:
                f.write(io.ser(value))

    def _get(self, x):
        if isinstance(x, Sym):
            return self.globals[x] if x in self.globals else Table(self.spark.table(x))
        if os.path.isfile(x):
            with open(x, "rb") as f:
                return io.de(f.read(), self.spark)
        return Table(io.get_splayed(self.spark, x))

    def _load(self, path):
        if path.endswith("/"):
            name = os.path.basename(path.rstrip("/"))
            self.globals[name] = Table(io.get_splayed(self.spark, path))
            return self.globals[name]
        with open(path) as f:
            return self.run(f.read())

    def _read(self, x):
        if isinstance(x, io.Journal):
            return list(x.read(lambda m: self.run(m) if isinstance(m, str) else m))
        return io.read_text(self.spark, x).first()[0]

    def _column(self, name: str, values: Any, n: int) -> tuple[list, Any]:
        full = list(values) if isinstance(values, list) else [values] * n
        one = next((v for v in full if v is not None), None)
        kind = {bool: "boolean", int: "bigint", float: "double", Time: "int", datetime.date: "date", Stamp: "timestamp_ntz"}.get(type(one), "string")
        if isinstance(one, float) or any(isinstance(v, float) for v in full):
            kind, full = "double", [None if v is None else float(v) for v in full]
        if isinstance(one, Stamp):
            full = [None if v is None else EPOCH + datetime.timedelta(microseconds=int(v) // 1000) for v in full]
        elif isinstance(one, Time):
            full = [None if v is None else int(v) for v in full]
        elif isinstance(one, list):
            kind, full = f"array<{self._column(name, one, 0)[1]}>", [list(v) for v in full]
        elif kind == "string":
            full = [None if v is None else str(v) for v in full]
        return full, kind

    def _table(self, names, columns):
        sizes = {len(c) for c in columns if isinstance(c, list)}
        if len(sizes) > 1:
            raise ValueError("length: columns of different lengths")
        n = sizes.pop() if sizes else 1
        made = [self._column(str(x), c, n) for x, c in zip(names, columns, strict=True)]
        schema = ", ".join(f"`{x}` {k}" for x, (_, k) in zip(names, made, strict=True)) + ", _rid bigint"
        rows = [(*r, i) for i, r in enumerate(zip(*(v for v, _ in made), strict=True))] if n else []
        t = Table(self.spark.createDataFrame(rows, schema), "_rid")
        t.hidden = True
        return t

    def _rows(self, t: Table, x: Any) -> DataFrame:
        """Rows to insert: atoms, vectors, a dict or a table."""
        if isinstance(x, Table):
            return x.df
        names, values = (list(x), list(x.values())) if isinstance(x, dict) else (t.columns[: len(x)], list(x))
        if unknown := [n for n in names if n not in t.columns]:
            raise ValueError(f"value: unknown columns {unknown}")
        return self._table(names, values).df

    # functions
    def _functions(self) -> dict[str, Callable]:
        def dual(plain, column, agg=False):
            """On Exprs a Column function, else plain."""

            def f(*args):
                if any(isinstance(a, Expr) for a in args):
                    over = any(isinstance(a, Expr) and a.agg for a in args)
                    return Expr(column(*map(literal, args)), agg or over)
                return plain(*args)

            return f

        def table_or(table, other):
            return lambda x, *a: table(x, *a) if isinstance(x, Table) else other(x, *a)

        def count(x):
            if isinstance(x, Table):
                return x.count()
            if isinstance(x, Expr):
                return Expr(aggs.count_distinct(x.c) if x.kind == "distinct" else aggs.count(), True)
            return V.count(x)

        def distinct(x):
            if isinstance(x, Expr):
                return Expr(x.c, kind="distinct")
            return Table(sets.distinct(x.df)) if isinstance(x, Table) else V.distinct(x)

        def at(x, i):
            if isinstance(x, Table):
                if isinstance(i, str):
                    return sample(x.full.orderBy(x.rid), i)
                if isinstance(i, list) and i and isinstance(i[0], str):
                    return Table(x.at([str(k) for k in i]))
                places = V.as_list(i)
                found = {r["_n"]: r for r in ranking.rank(x.full, x.rid, out="_n").where(F.col("_n").isin(places)).collect()}
                row = [{c: found[k][c] if k in found else None for c in x.columns} for k in places]
                return row if isinstance(i, list) else row[0]
            return Expr(arrays.at(literal(x), literal(i))) if isinstance(x, Expr) else V.at(x, i)

        def cast(kind, x):
            return Expr(expr.cast(str(kind), x.c), x.agg) if isinstance(x, Expr) else V.cast(kind, x)

        def plus(a, b):
            return self._temporal(expr.add, a, b, 1)

        def minus(a, b):
            return self._temporal(expr.sub, a, b, -1)

        def in_(x, s):
            if isinstance(x, Expr):
                return Expr(expr.in_(x.c, [v if not isinstance(v, (Stamp, Time)) else literal(v) for v in V.as_list(s)]), x.agg)
            return V.in_(x, s)

        def floor_div(a, b):
            return expr.floor_div(a, b)

        def xbar(a, w):
            if isinstance(a, Expr):
                if isinstance(w, Time):
                    return Expr(expr.xbar_ts(a.c, int(w) * 1000), a.agg)
                return Expr(expr.xbar(a.c, literal(w)), a.agg)
            return V.xbar(a, w)

        def higher(plain, column):
            def f(fn, *args):
                if any(isinstance(a, Expr) for a in args):
                    return Expr(column(self.columnwise(fn), *map(literal, args)))
                return plain(lambda *v: self.call(fn, list(v)), *args)

            return f

        def each(fn, *xs):
            n = max((len(x) for x in xs if isinstance(x, list)), default=None)
            return fn(*xs) if n is None else Vec(fn(*(x[k] if isinstance(x, list) else x for x in xs)) for k in range(n))

        def folded(fn, xs):
            out = xs[0] if xs else None
            for x in xs[1:]:
                out = fn(out, x)
            return out

        def scanned(fn, xs, init=None, flip=False):
            out, acc, first = Vec(), init, init is None
            for x in xs:
                acc, first = x if first else fn(x, acc) if flip else fn(acc, x), False
                out.append(acc)
            return out

        def fold_left(fn, xs, init):
            for x in xs:
                init = fn(x, init)
            return init

        def insert(t, rows):
            made = self.table(t)
            return self._back(t, made.insert(self._rows(made, rows)))

        def upsert(t, n, rows):
            made = self.table(t)
            return self._back(t, made.upsert(n, self._rows(made, rows)))

        def alter(x, fn, *rest):
            target = self.globals[x] if isinstance(x, Sym) else x
            if isinstance(target, Table):
                out = target.alter(self.columnwise(fn), str(rest[0]), *map(literal, rest[1:]))
            elif len(rest) == 1:
                out = self.call(fn, [target, rest[0]])
            else:
                out = Vec(target) if isinstance(target, list) else dict(target)
                out[rest[0]] = self.call(fn, [out[rest[0]], rest[1]])
            return self._put(x, out)

        def modify(x, fn, path, value):
            target = self.globals[x] if isinstance(x, Sym) else x
            path = V.as_list(path)
            if isinstance(target, Table):
                return self._put(x, target.modify(self.columnwise(fn), [str(p) for p in path], literal(value)))

            def go(v, rest):
                if not rest:
                    return self.call(fn, [v, value])
                out = Vec(v) if isinstance(v, list) else dict(v)
                out[rest[0]] = go(out[rest[0]], rest[1:])
                return out

            return self._put(x, go(target, path))

        def join(f):
            def g(keys, l, r):
                a, b = self.table(l), self.table(r)
                out = f([str(k) for k in V.as_list(keys)], a.full, b.full.withColumnRenamed(b.rid, "_o"), order="_o").drop("_o")
                t = Table(out, a.rid)
                t.hidden = a.hidden
                return t

            return g

        def asof(keys, l, r):
            a, b = self.table(l), self.table(r)
            names = [str(k) for k in keys]
            t = Table(joins.asof_join(names[:-1], names[-1], a.full, b.full.withColumnRenamed(b.rid, "_o"), order="_o").drop("_o"), a.rid)
            t.hidden = a.hidden
            return t

        def nil(x):
            return Expr(expr.nil(x.c), x.agg) if isinstance(x, Expr) else x is None

        def raise_(x):
            raise Raised(x)

        def return_(x):
            raise Return(x)

        def refuse(name):
            def f(*_):
                raise PermissionError(f"{name}: not offered by this engine")

            return f

        def hopen(x, *_):
            if ":" in x and not x.startswith(("/", ".")) and "://" not in x:
                raise PermissionError("hopen: sockets are not offered; use Spark Connect")
            return io.Journal(self.spark, x)

        def write(h, x):
            h.write(x.df if isinstance(x, Table) else x)

        def show(x):
            if isinstance(x, Table):
                x.show()
            else:
                print(V.text(x))

        def println(pattern, *args, end="\n"):
            print(V.format_(pattern, *args), end=end)

        def now(kind):
            def f(zone="local"):
                t = datetime.datetime.now(datetime.timezone.utc if str(zone) == "utc" else None).replace(tzinfo=None)
                if kind == "date":
                    return t.date()
                ms = ((t.hour * 60 + t.minute) * 60 + t.second) * 1000 + t.microsecond // 1000
                return Time(ms) if kind == "time" else Stamp(int((t - EPOCH) / datetime.timedelta(microseconds=1)) * 1000)

            return f

        def sort(ascending):
            def f(t, cols):
                out = (t.xasc if ascending else t.xdesc)(*[str(c) for c in V.as_list(cols)])
                return Table(out)

            return f

        def take(x, n):
            if isinstance(x, Table):
                return x.take(n[1], start=n[0]) if isinstance(n, list) else x.take(n, cyclic=True)
            return Expr(arrays.take(x.c, n)) if isinstance(x, Expr) else V.take(x, n)

        def except_(a, b):
            if isinstance(a, Table):
                return Table(sets.except_(a.df, b.df if isinstance(b, Table) else [str(c) for c in V.as_list(b)]))
            return Expr(arrays.except_(a.c, literal(b))) if isinstance(a, Expr) else V.except_(a, b)

        def binary_set(table, plain, column):
            def f(a, b):
                if isinstance(a, Table):
                    return Table(table(a.df, b.df))
                return Expr(column(literal(a), literal(b))) if isinstance(a, Expr) or isinstance(b, Expr) else plain(a, b)

            return f

        def first(x):
            return Expr(aggs.first(x.c, F.col(joins.RID)), True) if isinstance(x, Expr) else V.first(x)

        def last(x):
            return Expr(aggs.last(x.c, F.col(joins.RID)), True) if isinstance(x, Expr) else V.last(x)

        def concat(a, b):
            if isinstance(a, Table):
                return Table(sets.concat(a.df, b.df))
            return Expr(arrays.concat(literal(a), literal(b))) if isinstance(a, Expr) or isinstance(b, Expr) else V.concat(a, b)

        def key(x):
            return Vec(map(Sym, x.columns)) if isinstance(x, Table) else Vec(x) if isinstance(x, dict) else x

        def value(x):
            return [sample(x.full.orderBy(x.rid), c) for c in x.columns] if isinstance(x, Table) else Vec(x.values()) if isinstance(x, dict) else x

        def filter_(x, m):
            if isinstance(x, Table):
                ranked = ranking.rank(x.full, x.rid, out="_n")
                mask = self._table(["_m", "_k"], [m, Vec(range(len(m)))]).df
                return Table(ranked.join(mask, F.col("_n") == F.col("_k")).where("_m").select(*x.columns))
            return Expr(arrays.filter_(x.c, literal(m))) if isinstance(x, Expr) else V.filter_(x, m)

        one = lambda plain, column: dual(plain, column)
        agg = lambda plain, column: dual(plain, column, agg=True)
        f = {
            "+": plus, "-": minus, "*": one(V.mul, expr.mul), "/": one(V.floor_div, floor_div), "div": one(V.true_div, expr.true_div), "%": one(V.mod, expr.floor_mod), "neg": one(V.neg, expr.neg),
            "round": one(V.round_, expr.round_), "floor": one(V.floor_, expr.floor_), "ceil": one(V.ceil_, expr.ceil_), "xbar": xbar,
            "==": one(V.eq, expr.eq), "!=": one(V.ne, expr.ne), "<": one(V.lt, expr.lt), ">": one(V.gt, expr.gt), "<=": one(V.le, expr.le), ">=": one(V.ge, expr.ge),
            "and": one(V.and_, expr.and_), "or": one(V.or_, expr.or_), "not": one(V.not_, expr.not_), "in": in_, "nil?": nil,
            "within": lambda x, b: Expr(expr.within(x.c, literal(b[0]), literal(b[1])), x.agg) if isinstance(x, Expr) else V.within(x, b),
            "like": lambda x, p: Expr(expr.like(x.c, p), x.agg) if isinstance(x, Expr) else V.like(x, p),
            "sum": agg(V.sum_, aggs.sum_), "avg": agg(V.avg, aggs.avg), "min": agg(V.min_, aggs.min_), "max": agg(V.max_, aggs.max_), "med": agg(V.med, aggs.med), "dev": agg(V.dev, aggs.dev),
            "count": count, "first": first, "last": last, "distinct": distinct, "row": lambda x: Expr(aggs.rows(F.col(joins.RID)), True) if isinstance(x, Expr) else Vec(range(V.count(x))), "group": lambda x: Expr(arrays.group(x.c)) if isinstance(x, Expr) else V.group(x),
            "rank": one(V.rank, arrays.rank), "xrank": one(V.xrank, arrays.xrank), "iasc": one(V.iasc, arrays.iasc), "idesc": one(V.idesc, arrays.idesc), "asc": one(V.asc, arrays.asc), "desc": one(V.desc, arrays.desc),
            "xasc": sort(True), "xdesc": sort(False), "reverse": table_or(lambda t: Table(t.reverse()), one(V.reverse, arrays.reverse)),
            "union": binary_set(sets.union, V.union, arrays.union), "sect": binary_set(sets.sect, V.sect, arrays.sect), "except": except_, "concat": concat, "raze": one(V.raze, arrays.raze), "remove": one(V.remove, arrays.remove),
            "where": one(V.where, arrays.where), "filter": filter_, "find": one(V.find, arrays.find), "bin": one(V.bin_, arrays.bin_), "binr": one(V.binr, arrays.binr), "at": at, "take": take,
            "left-join": join(joins.left_join), "inner-join": join(joins.inner_join), "asof-join": asof,
            "insert": insert, "upsert": upsert, "alter": alter, "modify": modify,
            "til": one(V.til, arrays.til), "rand": V.rand, "guid": V.guid, "list": lambda *a: list(a), "enlist": lambda *a: Expr(arrays.enlist(*map(literal, a))) if any(isinstance(x, Expr) for x in a) else Vec(a), "dict": lambda k, v: dict(zip(k, v, strict=True)),
            "table": self._table, "enum": self._enum, "unify": lambda x: Vec(x) if len({type(v) for v in x}) <= 1 else x, "diverse": lambda x: list(x),
            "key": key, "value": value, "meta": lambda t: self._meta(t), "type": lambda x: Sym("TABLE") if isinstance(x, Table) else V.type_(x), "as": cast,
            "split": lambda x, s: Expr(expr.split(x.c, s) if isinstance(s, str) else expr.cut(x.c, s)) if isinstance(x, Expr) else V.split(x, s), "format": lambda p, *a: Expr(expr.format_(p, *map(literal, a))) if any(isinstance(x, Expr) for x in a) else V.format_(p, *a),
            "map": higher(each, arrays.map_), "pmap": higher(each, arrays.map_), "map-left": higher(lambda g, x, ys: Vec(g(x, y) for y in ys) if isinstance(ys, list) else g(x, ys), arrays.map_left), "map-right": higher(lambda g, xs, y: Vec(g(x, y) for x in xs) if isinstance(xs, list) else g(xs, y), arrays.map_right),
            "fold": higher(folded, arrays.fold), "fold-left": higher(fold_left, arrays.fold_left), "fold-right": higher(lambda g, init, xs: fold_left(g, xs[::-1], init), arrays.fold_right),
            "scan": higher(scanned, arrays.scan), "scan-left": higher(lambda g, xs, init: scanned(g, xs, init, True), arrays.scan_left), "scan-right": higher(lambda g, init, xs: Vec(scanned(g, xs[::-1], init, True)[::-1]), arrays.scan_right), "apply": lambda g, *a: each(lambda *v: self.call(g, list(v)), *a) if isinstance(g, Lambda) else self.call(g, list(a)),
            "read-csv": lambda kinds, path, sep=",": Table(io.read_csv(self.spark, [str(k) for k in kinds], path, sep)), "write-csv": lambda path, t, sep=",": io.write_csv(t.df, path, sep, single=True),
            "set-splayed": lambda path, t, *_: io.set_splayed(t.df, path), "get-splayed": lambda path, *_: Table(io.get_splayed(self.spark, path)), "set-parted": lambda path, t: io.set_parted(t.df, path), "get-parted": lambda path, name=None: Table(io.get_parted(self.spark, path)),
            "get": self._get, "load": self._load, "read": self._read, "write": write, "hopen": hopen, "hclose": lambda h: h.close(), "ser": lambda x: io.ser(x.df if isinstance(x, Table) else x), "de": lambda b: self._table_or(io.de(b, self.spark)),
            "show": show, "print": lambda p, *a: println(p, *a, end=""), "println": println, "date": now("date"), "time": now("time"), "timestamp": now("timestamp"),
            "raise": raise_, "return": return_, "parse": lambda s: parse(s)[-1], "eval": lambda x: self.eval(x, {}), "resolve": lambda s: self.globals.get(str(s), self.functions.get(str(s))), "loadfn": self._loadfn,
            "timer": self._timer, "env": lambda *_: dict(self.globals), "internals": lambda *_: sorted(self.functions), "args": lambda *_: dict(self.spark.sparkContext.getConf().getAll()), "memstat": lambda *_: self._memory(), "sysinfo": lambda *_: {"cores": os.cpu_count(), "system": platform.system(), "spark": self.spark.version}, "gc": lambda *_: self.spark.sparkContext._jvm.System.gc() or 0, "rc": lambda x: 1 + sum(v is x for v in self.globals.values()),
            "os-get-var": lambda n: os.environ.get(n), "os-set-var": lambda n, v: os.environ.__setitem__(n, v), "system": refuse("system"), "exit": refuse("exit"),
        }
        f["="] = f["=="]
        f["csv"], f["lj"], f["ij"], f["aj"] = f["read-csv"], f["left-join"], f["inner-join"], f["asof-join"]
        return f

    def _enum(self, domain: str, symbols: Any) -> Enum:
        known = self.globals[str(domain)]
        places = V.find(known, symbols)
        if None in V.as_list(places):
            raise ValueError(f"domain: not all symbols are in {domain}")
        return Enum(str(domain), known, V.as_list(places))

    def _loadfn(self, source: str, name: str, n: int = 1) -> Callable:
        """A compiled function of n arguments: of a Java class, or one that the session has under this name if the class is empty."""
        if source:
            udf.load_java(self.spark, str(name), source)

        def f(*args):
            if len(args) != n:
                raise TypeError(f"arity: {name} takes {n} arguments")
            return Expr(F.call_function(str(name), *map(literal, args)))

        return f

    def _table_or(self, x):
        return Table(x) if isinstance(x, DataFrame) else Vec(x) if isinstance(x, list) else x

    def _put(self, x: Any, value: Any) -> Any:
        if isinstance(x, Sym):
            self.globals[x] = value
        return value

    def _temporal(self, plain: Callable, a: Any, b: Any, sign: int) -> Any:
        if not any(isinstance(x, Expr) for x in (a, b)):
            return (V.add if sign > 0 else V.sub)(a, b)
        agg = any(isinstance(x, Expr) and x.agg for x in (a, b))
        if isinstance(b, Time) and isinstance(a, Expr):
            # a TIME column holds whole milliseconds, a TIMESTAMP column moves by an interval
            ms = int(b) * sign
            return Expr(expr.ts_add(a.c, F.lit(ms * 1000)) if a.kind == "timestamp" else plain(a.c, F.lit(int(b))), agg)
        return Expr(plain(literal(a), literal(b)), agg)

    def _meta(self, x: Any) -> Any:
        if isinstance(x, Table):
            return self._table(["name", "type"], [Vec(Sym(n) for n, _ in x.meta()), Vec(Sym(k) for _, k in x.meta())])
        return {"type": V.type_(x), "len": V.count(x)}

    def _memory(self) -> dict:
        r = self.spark.sparkContext._jvm.Runtime.getRuntime()
        return {"total": r.totalMemory(), "free": r.freeMemory(), "max": r.maxMemory()}

    def _timer(self, *a):
        from ..streaming import stream

        if len(a) == 1:
            a[0].stop()
            return None
        ms, n, fn = a
        return stream.timer(self.spark, ms, lambda k: self.call(fn, [k]), n or None)


def _names(x: Any):
    if isinstance(x, Name):
        yield x
    elif isinstance(x, (list, tuple)):
        for y in x:
            yield from _names(y)
    elif isinstance(x, dict):
        for y in x.values():
            yield from _names(y)


def _mentions(x: Any, columns: list[str]) -> bool:
    return any(str(n) in columns for n in _names(x))

