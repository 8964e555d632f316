"""Ordered tables: a DataFrame and the column that orders its rows, with the query verbs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggs
from ..types import type_name
from . import ranking
from .joins import RID

By = str | Sequence[str] | Mapping[str, Column] | None


class Table:
    """rid: name of the ordering column; without one, an id in order of the scan is made and never shown."""

    def __init__(self, df: DataFrame, rid: str | None = None):
        self.hidden = rid is None
        if rid is None and RID not in df.columns:
            df = df.withColumn(RID, F.monotonically_increasing_id())
        self.full, self.rid = df, rid or RID

    @property
    def df(self) -> DataFrame:
        return self.full.drop(self.rid) if self.hidden else self.full

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _new(self, df: DataFrame) -> Table:
        t = Table(df, self.rid)
        t.hidden = self.hidden
        return t

    @staticmethod
    def _by(by: By) -> dict[str, Column]:
        if by is None:
            return {}
        if isinstance(by, str):
            return {by: F.col(by)}
        if isinstance(by, Mapping):
            return dict(by)
        return {b: F.col(b) for b in by}

    def select(self, out: Mapping[str, Column] | None = None, where: Column | None = None, by: By = None, take: int | None = None, aggregated: bool | None = None) -> Table:
        """Filter, group, map, then take, as the language orders them.

        by without out: the first row of each group. by with out: out holds aggregates; a plain column under by becomes the group's
        list (see `listed`). out without by: a row a row, or with aggregated=True one row.
        """
        d = self.full if where is None else self.full.where(where)  # a null is no match; bare, it is pushed into the scan
        keys = self._by(by)
        if keys:
            named = [e.alias(k) for k, e in keys.items()]
            if out:
                made = d.groupBy(*named).agg(*(e.alias(n) for n, e in out.items()), F.min(self.rid).alias(RID))
            else:
                rest = [c for c in self.columns if c not in keys]
                made = d.groupBy(*named).agg(F.min_by(F.struct(*rest), F.col(self.rid)).alias("_row"), F.min(self.rid).alias(RID)) if rest else d.groupBy(*named).agg(F.min(self.rid).alias(RID))
                made = made.select(*keys, *(F.col("_row")[c].alias(c) for c in rest), RID)
            t = Table(made)
        elif out and aggregated:
            t = Table(d.agg(*(e.alias(n) for n, e in out.items())))
        elif out:
            t = Table(d.select(*(e.alias(n) for n, e in out.items()), F.col(self.rid).alias(RID)))
        else:
            t = self._new(d)
        return t if take is None else t.take(take)

    def listed(self, column: str) -> Column:
        """For out under by: the group's values in row order."""
        return aggs.collected(F.col(column), F.col(self.rid))

    def update(self, out: Mapping[str, Column], where: Column | None = None, by: By = None) -> Table:
        """Without where, columns are replaced or added. With where, only rows that match; a column keeps its type, a new one is null elsewhere. With by, out holds aggregates that all rows of a group get."""
        keys = self._by(by)
        hit = None if where is None else F.coalesce(where, F.lit(False))
        d, kinds = self.full, dict(self.full.dtypes)
        if keys:
            w = Window.partitionBy(*keys.values())
            out = {n: e.over(w) if hit is None else e for n, e in out.items()}
            if hit is not None:
                # aggregates over the matching rows only
                agg = d.where(hit).groupBy(*(e.alias(f"_b_{k}") for k, e in keys.items())).agg(*(e.alias(f"_n_{n}") for n, e in out.items()))
                d = d.join(agg, [e.eqNullSafe(F.col(f"_b_{k}")) for k, e in keys.items()], "left")
                out = {n: F.col(f"_n_{n}") for n in out}
        for n, e in out.items():
            if hit is not None:
                old = F.col(n) if n in kinds else F.lit(None)
                e = F.when(hit, e.cast(kinds[n]) if n in kinds else e).otherwise(old)
            out = out | {n: e}
        d = d.withColumns(dict(out))
        return self._new(d.select(*(c for c in d.columns if not c.startswith(("_b_", "_n_")))))

    def _aligned(self, rows: DataFrame) -> DataFrame:
        kinds = dict(self.df.dtypes)
        if unknown := [c for c in rows.columns if c not in kinds and c != self.rid]:
            raise ValueError(f"value: unknown columns {unknown}")
        return rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns))

    def _after(self) -> Column:
        """Ids for appended rows: larger than all so far."""
        last = self.full.agg(F.max(self.rid)).first()[0]
        return F.lit((-1 if last is None else int(last)) + 1) + F.monotonically_increasing_id()

    def insert(self, rows: DataFrame) -> Table:
        """Append by name; missing columns are null."""
        new = self._aligned(rows)
        if self.hidden:
            new = new.withColumn(self.rid, self._after())
        return self._new(self.full.unionByName(new, allowMissingColumns=True))

    def upsert(self, keys: int | Sequence[str], rows: DataFrame, order: str | None = None) -> Table:
        """Rows whose keys exist overwrite the columns they bring, others are appended. Of equal keys in rows, the last by order counts."""
        keys = self.columns[:keys] if isinstance(keys, int) else list(keys)
        new = self._aligned(rows)
        given = [c for c in new.columns if c not in keys]
        new = new.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
        one = new.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.max_by(F.struct(F.lit(True).alias("_hit"), *given), "_at").alias("_n"), F.max("_at").alias("_at"))
        j = self.full.withColumn("_old", F.lit(True)).join(one, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "full")
        old, hit = F.coalesce(F.col("_old"), F.lit(False)), F.coalesce(F.col("_n")["_hit"], F.lit(False))
        out = []
        for c in self.full.columns:
            if c in keys:
                e = F.when(old, F.col(c)).otherwise(F.col(f"_k_{c}"))
            elif c in given:
                e = F.when(hit, F.col("_n")[c]).otherwise(F.col(c))
            elif c == self.rid and self.hidden:
                e = F.coalesce(F.col(c), self._after())
            else:
                e = F.col(c)
            out.append(e.alias(c))
        return self._new(j.select(*out))

    def alter(self, f: Callable[..., Column], column: str, *value) -> Table:
        """f of a column (and a value) in its place."""
        return self._new(self.full.withColumn(column, f(F.col(column), *value)))

    def modify(self, f: Callable[..., Column], path: Sequence[str], *value) -> Table:
        """The same for a field within a struct column."""
        column, *inner = path
        if not inner:
            return self.alter(f, column, *value)
        field = ".".join(inner)
        return self._new(self.full.withColumn(column, F.col(column).withField(field, f(F.col(f"{column}.{field}"), *value))))

    def at(self, what: str | Sequence[str]) -> DataFrame:
        return self.df.select(*([what] if isinstance(what, str) else what))

    def take(self, n: int, start: int | None = None, cyclic: bool = False) -> Table:
        """First n, last -n, or n from start, by row order. cyclic: beyond the end it begins again."""
        size = None
        if cyclic and abs(n) > (size := self.count()):
            if not size:
                return self
            times = -(-abs(n) // size)
            rounds = self.full.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
            order = [F.asc("_round"), F.asc(self.rid)] if n > 0 else [F.desc("_round"), F.desc(self.rid)]
            d = rounds.orderBy(*order).limit(abs(n)).withColumn(self.rid, F.monotonically_increasing_id() if n > 0 else -F.monotonically_increasing_id())
            return self._new(d.drop("_round"))
        if start is not None:
            return self._new(self.full.orderBy(self.rid).offset(start).limit(n))
        if n < 0:
            return self._new(self.full.orderBy(F.desc(self.rid)).limit(-n))
        return self._new(self.full.orderBy(self.rid).limit(n))

    def xasc(self, *columns: str) -> DataFrame:
        return ranking.xasc(self.full, columns, [self.rid]).drop(*[self.rid] * self.hidden)

    def xdesc(self, *columns: str) -> DataFrame:
        return ranking.xdesc(self.full, columns, [self.rid]).drop(*[self.rid] * self.hidden)

    def reverse(self) -> DataFrame:
        return ranking.reverse(self.full, self.rid).drop(*[self.rid] * self.hidden)

    def count(self) -> int:
        return self.full.count()

    def meta(self) -> list[tuple[str, str]]:
        return [(f.name, type_name(f)) for f in self.df.schema.fields]

    def show(self, n: int = 20) -> None:
        self.full.orderBy(self.rid).drop(*[self.rid] * self.hidden).show(n)
