"""CSV files, splayed (single) and parted (date-partitioned) tables, journals, serialization."""

from __future__ import annotations

import datetime
import decimal
import json
import os
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from ..types import SPARK, no_sentinels, schema


def read_csv(spark: SparkSession, kinds: Sequence[str], path: str, sep: str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """A header row gives the names, the declared types are mandatory; an empty or unreadable field is null."""
    if names is None:
        head = spark.read.option("sep", sep).option("header", True).csv(path)
        names = head.columns
    want = schema(names, kinds)
    # Dates take any separator and times become milliseconds, so these are read as text and cast.
    text = {"DATE", "TIME", "TIMESTAMP", "B8", "GUID"}
    raw = T.StructType([T.StructField(f.name, T.StringType() if k.upper() in text else f.dataType) for f, k in zip(want.fields, kinds, strict=True)])
    df = spark.read.schema(raw).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    return df.select(*((expr.cast(k, F.col(f.name)) if k.upper() in text else F.col(f.name)).alias(f.name, metadata=f.metadata) for f, k in zip(want.fields, kinds, strict=True)))


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    """A folder of part files, written in parallel; single: one file, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def set_splayed(df: DataFrame, path: str) -> None:
    """Columnar files with dictionary pages in the place of a symbol file."""
    if not path.endswith("/"):
        raise ValueError("a splayed table's path ends in /")
    df.write.mode("overwrite").parquet(path)


def get_splayed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def set_parted(df: DataFrame, path: str, by: str = "Date") -> None:
    """One folder a value. Rows of one value are dealt to one task first, with AQE splitting large ones."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def get_parted(spark: SparkSession, path: str, by: str = "Date", columns: T.StructType | None = None) -> DataFrame:
    """Reads a parted table; predicates on the partition column prune folders. All partitions must have one schema."""
    df = spark.read.schema(columns).parquet(path) if columns else spark.read.option("mergeSchema", False).parquet(path)
    if by not in df.columns:
        raise ValueError(f"no partition column {by}")
    return df.select(by, *(c for c in df.columns if c != by))


def load(spark: SparkSession, path: str) -> str:
    """A table's folder becomes a view with the folder's name."""
    name = os.path.basename(path.rstrip("/"))
    spark.read.parquet(path).createOrReplaceTempView(name)
    return name


def set_name(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def get_name(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text."""
    return spark.read.text(path, wholetext=True)


def ser(x: Any) -> bytes:
    """A value, or a small table, as bytes. A table is an Arrow stream, so its types come back as they are; a value is JSON."""
    if isinstance(x, DataFrame):
        import pyarrow as pa

        table, sink = x.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return b"T" + x.schema.json().encode() + b"\n" + sink.getvalue().to_pybytes()

    def plain(v):
        for name, kind in (("ts", datetime.datetime), ("date", datetime.date)):
            if isinstance(v, kind):
                return {name: v.isoformat()}
        if isinstance(v, decimal.Decimal):
            return {"decimal": str(v)}
        return {"bytes": bytes(v).hex()}

    return b"V" + json.dumps({"value": x}, default=plain).encode()


def de(data: bytes, spark: SparkSession | None = None) -> Any:
    if data[:1] == b"T":
        import pyarrow as pa

        schema, raw = data[1:].split(b"\n", 1)
        return spark.createDataFrame(pa.ipc.open_stream(raw).read_all(), T.StructType.fromJson(json.loads(schema)))
    kinds = {"ts": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": decimal.Decimal, "bytes": bytes.fromhex}

    def back(v):
        (name, text), = v.items() if len(v) == 1 else ((None, None),)
        return kinds[name](text) if name in kinds else v

    return json.loads(data[1:], object_hook=back)["value"]


class Journal:
    """Append-only log of small tables or values in a folder: what a file handle writes, and its replay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.open = spark, path, True

    def close(self) -> None:
        self.open = False

    def write(self, x: Any) -> None:
        if not self.open:
            raise ValueError("io: the handle is closed")
        row = [(int(datetime.datetime.now().timestamp() * 1e6), bytearray(ser(x)))]
        self.spark.createDataFrame(row, "at long, message binary").coalesce(1).write.mode("append").parquet(self.path)

    def read(self, f: Callable[[Any], Any]) -> tuple[int, int]:
        """Call f with each message in order; (read, total)."""
        log = self.spark.read.parquet(self.path).orderBy("at")
        n = 0
        for r in log.toLocalIterator():
            f(de(bytes(r["message"]), self.spark))
            n += 1
        return n, log.count()


def table(spark: SparkSession, names: Sequence[str], columns: Iterable, kinds: Sequence[str] | None = None) -> DataFrame:
    """From columns of one length; an atom is repeated."""
    columns = list(columns)
    sizes = {len(c) for c in columns if isinstance(c, (list, tuple))}
    if len(sizes) > 1:
        raise ValueError(f"length: columns of {sorted(sizes)} rows")
    n = sizes.pop() if sizes else 1
    full = [list(c) if isinstance(c, (list, tuple)) else [c] * n for c in columns]
    if kinds:
        return no_sentinels(spark.createDataFrame(list(zip(*full, strict=True)), schema(names, kinds)))
    if n == 0:
        return spark.createDataFrame([], T.StructType([T.StructField(x, T.StringType()) for x in names]))
    return spark.createDataFrame([tuple(r) for r in zip(*full, strict=True)], list(names))


def til(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "x")


def rand(spark: SparkSession, n: int, most: int, seed: int | None = None) -> DataFrame:
    return spark.range(n).select((F.rand(seed) * most).cast("long").alias("x"))


def guid(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.expr("uuid()").alias("x"))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts by the language's type names."""
    return df.withColumns({c: expr.cast(k, F.col(c)).cast(SPARK[k.upper()]) for c, k in kinds.items()})
