"""Names of the language's types, their Spark types, and null normalisation at the boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The language's type names. Bytes are unsigned, so they take a short; TIME is milliseconds since midnight.
SPARK: dict[str, T.DataType] = {
    "B8": T.BooleanType(),
    "U8": T.ShortType(),
    "I16": T.ShortType(),
    "I32": T.IntegerType(),
    "I64": T.LongType(),
    "F64": T.DoubleType(),
    "SYMBOL": T.StringType(),
    "C8": T.StringType(),
    "STRING": T.StringType(),
    "ENUM": T.StringType(),
    "GUID": T.StringType(),
    "DATE": T.DateType(),
    "TIME": T.IntegerType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
SENTINELS = {"smallint": -(2**15), "int": -(2**31), "bigint": -(2**63)}


def field(name: str, kind: str) -> T.StructField:
    kind = kind.upper()
    return T.StructField(name, SPARK[kind], True, {"logical": "time_ms"} if kind == "TIME" else {"logical": kind.lower()})


def schema(names: Sequence[str], kinds: Sequence[str]) -> T.StructType:
    if len(names) != len(kinds):
        raise ValueError(f"length: {len(names)} names, {len(kinds)} types")
    return T.StructType([field(n, k) for n, k in zip(names, kinds, strict=True)])


def type_name(f: T.StructField) -> str:
    """The language's name for a column's type."""
    if f.metadata.get("logical") == "time_ms":
        return "TIME"
    if (x := str(f.metadata.get("logical", "")).upper()) in SPARK and isinstance(f.dataType, type(SPARK[x])):
        return x
    kinds = {"boolean": "B8", "tinyint": "I16", "smallint": "I16", "int": "I32", "bigint": "I64", "float": "F64", "double": "F64", "string": "SYMBOL", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    name = f.dataType.simpleString()
    return kinds.get(name, "LIST" if name.startswith("array") else "DICT" if name.startswith(("struct", "map")) else name.upper())


def no_sentinels(df: DataFrame) -> DataFrame:
    """Integer minima, NaN and all-zero GUIDs, which stand for null outside, become NULL."""

    def clean(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in SENTINELS:
            c = F.when(c != SENTINELS[kind], c)
        elif kind in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast(kind))
        elif f.metadata.get("logical") == "guid":
            c = F.nullif(c, F.lit("00000000-0000-0000-0000-000000000000"))
        return c.alias(f.name, metadata=f.metadata)

    return df.select(*map(clean, df.schema.fields))
