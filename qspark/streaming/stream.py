"""Structured Streaming: bucketed aggregates with late data, appends, upserts, timers, as-of against a static table.

What the reference does with timers and messages is here a streaming query with a trigger; watermarks and late data go beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(form)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def bucketed(df: DataFrame, time: str, width: str, aggs: Mapping[str, Column], by: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by time bucket (and keys); rows later than `late` behind the newest are left out and state is dropped."""
    ts = F.col(time).cast("timestamp")
    d = df.withColumn(time, ts).withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("_w"), *by).agg(*(e.alias(n) for n, e in aggs.items())).select(F.col("_w.start").alias("bucket"), *by, *aggs)


def sessions(df: DataFrame, time: str, gap: str, aggs: Mapping[str, Column], by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    d = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*(e.alias(n) for n, e in aggs.items())).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *aggs)


def insert(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a table."""
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start(path)


def upsert(df: DataFrame, keys: Sequence[str], order: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge each batch into a table of versions: the last by order of each key wins; a version is written whole, then becomes current."""
    spark = df.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        jvm, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        old = f"{path}/v{number - 1}"
        rows = batch
        if number and jvm(old).getFileSystem(conf).exists(jvm(old)):
            rows = spark.read.parquet(old).unionByName(batch, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
        last.select(*keys, *(F.col("_r")[c].alias(c) for c in rest)).write.mode("overwrite").parquet(f"{path}/v{number}")

    w = df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that upsert wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [str(s.getPath().getName()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return spark.read.parquet(f"{path}/v{max(int(n[1:]) for n in names if n[0] == 'v')}")


def timer(spark: SparkSession, ms: int, f: Callable[[int], None], count: int | None = None) -> StreamingQuery:
    """Call f about every ms milliseconds, count times: a rate source and a processing-time trigger. Stop the query to delete it."""
    fired = 0
    box: list[StreamingQuery] = []

    def run(batch: DataFrame, number: int) -> None:
        nonlocal fired
        if count is None or fired < count:
            f(fired)
            fired += 1

    q = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(run).trigger(processingTime=f"{ms} milliseconds").start()
    box.append(q)
    return q


def enrich(stream: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First-match lookup of a stream in a static table."""
    from ..operators.joins import first_rows

    return stream.join(first_rows(table, keys), list(keys), "left")
