"""Shared pieces: the cluster's shared folder, bounded text batches, word codes, packed exchange between chunks and hash buckets."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: What one vectorised step holds of raw text; a longer document is a step of its own.
STEP_BYTES = 2 << 20


#: Settings of the workers' memory: what a step has freed goes back to the machine, not to a pool of the worker.
WORKER = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver was started in another folder, and return freed memory."""
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, env.get("PYTHONPATH")) if x)
    for k, v in WORKER.items():
        env.setdefault(k, v)
    return spark


#: Caches of this Python worker, by name, as functions that empty them.
caches: dict[str, Callable[[], None]] = {}
_last = -1


def new_task(cache: str = "") -> None:
    """At the start of a task: a worker that comes from another stage gives up the caches that this one doesn't use."""
    global _last
    task = TaskContext.get()
    if task is not None and task.stageId() != _last:
        _last = task.stageId()
        for name, clear in caches.items():
            if name != cache:
                clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset and all runs on this machine (tests), a folder of it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="qspark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str, table: str | None) -> None:
    try:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    With `by` it is bucketed by that column, as many buckets as the session has shuffle partitions, so that joins on it don't
    shuffle it again.
    """
    spark = df.sparkSession
    own = f"qspark_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    atexit.register(_delete, spark, path, own if by else None)
    if by:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, by).option("path", path).saveAsTable(own)
        return spark.table(own)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES, cache: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most `most` text bytes (at least one row each), with their texts as UTF-8; a null text is empty."""
    new_task(cache)
    for batch in batches:
        raw = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()), b"")
        sizes = np.asarray(pc.binary_length(raw), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at), raw.slice(at, upto - at).to_pylist()
            at = upto


class Codes(dict):
    """Word → 64-bit code, kept over the life of a Python worker up to a bounded number of words."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = Codes()
caches["words"] = _codes.clear


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def shingle_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of n codes."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = mixed(codes[:m] + _MIX)
    for k in range(1, n):
        h = mixed(h * _MIX + codes[k : k + m])
    return h


def windows_of(codes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within lists of `counts` codes each, and where each list's windows start (one more at the end)."""
    starts = np.cumsum(counts) - counts
    h = shingle_hashes(codes, n)
    have = np.maximum(counts - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(have)])
    return h[np.repeat(starts - at[:-1], have) + np.arange(at[-1])], at


def word_windows(lists: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    return windows_of(word_codes([w for x in lists for w in x]), np.array([len(x) for x in lists], np.int64), n)


_zc, _zd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _zc.compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return _zd.decompress(raw)


def pack_sorted(u: np.ndarray) -> bytes:
    """Ascending uint64 values as differences, byte planes apart, compressed."""
    d = u.copy()
    d[1:] -= u[:-1]
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def arrow_bytes(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def chunks(docs: DataFrame, most: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """documents → rows of about `most` raw bytes: chunk, raw (bytes), ids, sizes, compressed texts, and rest (the columns in `keep`); kept in the shared folder.

    A row is the unit that is dealt to tasks later; a longer document makes a chunk of its own. The table is bucketed by chunk: joins
    on it don't shuffle it again.
    """

    def pack(batches):
        held: list = []
        size = 0

        def out():
            ids = pa.concat_arrays([x[0] for x in held])
            raw = [t for x in held for t in x[1]]
            body, sizes = b"".join(raw), np.array([len(t) for t in raw], np.int64).tobytes()
            with_ids = b",".join(b"" if i is None else b"%d" % i for i in ids.to_pylist())
            key = xxhash.xxh64_intdigest(body, xxhash.xxh64_intdigest(with_ids + sizes)) >> 1
            rest = b""
            if keep:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][2].schema) as w:
                    for x in held:
                        w.write_batch(x[2])
                rest = squeeze(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([len(body)], pa.int64()), *(arrow_bytes([squeeze(x)]) for x in (with_ids, sizes, body)), arrow_bytes([rest])], names=["chunk", "raw", "ids", "sizes", "body", "rest"])

        for batch, texts in steps(batches, most=min(most, STEP_BYTES)):
            held.append((batch.column(0), texts, batch.select(list(keep)) if keep else None))
            size += sum(map(len, texts)) + 16 * len(texts)
            if size >= most:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep).mapInArrow(pack, "chunk long, raw long, ids binary, sizes binary, body binary, rest binary")
    # Two chunks with all the same ids and texts would share a key; a number of the written row tells them apart.
    return stage(packed.withColumn("chunk", F.xxhash64("chunk", F.monotonically_increasing_id())), "chunks", "chunk")


def open_rest(rest: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(rest)).read_all()


def open_chunk(ids: bytes, sizes: bytes, body: bytes) -> tuple[list[int | None], np.ndarray, bytes]:
    raw = unsqueeze(ids)
    n = np.frombuffer(unsqueeze(sizes), np.int64)
    return [int(x) if x else None for x in raw.split(b",")], n, unsqueeze(body)
