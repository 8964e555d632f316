"""Packed exchange: chunks send arrays to buckets (ranges of a 64-bit key), buckets send answers back to chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_task

_TOP = 1 << 64
#: Most tasks of an exchange; with more buckets, a task has several, one after the other.
MOST_TASKS = 50_000


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in ascending keys, and the end."""
    return np.searchsorted(keys, np.array([b * _TOP // buckets for b in range(buckets)], np.uint64)).tolist() + [len(keys)]


def rows_of(batches):
    """Rows as dicts, one at a time: a row holds a whole chunk."""
    new_task()
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def dealt(sent: DataFrame, buckets: int) -> DataFrame:
    """Buckets to tasks, so many that a task has one or a few."""
    return sent.repartition(min(buckets, MOST_TASKS), "key").sortWithinPartitions("key", "chunk")


def collected(answers: DataFrame, name: str) -> DataFrame:
    """A chunk's bits from all buckets in a row: bounded by the chunk's size."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def by_key(batches, key: str = "key"):
    """Tables of one key each from batches that come sorted by it; only one key is held."""
    new_task()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
