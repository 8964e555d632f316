"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenizes its documents, cuts those longer than a sequence, and packs its pieces best-fit, longest first. Bins that are
nearly full are emitted; underfull bins become items (a length and the bins in it) that are dealt to fewer tasks, each of at most
TASK_ITEMS, and packed best-fit again, until one task has seen all that is left or a round no longer saves bins.

Defined cases: a null or empty text is its end id alone, a piece of length 1. Repeated rows are packed each by itself; equal
lengths go in the order of arrival. An empty table gives no rows. Only doc_id and text are read, so clashing names don't matter. A
very long text is a step of its own; it takes some 40 bytes of memory a token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stage, steps
from .tokens import coder, with_end

LENGTH, END_ID = 2048, 0
#: A bin with this share of a sequence left, or less, is nearly full.
NEARLY = 1 / 64
#: Most items that one task packs in a later round, and that a first-round task holds before it packs.
TASK_ITEMS = 100_000
#: A round that saves a smaller share of bins is the last.
LEAST_SAVED = 0.002


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the filled length of each bin: longest items first, each into the fullest bin with room."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    filled: list[int] = []
    free = 0  # bit r is set if a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = free >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = size, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if r > n:
            room[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, np.array(filled, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, filled long"


def pieces(docs: DataFrame, tokenizer: str, size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, packed within their task."""

    def run(batches):
        code = coder(tokenizer)
        held: list = []
        count, made = 0, TaskContext.get().partitionId() << 33

        def out():
            nonlocal made
            cols = [np.concatenate([x[k] for x in held]) for k in range(1, 5)]
            ids = pa.concat_arrays([x[0] for x in held])
            bins, at, filled = best_fit(cols[2], size)
            batch = pa.RecordBatch.from_arrays([ids, pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(bins + made), pa.array(at), pa.array(filled[bins])], names=[x.split()[0] for x in PIECES.split(", ")])
            made += len(filled)
            return batch

        for batch, texts in steps(batches, cache="coder"):
            flat, counts = with_end(*code.encode(texts), end_id)
            parts = -(-counts // size)
            doc = np.repeat(np.arange(len(counts)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            short = np.where(counts % size, counts % size, size)  # the first piece, if cut
            start = np.where(piece == 0, 0, short[doc] + (piece - 1) * size)
            length = np.where(piece == 0, short[doc], size)
            raw = flat.astype("<u4").tobytes()
            a = (np.cumsum(counts) - counts)[doc] + start
            crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(a.tolist(), length.tolist(), strict=True)), np.int64, len(a))
            held.append((batch.column(0).take(pa.array(doc)), piece, start, length, crc))
            count += len(doc)
            if count >= TASK_ITEMS:
                yield out()
                held, count = [], 0
        if held:
            yield out()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PIECES)


ITEMS = "id long, filled long, members array<struct<bin:long,at:long>>"


def _merge(items: DataFrame, tasks: int, size: int, turn: int = 0) -> DataFrame:
    """One round: items dealt over tasks, to other neighbours each round, packed best-fit, each new bin an item."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        filled = table.column("filled").to_numpy()
        members = table.column("members").to_pylist()
        bins, at, total = best_fit(filled, size)
        made: list[list[dict]] = [[] for _ in total]
        for k, (b, x) in enumerate(zip(bins.tolist(), at.tolist(), strict=True)):
            made[b] += [{"bin": m["bin"], "at": m["at"] + x} for m in members[k]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0]["bin"] for x in made], pa.int64()), pa.array(total), pa.array(made, pa.list_(pa.struct([("bin", pa.int64()), ("at", pa.int64())])))], names=["id", "filled", "members"])

    return items.repartition(tasks, F.xxhash64("id", F.lit(turn))).mapInArrow(run, ITEMS)


def pack(docs: DataFrame, tokenizer: str, size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece. Texts are read once and never shuffled."""
    ready(docs.sparkSession)
    nearly = size - int(size * NEARLY)
    made = stage(pieces(docs, tokenizer, size, end_id), "pieces")
    items = made.where((F.col("at") == 0) & (F.col("filled") < nearly)).select(F.col("bin").alias("id"), "filled", F.array(F.struct("bin", F.lit(0).cast("long").alias("at"))).alias("members"))
    left, done = items.count(), []
    while left > 1:
        tasks = -(-left // TASK_ITEMS)
        merged = stage(_merge(items, tasks, size, len(done)), "bins")
        full, items = merged.where(F.col("filled") >= nearly), merged.where(F.col("filled") < nearly)
        total, rest = merged.count(), items.count()
        done.append(full)
        last, left = left, rest
        if tasks == 1 or last - total < LEAST_SAVED * last:
            break
    done.append(items)
    bins = done[0]
    for x in done[1:]:
        bins = bins.unionByName(x)
    place = bins.select(F.col("id").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.at").alias("shift"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = made.where(F.col("filled") >= nearly).select(*keep, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = made.where(F.col("filled") < nearly).join(place, "bin").select(*keep, "sequence_id", (F.col("at") + F.col("shift")).alias("offset"))
    return whole.unionByName(moved)
