"""Token ids in word-aligned Simple-8b files, and back.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit into 60 bits; selector 0 is the escape: the next word is
the id itself. Ids are cut into blocks of BLOCK, no word crosses one, and a file row keeps each block's word offset, so that any
block decodes alone and all words of a row decode in one vectorised step. A row holds whole documents in ascending doc_id order,
about ROW_IDS ids, and its first id's place in its shard; shards are ranges of doc_id. Rows are Parquet rows, so that files can be
in any store that Spark reaches.

Defined cases: a null or empty text is the end id alone. Equal doc_ids keep all their rows, in any order among themselves; null
ones come first. A row holds a very long text whole: writing takes some 20 bytes of memory an id of the row, reading some 8. An empty
table writes no row and reads back as no row. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, ready, stage, steps
from .tokens import coder, with_end

BLOCK, ROW_IDS = 512, 1 << 18
#: Blocks that the reader decodes in one vectorised step.
STEP_BLOCKS = 64

# Fixed values of the format: ids in a word for selectors 1 to 14; their width is 60 // count.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
_LEAST = (np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right") + 1).astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word offset of each block, and the places of escape words."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts = np.arange(0, n, block)
    room = np.minimum(np.tile(np.arange(block, 0, -1, dtype=np.int32), len(firsts))[:n], np.arange(n, 0, -1, dtype=np.int32))
    choice = np.zeros(n, np.int8)
    # the least selector whose width holds each id, from a table for small ids
    least = _LEAST[np.minimum(ids, len(_LEAST) - 1).astype(np.int64)]
    large = np.flatnonzero(ids >= len(_LEAST))
    least[large] = np.searchsorted(_LIMITS, ids[large], side="right") + 1
    for s in range(14, 0, -1):  # small counts first, so that the largest that fits stays
        c = int(COUNTS[s])
        if c > n:
            continue
        ok = least <= s
        run = 1  # do all ids of a word's length fit? By doubling, on bytes
        while 2 * run <= c:
            ok = ok[:-run] & ok[run:]
            run *= 2
        if run < c:
            ok = ok[: len(ok) - (c - run)] & ok[c - run :]
        if not ok.any():
            continue
        np.copyto(choice[: n - c + 1], s, where=ok & (room[: n - c + 1] >= c))
    hop = COUNTS[choice]
    pos, begins = firsts.copy(), np.zeros(n, bool)
    end = np.minimum(firsts + block, n)
    while len(pos):
        begins[pos] = True
        pos = pos + hop[pos]
        more = pos < end
        pos, end = pos[more], end[more]
    starts = np.flatnonzero(begins)
    sel = choice[starts]
    words = np.zeros(len(starts), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(sel == s)
        if len(own):
            at, word = starts[own], np.full(len(own), s << 60, np.uint64)
            for k in range(int(COUNTS[s])):
                word |= ids[at + k] << np.uint64(k * int(WIDTHS[s]))
            words[own] = word
    escape = np.flatnonzero(sel == 0)
    before = np.searchsorted(escape, np.arange(len(starts) + 1))  # escapes before each word
    if len(escape):
        words = np.insert(words, escape + 1, ids[starts[escape]])
    block_of = np.searchsorted(starts, firsts)
    return words, block_of + before[block_of], escape + np.arange(len(escape))


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of the words; escapes are the places of escape words among them."""
    if len(escapes):
        raw = words[escapes + 1]
        words = np.delete(words, escapes + 1)
        escapes = escapes - np.arange(len(escapes))
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    ends = np.cumsum(count)
    word = np.repeat(np.arange(len(words)), count)
    width = WIDTHS[sel]
    shift = ((np.arange(len(word)) - (ends - count)[word]) * width[word]).astype(np.uint64)
    out = (words[word] >> shift) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[word]
    if len(escapes):
        out[(ends - count)[escapes]] = raw
    return out


def decode_blocks(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The ids of blocks lo to hi - 1 alone."""
    a, b = int(blocks[lo]), int(blocks[hi]) if hi < len(blocks) else len(words)
    own = slice(*np.searchsorted(escapes, [a, b]))
    return decode(words[a:b], escapes[own] - a)


def decode_span(words: np.ndarray, blocks: np.ndarray, escapes: np.ndarray, start: int, length: int, block: int = BLOCK) -> np.ndarray:
    """Ids start to start + length - 1 of a row: a document without the rest of its row. Decodes only the blocks that hold them."""
    lo = start // block
    return decode_blocks(words, blocks, escapes, lo, -(-(start + length) // block))[start - lo * block :][:length]


FILE_SCHEMA = "shard int, first long, doc_ids array<long>, counts array<long>, blocks array<int>, escapes array<int>, words binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files into the shared folder; the returned table reads them (FILE_SCHEMA). One range shuffle of the texts."""
    ready(docs.sparkSession)

    def run(batches):
        shard, first = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def out():
            doc_ids = [i for x in held for i in x[0]]
            counts = np.concatenate([x[1] for x in held])
            words, blocks, escapes = encode(np.concatenate([x[2] for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([blocks.astype(np.int32)], pa.list_(pa.int32())), pa.array([escapes.astype(np.int32)], pa.list_(pa.int32())), arrow_bytes([words.tobytes()])], names=["shard", "first", "doc_ids", "counts", "blocks", "escapes", "words"])

        code = coder(tokenizer)
        for batch, texts in steps(batches, cache="coder"):
            flat, counts = with_end(*code.encode(texts), end_id)
            held.append((batch.column(0).to_pylist(), counts, flat))
            size += len(flat)
            if size >= ROW_IDS:
                yield out()
                first += size
                held, size = [], 0
        if held:
            yield out()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, FILE_SCHEMA), "tokens")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of each document, from the files alone."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                doc_ids, counts, blocks, escapes = (row[x].values for x in ("doc_ids", "counts", "blocks", "escapes"))
                counts, blocks, escapes = (x.to_numpy().astype(np.int64) for x in (counts, blocks, escapes))
                words = np.frombuffer(row["words"].as_buffer(), np.uint64)
                ids = np.concatenate([decode_blocks(words, blocks, escapes, b, min(b + STEP_BLOCKS, len(blocks))).astype("<u4") for b in range(0, len(blocks), STEP_BLOCKS)])
                ends = np.cumsum(counts)
                small = memoryview(ids.tobytes())
                crc = [zlib.crc32(small[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array([row["shard"].as_py()] * len(counts), pa.int32()), doc_ids, pa.array(row["first"].as_py() + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    rows = files.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    total = files.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = total.withColumn("base", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).select("shard", F.coalesce("base", F.lit(0)).alias("base"))
    out = rows.join(base, "shard")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
