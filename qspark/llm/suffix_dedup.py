"""Removal of repeated byte strings by suffix arrays over the whole corpus.

A byte goes if a string of LEAST bytes that covers it also starts in a document with a smaller doc_id.

Every LEAST-byte string is keyed by the smallest hash of its K-byte strings (a minimizer): equal strings have equal keys, and
neighbours mostly share one. A maximal run of string starts with one key is a
segment (a run of more than LONGEST, several). Texts are packed into chunks; then

1. each chunk sends its distinct keys, with counts, to buckets (ranges of the key), and gets back two bits a key: is it in another
   chunk as well, and is it so frequent that its segments need to be spread further;
2. each chunk sends the distinct contents of its segments with shared keys, each once with the chunk's smallest doc_id (of frequent
   keys: the contents of single strings, keyed by their own hash), to buckets;
3. a bucket joins equal contents, builds an enhanced suffix array over the others of one key range, and finds the maximal repeat
   groups: common-prefix intervals by a stack scan that are left-diverse. A string of a content goes if a group that covers it has
   a smaller doc_id than the content; a bit for each goes back;
4. each chunk joins the bits to its documents and cuts.

Copies never meet in one task more than once a chunk, so a group of any size is spread; nothing is sampled or dropped.

Defined cases: a null text is empty, and stays. A document with a null doc_id has no order: it loses nothing and removes nothing.
Rows of one doc_id do not remove each other's strings. Texts under LEAST bytes stay whole. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import esa
from .common import arrow_bytes, chunks, mixed, open_chunk, open_rest, pack_sorted, ready, squeeze, stage, unpack_sorted, unsqueeze
from .exchange import bucket_edges, by_key, collected, dealt, rows_of

LEAST, K = 50, 24
#: Most strings of a segment.
LONGEST = 96

@dataclass(frozen=True)
class Plan:
    """Sizes of the pieces of work; results do not depend on them."""

    #: Raw text bytes of a chunk.
    chunk: int = 4 << 20
    #: Raw text bytes behind a bucket of keys, and behind one of contents.
    key_bucket: int = 8 << 20
    content_bucket: int = 6 << 20
    #: From more than this many segments on, a key's strings are spread one by one.
    frequent: int = 2_000
    #: Symbols of one suffix array, about; a key's contents stay together.
    array: int = 1 << 16


def key_minima(body: np.ndarray) -> np.ndarray:
    """Key of the LEAST-byte string at each place of body (length len(body) - LEAST + 1)."""
    n, w = len(body) - LEAST + 1, LEAST - K + 1
    out = np.empty(max(0, n), np.uint64)
    cut = 1 << 15  # in runs that stay in the processor's cache
    for a in range(0, n, cut):
        b = body[a : min(n, a + cut) + LEAST - 1]
        x = b.astype(np.uint64)
        for s in (1, 2, 4):
            x = x[:-s] | x[s:] << np.uint64(8 * s)
        m = len(b) - K + 1
        h = mixed(x[:m] * np.uint64(0x9E3779B97F4A7C15) + mixed(x[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(x[16 : 16 + m])))
        size = 1
        while size * 2 <= w:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        if size < w:
            h = np.minimum(h[: len(h) - (w - size)], h[w - size :])
        out[a : a + len(h)] = h
    return out


class Segments:
    """The runs of string starts of one chunk: start, strings (how many starts), key and doc (its place in the chunk)."""

    def __init__(self, ids: list[int | None], sizes: np.ndarray, body: bytes):
        raw = np.frombuffer(body, np.uint8)
        self.key = self.start = self.strings = self.doc = np.zeros(0, np.int64)
        if len(raw) < LEAST:
            self.key = self.key.astype(np.uint64)
            return
        m = key_minima(raw)
        ends = np.cumsum(sizes)
        valid = np.zeros(len(m) + 1, bool)
        for i, a, s in zip(ids, (ends - sizes).tolist(), sizes.tolist(), strict=True):
            if i is not None and s >= LEAST:
                valid[a : a + s - LEAST + 1] = True
        new = valid[:-1].copy()
        new[1:] &= ~valid[:-2] | (m[1:] != m[:-1])
        last = valid[:-1] & (~valid[1:] | np.concatenate([new[1:], [True]]))
        start = np.flatnonzero(new)
        strings = np.flatnonzero(last) - start + 1
        # A text that repeats one short string has one key for long; pieces of it are mostly equal, and suffixes stay short.
        parts = -(-strings // LONGEST)
        step = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        self.start = np.repeat(start, parts) + step
        self.strings = np.minimum(np.repeat(strings, parts) - step, LONGEST)
        self.key = mixed(m[self.start])  # minima are small; mixed, they spread evenly over the buckets
        self.doc = np.searchsorted(ends, self.start, side="right")


def _send_keys(chunk_rows: DataFrame, buckets: int, plan: Plan) -> DataFrame:
    def run(batches):
        for row in rows_of(batches):
            keys, counts = np.unique(Segments(*open_chunk(row["ids"], row["sizes"], row["body"])).key, return_counts=True)
            edges = bucket_edges(keys, buckets)
            full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
            if full:
                cut = [slice(edges[b], edges[b + 1]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), arrow_bytes([pack_sorted(keys[c]) for c in cut]), arrow_bytes([squeeze(counts[c].astype(np.uint32).tobytes()) for c in cut])], names=["key", "chunk", "keys", "counts"])

    sent = chunk_rows.mapInArrow(run, "key int, chunk long, keys binary, counts binary")

    def answer(batches):
        for t in by_key(batches):
            own = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
            counts = [np.frombuffer(unsqueeze(x), np.uint32) for x in t.column("counts").to_pylist()]
            every = np.concatenate(own)
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            u, chunks_with = every[first], np.diff(np.concatenate([first, [len(every)]]))
            del every
            total = np.zeros(len(u), np.int64)
            at = [np.searchsorted(u, x) for x in own]
            for k, c in zip(at, counts, strict=True):
                total[k] += c
            shared, frequent = chunks_with > 1, total > plan.frequent
            yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), pa.array([t.column("key")[0].as_py()] * len(at), pa.int32()), arrow_bytes([squeeze(np.packbits(np.concatenate([shared[k], frequent[k]])).tobytes()) for k in at])], names=["chunk", "bucket", "bits"])

    return dealt(sent, buckets).mapInArrow(answer, "chunk long, bucket int, bits binary")


def _marks(seg: Segments, answers: list | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the segments: key shared between documents or chunks; key frequent."""
    keys, inverse = np.unique(seg.key, return_inverse=True)
    low, high = np.full(len(keys), 1 << 60, np.int64), np.full(len(keys), -1, np.int64)
    np.minimum.at(low, inverse, seg.doc)
    np.maximum.at(high, inverse, seg.doc)
    shared, frequent = low < high, np.zeros(len(keys), bool)
    edges = bucket_edges(keys, buckets)
    for x in answers or []:
        a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
        bits = np.unpackbits(np.frombuffer(unsqueeze(x["bits"]), np.uint8), count=2 * (b - a)).astype(bool)
        shared[a:b] |= bits[: b - a]
        frequent[a:b] |= bits[b - a :]
    return shared[inverse], frequent[inverse]


def _distinct(body: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the byte strings at start: the place of the first of each distinct one, which of these each is, and their 64-bit hashes. Told apart by 128 bits."""
    view = memoryview(body)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)])
    hashes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, h[new, 0]


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Units:
    """A chunk's distinct contents that may repeat, by key: key, start and strings, smallest doc_id, and whether another document of the chunk has it.

    A segment of a frequent key is its strings, one unit each. Strings of all units stand in a row; `spot` holds the places there of
    the strings of all uses (start, doc_id), and `use` each one's use.
    """

    def __init__(self, ids: list[int | None], body: bytes, seg: Segments, answers: list | None, buckets: int):
        shared, frequent = _marks(seg, answers, buckets)
        at = np.flatnonzero(shared)
        self.start, strings = seg.start[at], seg.strings[at]
        self.doc_id = np.array([i or 0 for i in ids], np.int64)[seg.doc[at]]
        # distinct segments
        one, which, _ = _distinct(body, self.start, strings + (LEAST - 1))
        low, high = np.full(len(one), 1 << 62, np.int64), np.full(len(one), -(1 << 62), np.int64)
        np.minimum.at(low, which, self.doc_id)
        np.maximum.at(high, which, self.doc_id)
        size, spread, start = strings[one], frequent[at][one], self.start[one]
        # units: distinct segments, and the distinct strings of those with frequent keys
        whole, apart = np.flatnonzero(~spread), np.flatnonzero(spread)
        single = _runs(start[apart], size[apart])
        first, unit_of, hashes = _distinct(body, single, np.full(len(single), LEAST, np.int64))
        owner = np.repeat(apart, size[apart])
        one_low, one_high = np.full(len(first), 1 << 62, np.int64), np.full(len(first), -(1 << 62), np.int64)
        np.minimum.at(one_low, unit_of, low[owner])
        np.maximum.at(one_high, unit_of, high[owner])
        keys = np.concatenate([seg.key[at][one[whole]], hashes])
        order = np.argsort(keys, kind="stable")  # the same each time, as the chunk is
        self.keys = keys[order]
        self.at = np.concatenate([start[whole], single[first]])[order]
        self.strings = np.concatenate([size[whole], np.ones(len(first), np.int64)])[order]
        self.least = np.concatenate([low[whole], one_low])[order]
        self.several = np.concatenate([high[whole], one_high])[order] > self.least
        self.first = np.concatenate([[0], np.cumsum(self.strings)])
        place = np.empty(len(order), np.int64)
        place[order] = self.first[:-1]
        # Places of a distinct segment's strings: a run in its unit, or one unit a string.
        spots = np.empty(int(size.sum()), np.int64)
        base = np.cumsum(size) - size
        spots[_runs(base[whole], size[whole])] = _runs(place[: len(whole)], size[whole])
        spots[_runs(base[apart], size[apart])] = place[len(whole) :][unit_of]
        self.spot = spots[_runs(base[which], strings)]
        self.use = np.repeat(np.arange(len(which)), strings)
        self.at_use = _runs(self.start, strings)

    def content(self, body: bytes, lo: int, hi: int) -> bytes:
        return b"".join([body[a : a + n + LEAST - 1] for a, n in zip(self.at[lo:hi].tolist(), self.strings[lo:hi].tolist(), strict=True)])


def _send_units(chunk_rows: DataFrame, key_buckets: int, buckets: int, plan: Plan) -> DataFrame:
    """chunk_rows: with answers. The bits of all units' strings, for their smallest document in the chunk and for its others: chunk, bucket, bits."""

    def run(batches):
        for row in rows_of(batches):
            ids, sizes, body = open_chunk(row["ids"], row["sizes"], row["body"])
            u = Units(ids, body, Segments(ids, sizes, body), row["answers"], key_buckets)
            edges = bucket_edges(u.keys, buckets)
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo < hi:
                    cols = [pack_sorted(u.keys[lo:hi]), squeeze(u.least[lo:hi].tobytes()), squeeze(np.packbits(u.several[lo:hi]).tobytes()), squeeze(u.strings[lo:hi].astype(np.uint8).tobytes()), squeeze(u.content(body, lo, hi))]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(arrow_bytes([x]) for x in cols)], names=["key", "chunk", "keys", "least", "several", "strings", "body"])

    sent = chunk_rows.mapInArrow(run, "key int, chunk long, keys binary, least binary, several binary, strings binary, body binary")

    def answer(batches):
        for t in by_key(batches):
            read = lambda name, kind: [np.frombuffer(unsqueeze(x.as_py()), kind) for x in t.column(name)]  # noqa: B023, E731
            keys = [unpack_sorted(x.as_py()) for x in t.column("keys")]
            count = [len(x) for x in keys]
            least = np.concatenate(read("least", np.int64))
            several = np.concatenate([np.unpackbits(x, count=n).astype(bool) for x, n in zip(read("several", np.uint8), count, strict=True)])
            strings = np.concatenate(read("strings", np.uint8)).astype(np.int64)
            body = b"".join(unsqueeze(x.as_py()) for x in t.column("body"))
            g = Groups(np.concatenate(keys), least, several, strings, body, plan.array)
            # of each unit of each chunk: the bits for its smallest document there, and for its other documents
            own, other = g.bits(g.which, least == g.least[g.which]), g.bits(g.which, np.zeros(len(least), bool))
            ends = np.cumsum(strings)[np.cumsum(count) - 1].tolist()
            bits = [squeeze(np.packbits(np.concatenate([own[a:b], other[a:b]])).tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), pa.array([t.column("key")[0].as_py()] * len(bits), pa.int32()), arrow_bytes(bits)], names=["chunk", "bucket", "bits"])

    return dealt(sent, buckets).mapInArrow(answer, "chunk long, bucket int, bits binary")


class Groups:
    """Which strings of a bucket's contents go, from the maximal repeat groups of each key's contents.

    A distinct content stands in the suffix array once for its smallest document and, if another document has it, once more for the
    others: so equal contents are a repeat like any other, and any number of copies takes the room of two.
    """

    def __init__(self, keys: np.ndarray, least: np.ndarray, several: np.ndarray, strings: np.ndarray, body: bytes, array: int):
        size = strings + (LEAST - 1)
        start = np.cumsum(size) - size
        one, self.which, _ = _distinct(body, start, size)
        self.least, most = np.full(len(one), 1 << 62, np.int64), np.full(len(one), -(1 << 62), np.int64)
        np.minimum.at(self.least, self.which, least)
        np.maximum.at(most, self.which, least + several)
        self.strings = strings[one]
        twice = most > self.least
        # texts: the contents, and once more those that another document has
        again = np.flatnonzero(twice)
        content = np.concatenate([np.arange(len(one)), again])
        doc = np.concatenate([self.least, most[again]])
        self.again = np.full(len(one), -1, np.int64)
        self.again[again] = len(one) + np.arange(len(again))
        text_strings = self.strings[content]
        self.first = np.cumsum(text_strings) - text_strings
        self.on = np.zeros(int(text_strings.sum()), bool)
        key = keys[one][content]
        order = np.argsort(key, kind="stable")
        k = key[order]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        held: list[np.ndarray] = []
        room = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:  # a key with one text has nothing to be compared with
                held.append(order[a:b])
                room += int(text_strings[order[a:b]].sum()) + LEAST * (b - a)
            if held and (room >= array or b == len(k)):
                self._mark(np.concatenate(held), start[one], content, doc, body)
                held, room = [], 0
        if held:
            self._mark(np.concatenate(held), start[one], content, doc, body)

    def bits(self, which: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        """Bits of the strings of each content, for its smallest document or the others."""
        text = np.where(smallest | (self.again[which] < 0), which, self.again[which])
        return self.on[_runs(self.first[text], self.strings[which])]

    def _mark(self, texts: np.ndarray, start: np.ndarray, content: np.ndarray, doc: np.ndarray, body: bytes) -> None:
        own = content[texts]
        strings = self.strings[own]
        symbols, starts = joined([body[a : a + n + LEAST - 1] for a, n in zip(start[own].tolist(), strings.tolist(), strict=True)])
        sa, levels = esa.build(symbols)
        lcp = esa.lcp_array(sa, levels, LEAST)
        del levels
        lo, hi, length, parent, deepest = esa.intervals(lcp, LEAST)
        if not len(lo):
            return
        by_place = np.repeat(doc[texts], strings + LEAST)[sa]
        smallest = _range_min(by_place, lo, hi)
        diverse = esa.left_diverse(symbols, sa, lo, hi)
        place = np.flatnonzero(deepest >= 0)
        group = deepest[place]
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        while len(place):
            # up to the longest maximal repeat here that a document with a smaller id has, too
            up = ~diverse[group] | (smallest[group] >= by_place[place])
            spans.append((sa[place[~up]], length[group[~up]] - LEAST + 1))
            place, group = place[up], parent[group[up]]
            rest = group >= 0
            place, group = place[rest], group[rest]
        on = esa.covered(np.concatenate([x for x, _ in spans]), np.concatenate([x for _, x in spans]), len(symbols))
        self.on[_runs(self.first[texts], strings)] = on[_runs(starts, strings)]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each with an end of its own, and each text's start."""
    sizes = np.array([len(c) for c in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + len(texts), np.int64)
    ends = starts + sizes
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
    symbols[ends] = 256 + np.arange(len(texts))
    return symbols, starts


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of x[lo .. hi], by a table of powers of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, k = x, 0
    while len(lo) and k <= level.max():
        m = level == k
        out[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
        k += 1
    return out


def _removed(row: dict, key_buckets: int, buckets: int) -> tuple[list, np.ndarray, bytes, np.ndarray]:
    """A chunk's ids, sizes, body, and the mask of its removed bytes."""
    ids, sizes, body = open_chunk(row["ids"], row["sizes"], row["body"])
    u = Units(ids, body, Segments(ids, sizes, body), row["answers"], key_buckets)
    on = np.zeros((2, int(u.first[-1])), bool)
    edges = bucket_edges(u.keys, buckets)
    for x in row["bits"] or []:
        a, b = u.first[edges[x["bucket"]]], u.first[edges[x["bucket"] + 1]]
        on[:, a:b] = np.unpackbits(np.frombuffer(unsqueeze(x["bits"]), np.uint8), count=2 * int(b - a)).astype(bool).reshape(2, -1)
    least = np.repeat(u.least, u.strings)[u.spot]
    gone = np.where(u.doc_id[u.use] == least, on[0][u.spot], on[1][u.spot])
    starts = u.at_use[gone]
    return ids, sizes, body, esa.covered(starts, np.full(len(starts), LEAST, np.int64), len(body))


def _judged(docs: DataFrame, plan: Plan, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """Chunks with all answers. The chunks are bucketed by their key, so that only answers are shuffled to them."""
    ready(docs.sparkSession)
    packed = chunks(docs, plan.chunk, keep)
    raw = packed.agg(F.sum("raw")).first()[0] or 0
    key_buckets, buckets = max(1, -(-raw // plan.key_bucket)), max(1, -(-raw // plan.content_bucket))
    shared = stage(collected(_send_keys(packed, key_buckets, plan), "answers"), "shared")
    marked = packed.join(shared, "chunk", "left")
    bits = stage(collected(_send_units(marked, key_buckets, buckets, plan), "bits"), "bits")
    return marked.join(bits, "chunk", "left"), key_buckets, buckets


def removals(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    rows, key_buckets, buckets = _judged(docs, plan)

    def run(batches):
        for row in rows_of(batches):
            ids, sizes, body, gone = _removed(row, key_buckets, buckets)
            raw, out, a = np.frombuffer(body, np.uint8), [], 0
            for s in sizes.tolist():
                m = gone[a : a + s]
                n = int(m.sum())
                spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if n else 0
                out.append((s, n, spans, hashlib.sha256(raw[a : a + s][~m].tobytes() if n else body[a : a + s]).hexdigest()))
                a += s
            n, removed, spans, digest = map(list, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, keep: tuple[str, ...] = (), plan: Plan = Plan()) -> DataFrame:
    """doc_id, kept_text (what is left of the text; null if that was null), n_removed, and rest, a struct of the columns in `keep`: one row a document.

    A cut inside a character drops what is left of that character. The other columns travel with the texts, so no join follows.
    """
    own = docs.select("doc_id", "text", F.col("text").isNull().alias("empty"), F.struct(*keep).alias("rest") if keep else F.struct(F.lit(0).alias("none")).alias("rest"))
    rows, key_buckets, buckets = _judged(own, plan, ("empty", "rest"))
    schema = f"doc_id long, kept_text string, n_removed long, rest {own.schema['rest'].dataType.simpleString()}"

    def run(batches):
        for row in rows_of(batches):
            ids, sizes, body, gone = _removed(row, key_buckets, buckets)
            other = open_rest(row["rest"])
            raw, texts, n, a = np.frombuffer(body, np.uint8), [], [], 0
            for s, empty in zip(sizes.tolist(), other.column("empty").to_pylist(), strict=True):
                m = gone[a : a + s]
                texts.append(None if empty else raw[a : a + s][~m].tobytes().decode("utf-8", "ignore"))
                n.append(int(m.sum()))
                a += s
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(n, pa.int64()), other.column("rest").combine_chunks()], names=["doc_id", "kept_text", "n_removed", "rest"])

    return rows.mapInArrow(run, schema)


def repeat_groups(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeats of a few texts: length and all occurrences (text, place), longest first. For a bounded set of texts."""
    symbols, starts = joined(texts)
    sa, levels = esa.build(symbols)
    lo, hi, length = esa.maximal_repeats(symbols, sa, esa.lcp_array(sa, levels), least)
    out = []
    for a, b, n in zip(lo.tolist(), hi.tolist(), length.tolist(), strict=True):
        at = np.sort(sa[a : b + 1])
        text = np.searchsorted(starts, at, side="right") - 1
        out.append((n, list(zip(text.tolist(), (at - starts[text]).tolist(), strict=True))))
    return sorted(out, key=lambda x: (-x[0], x[1]))
