"""Benchmark decontamination: containment search for short items inside long documents.

Items are partitioned by the size of their shingle set (powers of two). MinHash of whole documents would miss short items in long
ones, so each partition has its own sketch size: an item's sketch is its bottom minima under one hash, EXTRA more than the shingles
that a document at the threshold may lack in this partition. The minima that a document has estimate the containment: an item is a
candidate if at least EXTRA + 1 of them, or as many as the threshold asks of its own size, are there. So nothing at the threshold
is missed, and few others are left for the exact containment of the shingle set, which decides. Items go in blocks of a bounded
number of shingles, each block against all documents.

Words: A-Z in lower case, split at ASCII white space and punctuation; shingles of WORDS words.

Defined cases: null or empty texts, and texts of fewer than WORDS words, have no shingle: such an item is found nowhere, such a
document has nothing in it. A repeated item (equal item_id and set) counts once, a repeated document row gives its rows again.
Empty tables give no rows. Other columns are never read, so clashing names don't matter; a very long text is a step of its own, and
takes some 30 bytes of memory a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, ready, stage, steps, word_windows

WORDS, THRESHOLD = 5, 0.8
#: Most shingles of items in a block, about: what one pass sends to all executors.
BLOCK_SHINGLES = 2_000_000
#: Minima of an item beyond those that a document at the threshold may lack.
EXTRA = 2
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() and not (c < 32 or c == 127) else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def item_sets(items: DataFrame, n: int = WORDS) -> DataFrame:
    """item_id and its sorted distinct shingles (packed), of items that have any."""

    def run(batches):
        for batch, texts in steps(batches):
            h, at = word_windows([words(t) for t in texts], n)
            sets = [np.unique(h[at[k] : at[k + 1]]) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["item_id", "n_item", "shingles"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "item_id long, n_item long, shingles binary").where("n_item > 0").distinct()


class Partition:
    """Sketches of the items of one size class."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        upper = 1 << (max(len(s) for _, s in items) - 1).bit_length()
        most = int(np.floor((1 - threshold) * upper + 1e-9)) + 1 + EXTRA
        self.item = np.array([k for k, _ in items], np.int64)
        sketches = [s[np.argsort(mixed(s), kind="stable")[:most]] for _, s in items]
        lacking = np.array([len(s) - int(np.ceil(threshold * len(s) - 1e-9)) for _, s in items])
        #: Minima that a document at the threshold has for sure.
        self.least = np.maximum(1, np.array([len(x) for x in sketches]) - lacking)
        values, owner = np.concatenate(sketches), np.repeat(np.arange(len(items)), [len(x) for x in sketches])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Pairs of a document and an item whose sketch it has to the bound, from hashes of documents' shingles."""
        lo, hi = np.searchsorted(self.values, h, "left"), np.searchsorted(self.values, h, "right")
        n = hi - lo
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hit = np.unique(np.repeat(doc, n) * len(self.values) + entry)  # a minimum counts once a document
        pair, hits = np.unique(hit // len(self.values) * len(self.item) + self.owner[hit % len(self.values)], return_counts=True)
        pair = pair[hits >= self.least[pair % len(self.item)]]
        return np.stack([pair // len(self.item), self.item[pair % len(self.item)]], axis=1)


class Index:
    """A block of items: partitions by size, and a filter of all their minima."""

    def __init__(self, sets: list[np.ndarray], n: int, threshold: float):
        self.sets, self.n = sets, n
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for s in sets]
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, s in enumerate(sets):
            classes.setdefault((len(s) - 1).bit_length(), []).append((k, s))
        self.partitions = [Partition(classes[c], threshold) for c in sorted(classes)]
        minima = np.concatenate([p.values for p in self.partitions])
        self.mask = np.uint64((1 << max(16, len(minima).bit_length() + 5)) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(minima & self.mask).astype(np.int64)] = True

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) of the texts that contain an item."""
        h, at = word_windows([words(t) for t in texts], self.n)
        near = np.flatnonzero(self.maybe[(h & self.mask).astype(np.int64)])
        if not len(near):
            return []
        doc = np.searchsorted(at, near, "right") - 1
        pairs = np.concatenate([p.candidates(h[near], doc) for p in self.partitions])
        out, last, own = [], -1, h
        for d, k in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
            if d != last:
                last, own = d, np.unique(h[at[d] : at[d + 1]])
            s = self.sets[k]
            found = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
            if found >= self.need[k]:
                out.append((d, k, found))
        return out


def _blocks(items: DataFrame, n: int, threshold: float):
    """Blocks of items of a bounded size: their ids and index."""
    sets = stage(item_sets(items, n), "items")
    blocks = -(-(sets.agg(F.sum("n_item")).first()[0] or 0) // BLOCK_SHINGLES)
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b).collect()  # one block, bounded
        if rows:
            yield [r["item_id"] for r in rows], Index([np.frombuffer(bytes(r["shingles"]), np.uint64) for r in rows], n, threshold)


def contaminated(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment: a row for each document and item that it contains to the threshold. No shuffle of texts."""
    spark = ready(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_found long"
    out = spark.createDataFrame([], schema)
    for ids, index in _blocks(items, n, threshold):

        def run(batches, ids=ids, index=index):
            for batch, texts in steps(batches):
                if found := index.matches(texts):
                    d, k, hits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([ids[i] for i in k], pa.int64()), pa.array([len(index.sets[i]) for i in k], pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id", "n_item", "n_found"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def uncontaminated(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that contain no item to the threshold. Each row is judged by itself; no shuffle, no join."""
    ready(docs.sparkSession)
    for _, index in _blocks(items, n, threshold):

        def run(batches, index=index):
            for batch, texts in steps(batches):
                keep = np.ones(len(texts), bool)
                keep[[d for d, _, _ in index.matches(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""
WITH w AS (SELECT 'd' AS t, doc_id AS id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+'), lambda x: x <> '') AS l FROM documents
    UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT t, id, array_to_string(l[k : k + 4], ' ') AS g FROM (SELECT t, id, l, unnest(generate_series(1, len(l) - 4)) AS k FROM w WHERE len(l) >= 5)),
n AS (SELECT id, count(*) AS n FROM s WHERE t = 'i' GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n.n) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_found, count(*) / any_value(n.n) AS containment
FROM s i JOIN s d ON i.g = d.g AND i.t = 'i' AND d.t = 'd' JOIN n ON n.id = i.id
GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n.n)
"""
