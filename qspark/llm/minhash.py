"""MinHash near-duplicates: many universal hash minima in bands, links verified on full shingle sets, connected components.

1. Each text gets its distinct shingles, a 128-bit hash of that set, BANDS x ROWS universal-hash minima, and a band key of each
   ROWS of them. Its signature keeps eight bits of each minimum. Texts of one set form a
   class; its smallest doc_id stands for it from here on, so copies cost nothing.
2. Classes that share a band key are candidates. A bucket links each member to its smallest one (never all pairs); the components
   of these links are clusters, and every candidate pair lies within one cluster.
3. Sets of clustered classes are built once more from the texts and dealt by cluster. A task holds a cluster, or a block of one
   whose sets are too large together, with the cluster's most linked classes (pivots) in each block. It verifies candidate
   pairs of different components by how many shingles they can share at most and by their signatures, and confirms those that
   pass on the full sets, until no pair is left.
4. For a cluster of several blocks, classes that are not in its largest component are a query set: in blocks, they are confirmed
   against all blocks of the cluster. So no candidate pair of different components stays untested.

Two texts at the threshold share no band with a probability of (1 - 0.8**ROWS)**BANDS, under 1e-7. Of their 128 minima 102 are equal
on average; a pair with under LEAST_EQUAL of the expected share fails verification, which one at the threshold does with a
probability under 1e-12.

Defined cases: a null text, and one without words, has an empty set and is linked with nothing; with fewer words than a shingle
has, the whole sequence is the one shingle. A null doc_id stands alone, is kept and has a null component_id. Repeated rows are
copies. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, pack_sorted, ready, shingle_hashes, stage, steps, unpack_sorted, word_codes, word_windows
from .components import components
from .exchange import by_key

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 4
#: Shingles that one task holds, about; a larger cluster is cut into blocks of as many.
BLOCK_SHINGLES = 2_000_000
PIVOTS = 8
SEED = 20240501
#: A pair passes verification with this share of the minima equal that the threshold lets expect.
LEAST_EQUAL = 0.62
#: A shingle is rare in a cluster if no more than this share of its sets have it, or no more than LEAST_RARE of them.
RARE, LEAST_RARE = 1 / 32, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, all in a row, and where each set starts."""
    lists = [t.translate(_LOWER).split() for t in texts]
    h, at = word_windows(lists, n)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    short = [k for k, x in enumerate(lists) if 0 < len(x) < n]
    if short:
        whole = [shingle_hashes(word_codes(lists[k]), len(lists[k]))[0] ^ np.uint64(len(lists[k])) for k in short]
        h, doc = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([doc, np.array(short)])
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def band_keys(h: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set that isn't empty, a key for each band, and the signature: a byte of each minimum."""
    full = np.flatnonzero(np.diff(at))
    out, signature = np.zeros((len(full), bands), np.uint64), np.zeros((len(full), bands * rows), np.uint8)
    a, b = _permutations(bands * rows)
    cut = 1 << 14  # sets are taken in runs that stay in the processor's cache
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(at[full + 1], at[full[lo]] + cut, side="right")))
        own, starts = h[at[full[lo]] : at[full[hi - 1] + 1]], at[full[lo:hi]] - at[full[lo]]
        for j in range(bands):
            key = np.full(hi - lo, j + 1, np.uint64)
            for k in range(j * rows, (j + 1) * rows):
                x = own * a[k]
                x += b[k]
                least = np.minimum.reduceat(x, starts)
                signature[lo:hi, k] = mixed(least)
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[lo:hi, j] = key
        lo = hi
    return out, signature


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (two longs; null for an empty set), bands and signature."""

    def run(batches):
        for batch, texts in steps(batches):
            h, at = shingle_sets(texts, n)
            sizes = np.diff(at)
            full = sizes > 0
            keys, minima = band_keys(h, at, bands, rows)
            own = iter(minima)
            digest = [np.frombuffer(xxhash.xxh3_128_digest(h[at[k] : at[k + 1]].tobytes()), np.int64) if full[k] else (0, 0) for k in range(len(texts))]
            offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([int(x[0]) for x in digest], pa.int64(), mask=~full), pa.array([int(x[1]) for x in digest], pa.int64(), mask=~full), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel())), pa.array([next(own).tobytes() if x else None for x in full], pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "bands", "signature"])

    return _own(docs).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, bands array<long>, signature binary")


class _Roots:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Shared:
    """How many shingles a set shares with others: exactly, or at most.

    A shingle in more than RARE of all sets, and more than LEAST_RARE, is common. Two sets share no more than the smaller of their
    counts of common ones, and of the others just those whose short lists of holders have both.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        held = np.bincount(self.code)
        self.starts = np.concatenate([[0], np.cumsum(held)])
        self.holders = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(self.code, kind="stable")]
        common = held > max(LEAST_RARE, int(RARE * len(sets)))
        self.common = np.add.reduceat(common[self.code], self.at[:-1], dtype=np.int64)
        self.listed = (held > 1) & ~common
        self.mark = np.zeros(len(held), bool)

    def own(self, x: int) -> np.ndarray:
        return self.code[self.at[x] : self.at[x + 1]]

    def most(self, x: int) -> np.ndarray:
        """No set shares more with x than this."""
        c = self.own(x)
        c = c[self.listed[c]]
        listed = np.bincount(self.holders[_ranges(self.starts[c], self.starts[c + 1])], minlength=len(self.sizes))
        return np.minimum(self.common, self.common[x]) + listed

    def count(self, x: int, others: np.ndarray) -> np.ndarray:
        self.mark[self.own(x)] = True
        n = self.sizes[others]
        out = np.add.reduceat(self.mark[self.code[_ranges(self.at[others], self.at[others + 1])]], np.cumsum(n) - n, dtype=np.int64)
        self.mark[self.own(x)] = False
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def _confirm(doc: list, sets: list[np.ndarray], bands: np.ndarray, signature: np.ndarray, label: list, query: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that were confirmed between nodes of different components; label joins nodes known to belong together.

    A bucket first tries its first member with each other. Then each node outside the largest component is held against all that
    share a bucket with it and are still apart, in one go: by how many shingles they can share, by signatures, on full sets. With
    query, only pairs with such a node count.
    """
    roots, first = _Roots(len(doc)), {}
    for k, x in enumerate(label):
        if x is not None:
            roots.join(first.setdefault(x, k), k)
    tried: set[tuple[int, int]] = set()
    out = []
    least = int(LEAST_EQUAL * percent / 100 * signature.shape[1])

    def attempt(a: int, b: int) -> None:
        if query is not None and not (query[a] or query[b]):
            return
        if roots.find(a) == roots.find(b):
            return
        pair = (a, b) if a < b else (b, a)
        if pair in tried:
            return
        if np.count_nonzero(signature[a] == signature[b]) >= least and _alike(sets[a], sets[b], percent):
            roots.join(a, b)
            out.append((doc[a], doc[b]))
        else:
            tried.add(pair)

    order = np.argsort(bands, axis=0, kind="stable").astype(np.int32)
    lo, hi = np.zeros(bands.shape, np.int32), np.zeros(bands.shape, np.int32)
    for j in range(bands.shape[1]):
        o = order[:, j]
        k = bands[o, j]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        lo[o, j], hi[o, j] = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                head, *rest = o[a:b].tolist()
                for x in rest:
                    attempt(head, x)
    component = np.array([roots.find(x) for x in range(len(doc))])
    largest = np.bincount(component).argmax()
    apart = np.flatnonzero(component != largest)
    if not len(apart):
        return out
    shared, done = _Shared(sets), np.zeros(len(doc), bool)
    if query is not None:
        apart = apart[np.argsort(~query[apart], kind="stable")]
    for x in apart.tolist():
        if component[x] == component[largest]:  # joined meanwhile; who is still apart is held against x
            continue
        done[x] = True
        if (hi[x] - lo[x]).sum() < len(doc):
            near = np.unique(np.concatenate([order[a:b, j] for j, (a, b) in enumerate(zip(lo[x].tolist(), hi[x].tolist(), strict=True))]))
        else:
            near = np.arange(len(doc))
        near = near[(component[near] != component[x]) & ~done[near]]
        if query is not None and not query[x]:
            near = near[query[near]]
        if not len(near):
            continue
        enough = lambda n, y: 100 * n >= percent * (shared.sizes[x] + shared.sizes[y] - n)
        near = near[enough(shared.most(x)[near], near)]
        equal = np.count_nonzero(signature[near] == signature[x], axis=1)
        near = near[np.argsort(-equal, kind="stable")[: np.count_nonzero(equal >= least)]]
        some = 4  # the likeliest first: a link often spares the others
        while len(near):
            now, near = near[:some], near[some:]
            for y in now[enough(shared.count(x, now), now)].tolist():
                if component[x] != component[y]:
                    out.append((doc[x], doc[y]))
                    component[component == component[y]] = component[x]
            near = near[component[near] != component[x]]
            some = min(4 * some, 1024)
    return out


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """rows: key, doc, label, query, bands, signature, shingles; the confirmed links of each key's rows."""

    def run(batches):
        for t in by_key(batches):
            doc = t.column("doc").to_pylist()
            bands = np.stack([np.asarray(x, np.int64) for x in t.column("bands").to_pylist()])
            sets = [unpack_sorted(x) for x in t.column("shingles").to_pylist()]
            query = np.asarray(t.column("query"))
            signature = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(doc), -1)
            links = _confirm(doc, sets, bands, signature, t.column("label").to_pylist(), None if query.all() else query, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])

    own = rows.select("key", "doc", F.col("label").cast("long").alias("label"), "query", "bands", "signature", "shingles")
    return own.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    ready(docs.sparkSession)
    sigs = stage(signatures(docs, n, bands, rows), "signatures")
    named = sigs.where("n_shingles > 0 and doc_id is not null")
    least = stage(named.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "signature"), "doc_id").alias("x"), F.max("n_shingles").alias("size")).select("hi", "lo", "rep", "x.bands", "x.signature", "size"), "classes")
    buckets = least.select("rep", F.posexplode("bands").alias("band", "code"))
    heads = buckets.groupBy("band", "code").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = buckets.join(heads, ["band", "code"]).where("rep <> head").groupBy(F.col("rep").alias("u"), F.col("head").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    stars = stage(stars, "stars")
    cluster = stage(components(stars.select("u", "v")).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "clusters")
    links = _links_of(docs, least, stars, cluster, n, percent)
    linked = components(links)
    classes = least.join(linked, least.rep == linked.node, "left").select("hi", "lo", F.coalesce("component", "rep").alias("found"))
    full = sigs.where("n_shingles > 0").join(classes, ["hi", "lo"], "left").select("doc_id", "n_shingles", "found")
    out = full.unionByName(sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("found")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links_of(docs: DataFrame, least: DataFrame, stars: DataFrame, cluster: DataFrame, n: int, percent: int) -> DataFrame:
    known = least.select("rep", "bands", "signature", "size").join(cluster, "rep")
    sizes = cluster.join(least.select("rep", "size"), "rep").groupBy("cluster").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))

    def build(batches):
        for batch, texts in steps(batches, text="text"):
            h, at = shingle_sets(texts, n)
            cols = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([pack_sorted(h[at[k] : at[k + 1]]) for k in range(len(texts))], pa.binary())], names=[*(x for x in batch.schema.names if x != "text"), "shingles"])

    texts = _own(docs).where("doc_id is not null").join(known.join(sizes, "cluster").withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "bands", "signature", "cluster", "blocks")
    sets = stage(texts.mapInArrow(build, "doc_id long, bands array<long>, signature binary, cluster long, blocks int, shingles binary"), "sets").withColumnRenamed("doc_id", "doc")
    big = sets.where("blocks > 1")
    degree = stars.groupBy(F.col("v").alias("doc")).agg(F.sum("n").alias("degree"))
    pivots = big.select("doc", "cluster").join(degree, "doc").withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "doc"))).where(F.col("k") <= PIVOTS).select("doc")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    spread = big.join(pivots.withColumn("pivot", F.lit(True)), "doc", "left")
    spread = spread.withColumn("block", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    first = sets.where("blocks = 1").withColumn("block", F.lit(0)).unionByName(spread.drop("pivot"))
    first = first.withColumn("key", F.xxhash64("cluster", "block")).withColumn("label", F.lit(None).cast("long")).withColumn("query", F.lit(True))
    links = stage(_verify(first, percent), "links")
    if not (parts := big.agg(F.max("blocks")).first()[0]):
        return links
    # The rest of clusters in several blocks: what isn't in the largest component, against all blocks.
    linked = stage(components(links.join(big.select(F.col("doc").alias("u")), "u", "left_semi")), "parts")
    state = stage(big.join(linked.withColumnRenamed("node", "doc").withColumnRenamed("component", "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc")).select("doc", "cluster", "blocks", "label", F.length("shingles").alias("bytes")), "state")
    count = state.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("cluster").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
    rest = state.join(main, "cluster").where("label <> main")
    wanted = rest.groupBy("cluster").agg(F.ceil(F.sum("bytes") / (8 * BLOCK_SHINGLES)).cast("int").alias("asks"))
    if rest.isEmpty():
        return links
    held = sets.where("blocks > 1").join(state.select("doc", "label"), "doc").join(wanted, "cluster")
    members = held.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).withColumn("block", block).withColumn("query", F.lit(False))
    asked = held.join(rest.select("doc"), "doc", "left_semi").withColumn("ask", F.pmod(F.xxhash64("doc"), F.col("asks")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    # a query row stands in for the same document among the members
    second = members.unionByName(asked).withColumn("key", F.xxhash64("cluster", "ask", "block"))
    more = stage(_verify(second, percent), "links")
    return links.unionByName(more)
