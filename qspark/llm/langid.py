"""Language identification by rank-order n-gram profiles and out-of-place distance.

Training counts all 1- to 3-grams of letters (words padded by a gap) per language, over every training row, adds them up by a
partial aggregation, and keeps each language's TOP most frequent in order. A document's own TOP n-grams are ranked likewise; the
distance to a language sums how far each n-gram stands from its place in the profile (TOP if it isn't there).

Defined cases: null text, empty text or text without a letter gives `und` with score 0. A null lang is no training row. Equal
counts rank by code points, equal distances go to the language first in the alphabet. Repeated rows are predicted each by
itself, and count each in training. With no training rows all texts are `und`. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranking
from .common import ready, stage, steps

#: Length of a profile and of a document's ranking.
TOP = 400
#: Most languages whose profiles (TOP n-grams each) are sent to the executors at once; more are compared block by block.
BLOCK_LANGS = 1000

#: Raw text of one vectorised step: its n-grams take some 150 times as much.
STEP = 1 << 19
#: n-grams that a task counts before it hands them on.
HELD = 300_000

#: No code point: stands in the middle of a 2-gram and before a 1-gram, so that lengths are told apart.
FILLER = 0x1FFFFF

_TEXT, _BEST = "text to identify", "best language so far"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def gram_counts(texts: list[bytes], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of the letter n-grams of the texts; an n-gram is its code points, 21 bits each, 0 for a gap (shorter ones: see FILLER)."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    cp = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[cp], cp, 0)
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    who = np.repeat(owner, sizes)[keep]
    c = c[keep]
    if not len(c):
        return (np.zeros(0, np.int64),) * 3
    used = np.flatnonzero(np.bincount(c, minlength=1))
    used = np.concatenate([used if used[0] == 0 else np.concatenate([[0], used]), [FILLER]])
    bits = max(1, int(len(used) - 1).bit_length())
    if int(who.max()).bit_length() + 3 * bits > 63:
        half = len(texts) // 2
        if half:
            return tuple(np.concatenate(x) for x in zip(gram_counts(texts[:half], owner[:half]), gram_counts(texts[half:], owner[half:]), strict=True))
    dense = np.zeros(int(used[-2]) + 1, np.int64)
    dense[used[:-1]] = np.arange(len(used) - 1)
    fill = len(used) - 1
    d = dense[c]
    prev = np.concatenate([[0], d[:-1]])
    prev2 = np.concatenate([[0, 0], d[:-2]])[: len(d)]
    base = who.astype(np.int64) << (3 * bits)
    one = d > 0
    two = one | (prev > 0)
    three = two & (prev > 0)
    keys = np.concatenate([(base | fill << (2 * bits) | fill << bits | d)[one], (base | prev << (2 * bits) | fill << bits | d)[two], (base | prev2 << (2 * bits) | prev << bits | d)[three]]).astype(np.uint64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    u = keys[first].astype(np.int64)
    n = np.diff(np.concatenate([first, [len(keys)]]))
    mask = (1 << bits) - 1
    gram = used[(u >> (2 * bits)) & mask] << 42 | used[(u >> bits) & mask] << 21 | used[u & mask]
    return u >> (3 * bits), gram, n


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of (a, b), non-negative numbers."""
    la, lb, li = (int(x).bit_length() for x in (a.max(), b.max(), len(a)))
    if la + lb + li > 64:
        return np.lexsort((b, a))
    w = (a.astype(np.uint64) << np.uint64(lb + li)) | (b.astype(np.uint64) << np.uint64(li)) | np.arange(len(a), dtype=np.uint64)
    w.sort()  # one sort of packed words beats an argsort by far
    return (w & np.uint64((1 << li) - 1)).astype(np.int64)


def ranked(who: np.ndarray, gram: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank) of each owner's `top` most frequent."""
    if not len(who):
        return who, gram, n
    _, g = np.unique(gram, return_inverse=True)
    most = int(n.max())
    at = _order(who, (most - n) * (int(g.max()) + 1) + g)
    who = who[at]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], who[1:] != who[:-1]]), np.arange(len(who)), 0))
    rank = np.arange(len(who)) - start
    keep = rank < top
    return who[keep], gram[at[keep]], rank[keep]


def train(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Profiles of all rows with text and lang: lang and its n-grams, most frequent first."""
    ready(docs.sparkSession)

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch, texts in steps(batches, most=STEP):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            who, gram, n = gram_counts(texts, np.array([number[x] for x in langs], np.int64))
            for i, name in enumerate(names):
                own = total.setdefault(name, {})
                m = who == i
                for g, k in zip(gram[m].tolist(), n[m].tolist(), strict=True):
                    own[g] = own.get(g, 0) + k
            if sum(map(len, total.values())) > HELD:
                yield from out(total)
                total = {}
        yield from out(total)

    def out(total):
        for name, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own.keys()), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    return best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))


def predict(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred, score: one row a document, no shuffle."""
    ready(docs.sparkSession)
    names = sorted(profiles)
    vocabulary = np.array(sorted({g for x in profiles.values() for g in x}), np.int64)
    places = np.full((len(vocabulary) + 1, max(1, len(names))), -1, np.int64)
    for k, name in enumerate(names):
        places[np.searchsorted(vocabulary, np.array(profiles[name], np.int64)), k] = np.arange(len(profiles[name]))
    found = np.zeros(len(vocabulary) + 1, bool)
    found[: len(vocabulary)] = True
    padded = np.concatenate([vocabulary, [-1]])

    def run(batches):
        for batch, texts in steps(batches, text=_TEXT, most=STEP):
            m = len(texts)
            who, gram, rank = ranked(*gram_counts(texts, np.arange(m)), top)
            at = np.minimum(np.searchsorted(vocabulary, gram), len(vocabulary))
            hit = padded[at] == gram
            at[~hit] = len(vocabulary)
            size = np.bincount(who, minlength=m)
            dist = np.stack([np.bincount(who, np.where(places[at, k] >= 0, np.abs(rank - places[at, k]), top), minlength=m) for k in range(places.shape[1])], axis=1)
            best = dist.argmin(axis=1)
            known = (size > 0) & bool(names)
            score = np.where(known, 1 - dist[np.arange(m), best] / np.maximum(1, size * top), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([names[b] if ok else "und" for b, ok in zip(best, known, strict=True)], pa.string()), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    own = docs.select(*(F.col(k).cast("long").alias(k) if k == "doc_id" else F.col(k) for k in keep), F.col("text").cast("string").alias(_TEXT))
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string", "score double"]))


def language_id(docs: DataFrame, train_rows: Column, top: int = TOP, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK_LANGS) -> DataFrame:
    """Learn from the rows that train_rows marks, predict all. With more languages than a block has, the best of each block is carried on to the next."""
    profiles = stage(train(docs.where(train_rows), top), "profiles")
    blocks = max(1, -(-profiles.count() // block))
    if blocks > 1:
        names = ranking.rank(profiles.select("lang"), "lang")
        profiles = profiles.join(names.withColumn("block", F.floor(F.col("rank") / block)).select("lang", "block"), "lang")
        docs = docs.withColumn(_BEST, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    out = docs
    for b in range(blocks):
        rows = (profiles if blocks == 1 else profiles.where(F.col("block") == b)).collect()  # a block of profiles, bounded
        own = {r["lang"]: list(r["grams"]) for r in rows}
        if blocks == 1:
            return predict(docs, own, top, keep)
        found = predict(out, own, top, (*dict.fromkeys((*keep, "text")), _BEST))
        # of equal scores the earlier block's, which is first in the alphabet
        better = (F.col("lang_pred") != "und") & ((F.col(_BEST)["lang"] == "und") | (F.col("score") > F.col(_BEST)["score"]))
        best = F.when(better, F.struct(F.col("lang_pred").alias("lang"), "score")).otherwise(F.col(_BEST))
        out = stage(found.withColumn(_BEST, best).drop("lang_pred", "score"), "best")
    return out.select(*keep, F.col(_BEST)["lang"].alias("lang_pred"), F.col(_BEST)["score"].alias("score"))
