"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding, normalised by length, with exception phrases.

The lexicon is learned: log-odds of a folded word's document frequency in labelled toxic against other documents, where copies
(the same SKETCH smallest word hashes) count once. Exceptions are learned, too: pairs of words with a lexicon word that only
documents without label 1 have, LEAST_DOCS of them or more; phrases may be given besides. Folding lowers case and undoes homoglyphs and digit substitutions. A match needs
word boundaries, and does not count inside an exception phrase. A document's weight sum is divided by the square root of its
number of words; a logistic curve, fitted on the same rows, turns it into a score.

Training reads at most TRAIN_ROWS labelled documents (those of the smallest hash of doc_id): the documented bound of the sample.

Defined cases: null and empty texts have no match and get the score of a text without match. A null label is no training row,
repeated labels of a document count as the highest. Without any toxic training row the lexicon is empty and every score 0. An
empty table gives no rows. Columns other than doc_id, text and toxic are never read, so clashing names don't matter. A very long
text is a step of its own; it takes memory for itself, its folded form and its matches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stage, steps

TRAIN_ROWS = 10_000
#: A lexicon word is in this share of toxic training documents at least (and in LEAST_DOCS), with these log-odds at least.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, MOST_WORDS = 0.01, 3, 2.5, 2000
#: Word hashes that tell copies from other texts: unrelated texts hardly share all.
SKETCH = 4
#: Phrases in which a lexicon word is harmless (folded form), besides the learned ones.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "scum layer", "pond scum", "idiot proof")

# Look-alike letters, and digits and signs read as letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ι": "i", "ρ": "p", "υ": "u", "ν": "v", "κ": "k", "τ": "t", "ı": "i", "ɡ": "g", "ԁ": "d", "ӏ": "l", "ո": "n", "ս": "u"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
UNSEEN = "​‌‍⁠﻿­"
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {x: None for x in UNSEEN} | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_inner = re.compile(r"(?<=\w)[!|](?=\w)")
_word = re.compile(r"\w+")


def fold(text: str) -> str:
    text = text.lower()
    if "!" in text or "|" in text:
        text = _inner.sub("i", text)
    return text.translate(_FOLD)


def phrases(folded: str, lexicon) -> set[str]:
    """Pairs of words with a single space between them, one of them in the lexicon."""
    words = list(_word.finditer(folded))
    return {folded[a.start() : b.end()] for a, b in pairwise(words) if (a[0] in lexicon or b[0] in lexicon) and folded[a.end() : b.start()] == " "}


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    #: Of 1, any match, log(1 + 10 x normalised weight sum).
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(w, (len(w), x))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a


def weigh(text: bytes, automaton) -> tuple[float, int]:
    """Weight sum of the matches that count, and the number of words."""
    n = len(text.split())
    if not n or not len(automaton):
        return 0.0, n
    s = fold(text.decode("utf-8", "replace"))
    hits, safe = [], []
    for end, (size, x) in automaton.iter(s):
        at = end - size + 1
        if (at == 0 or not s[at - 1].isalnum()) and (end + 1 == len(s) or not s[end + 1].isalnum()):
            if x is None:
                safe.append((at, end))
            else:
                hits.append((at, end, x))
    safe.sort()
    starts, furthest = [p for p, _ in safe], list(accumulate((q for _, q in safe), max))
    return sum(x for a, b, x in hits if not safe or not (k := bisect_right(starts, a)) or furthest[k - 1] < b), n


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), total > 0, np.log1p(10 * total / np.sqrt(np.maximum(words, 1)))], axis=1)


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by most
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return stage(rows.select("doc_id", "text", "toxic"), "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """labels: doc_id, toxic (0 or 1) of the rows to learn from."""
    ready(docs.sparkSession)
    rows = _training(docs, labels, most)

    def counted(found):
        """Documents with each of the words or phrases that found gives for a text: toxic ones, and all."""

        def run(batches):
            for batch, texts in steps(batches):
                out: list[tuple[str, int, int]] = []
                for t, y in zip(texts, batch.column(1).to_pylist(), strict=True):
                    s = fold(t.decode("utf-8", "replace"))
                    if own := set(_word.findall(s)):
                        least = sorted(map(xxhash.xxh64_intdigest, own))[:SKETCH]
                        sketch = xxhash.xxh64_intdigest(repr(least)) >> 1
                        out += [(w, y, sketch) for w in found(s, own)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], names=["word", "toxic", "sketch"])

        pairs = rows.select("text", "toxic").mapInArrow(run, "word string, toxic int, sketch long").distinct()
        return pairs.groupBy("word").agg(F.sum("toxic").cast("long").alias("bad"), F.count(F.lit(1)).alias("all"))

    seen = counted(lambda s, own: [w for w in own if len(w) > 2] + [""])
    total = seen.where("word = ''").first()
    bad, good = (total["bad"], total["all"] - total["bad"]) if total else (0, 0)
    if not bad:
        return Model({}, exceptions)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1.0))
    chosen = seen.where((F.col("word") != "") & (F.col("bad") >= max(LEAST_DOCS, math.ceil(LEAST_SHARE * bad)))).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    weights = {r["word"]: r["odds"] for r in chosen.orderBy(F.desc("odds"), "word").limit(MOST_WORDS).collect()}
    harmless = counted(lambda s, own: phrases(s, weights) if not own.isdisjoint(weights) else ()).where((F.col("bad") == 0) & (F.col("all") >= LEAST_DOCS))
    learned = [r["word"] for r in harmless.orderBy(F.desc("all"), "word").limit(MOST_WORDS).collect()]
    model = Model(weights, tuple(dict.fromkeys((*exceptions, *learned))))
    known = _weighed(rows, model, keep=["toxic"]).select("toxic", "total", "words").toPandas()  # most rows, three numbers each
    x, y = features(known.total.to_numpy(), known.words.to_numpy()), (known.toxic.to_numpy() > 0).astype(float)
    b, ridge = np.zeros(3), np.diag([1e-3, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(b)
    return model


def _weighed(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches):
        automaton = model.automaton()
        for batch, texts in steps(batches, most=8 << 20):
            found = [weigh(t, automaton) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=[*keep, "total", "words"])

    own = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "total double", "words long"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, weight (sum of matches), n_words: one row a document, no shuffle."""
    ready(docs.sparkSession)
    a, b, c = map(float, model.curve)
    if not model.weights:
        value = F.lit(0.0)
    else:
        value = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * (F.col("total") > 0).cast("double") + F.lit(c) * F.log1p(10 * F.col("total") / F.sqrt(F.greatest(F.col("words"), F.lit(1)))))))
    return _weighed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"]).select("doc_id", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), F.col("total").alias("weight"), F.col("words").alias("n_words"))
