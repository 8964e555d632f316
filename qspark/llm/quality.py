"""Quality rules with suffix-array repetition.

A text's words are numbered within the text, a suffix array over them is built by prefix doubling, and its common-prefix
intervals give the maximal repeated word sequences. Their spans are united; the verdict limits the covered fraction and the
longest repeat.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. Repeated rows are judged each by itself.
Only doc_id and text are read, so other columns, whatever their names, do not matter. An empty table gives no rows. A very long text is
a step of its own: the suffix array takes up to some 150 bytes of memory a word of it, more with longer repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import esa
from .common import ready, steps

#: A repeat counts from this many words.
LEAST_WORDS = 8
#: The most that repeats may cover of a text's words, and the longest that one repeat may be: of its words, and outright.
MOST_COVERED, LONGEST_SHARE, LONGEST_WORDS = 0.3, 0.2, 200
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"
_BLANKS = b" \t\n\x0b\x0c\r"
_is_blank, _is_symbol = (np.isin(np.arange(256), list(x)) for x in (_BLANKS, SYMBOLS))


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for x in lines:
        if x in seen:
            n += bool(x.strip(_BLANKS))
        else:
            seen.add(x)
    return n


def analyse(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text, all texts in one suffix array: words are numbered apart, so no match crosses texts."""
    ids: list[int] = []
    counts, base = [], 0
    for t in texts:
        known: dict[bytes, int] = {}
        words = t.split()
        number = known.setdefault
        ids += [number(w, base + len(known)) for w in words]
        counts.append(len(words))
        base += len(known)
    counts = np.array(counts, np.int64)
    symbols = np.array(ids, np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    doc = np.repeat(np.arange(len(texts)), counts)
    sa, levels = esa.build(symbols)
    lcp = esa.lcp_array(sa, levels)
    # words in 3-word windows found twice or more
    repeat3 = np.zeros(len(symbols), bool)
    long3 = esa.longest_by_position(sa, lcp)
    at = np.flatnonzero(long3 >= 3)
    for k in range(3):
        repeat3[at + k] = True
    n = len(symbols)
    lo, hi, length = esa.maximal_repeats(symbols, sa, lcp, LEAST_WORDS)
    deepest = np.where(long3 >= LEAST_WORDS, long3, 0)
    spans = np.flatnonzero(deepest)
    mask = esa.covered(spans, deepest[spans], n)
    longest = np.zeros(len(texts), np.int64)
    if len(lo):
        np.maximum.at(longest, doc[sa[lo]], length)
    per = lambda m: np.bincount(doc[m], minlength=len(texts)).astype(np.int64)
    body = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[edges])
    out = {
        "n_words": counts,
        "word_chars": total(((body & 0xC0) != 0x80) & ~_is_blank[body]),
        "n_symbols": total(_is_symbol[body]),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": per(repeat3),
        "n_covered": per(mask),
        "longest_repeat": longest,
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    fine = (out["n_covered"] <= MOST_COVERED * counts) & (longest <= np.maximum(LEAST_WORDS, LONGEST_SHARE * counts)) & (longest <= LONGEST_WORDS)
    out["kept"] = ~out["base_failed"] & fine
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: the base counts, base_failed, and kept by the repetition rule. No shuffle; a task holds a step of texts, or one longer text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch, texts in steps(batches, most=1 << 20):
            x = analyse(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
