"""Stupid-backoff language-model scores.

Counts of all n-grams up to ORDER are taken over the whole corpus: each chunk of documents adds up its own, sends distinct n-grams
with counts to the count table, which is partitioned by ranges of the n-gram's hash, and gets the corpus counts of its own n-grams
back; the join is an n-gram's one row in its partition. A word's score is the relative frequency of the longest n-gram that ends
in it and was seen, times ALPHA for each word of context given up; a document's is the sum of logarithms over its words.

A document never supports itself: its own counts are taken off first (leave_own_out). A word not seen elsewhere counts half.

Words: A-Z in lower case, split at ASCII white space. Defined cases: null and empty texts have no word, log_score 0 and a null
mean. Repeated rows are documents of their own and support each other. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, chunks, open_chunk, pack_sorted, ready, squeeze, stage, unpack_sorted, unsqueeze, windows_of, word_codes
from .exchange import bucket_edges, by_key, collected, dealt, rows_of

ORDER, ALPHA = 2, 0.4
CHUNK, BUCKET = 8 << 20, 24 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SALT = [np.uint64(0), np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)]


class Grams:
    """The n-grams of one chunk: distinct hashes in order with their counts; with `places`, for each order n also where each document's n-grams are among them, and how often each is in its own document."""

    def __init__(self, sizes: np.ndarray, body: bytes, order: int, places: bool = False):
        ends = np.cumsum(sizes)
        lists = [body[e - s : e].translate(_LOWER).split() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.words = np.array([len(x) for x in lists], np.int64)
        codes = word_codes([w for x in lists for w in x])
        del lists
        own, self.starts = [], []
        for n in range(1, order + 1):
            h, at = windows_of(codes, self.words, n)
            own.append(h ^ _SALT[n])
            self.starts.append(at)
        every, cuts = np.concatenate(own), np.cumsum([len(h) for h in own])[:-1]
        del own
        if places:
            by = np.argsort(every, kind="stable")  # equal n-grams stay in the order of documents
            every = every[by]
        else:
            every.sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        first = np.flatnonzero(new)
        self.keys = every[first]
        self.counts = np.diff(first, append=len(every))
        if places:
            doc = np.concatenate([np.repeat(np.arange(len(sizes), dtype=np.int32), np.diff(at)) for at in self.starts])[by]
            place, often = np.empty(len(every), np.int32), np.empty(len(every), np.int32)
            place[by] = np.cumsum(new) - 1
            new[1:] |= doc[1:] != doc[:-1]
            runs = np.diff(np.flatnonzero(new), append=len(every))
            often[by] = np.repeat(runs, runs)
            self.places, self.own = np.split(place, cuts), np.split(often, cuts)


def log_scores(g: Grams, total: np.ndarray, corpus: int, order: int, alpha: float, leave_own_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log scores of each document, and how many of its words were scored by their longest n-gram."""
    docs = len(g.words)
    counts = []
    for n in range(order):
        c = total[g.places[n]]
        counts.append(c - g.own[n] if leave_own_out else c)
    doc = np.repeat(np.arange(docs), g.words)
    first = g.starts[0][:-1][doc]
    at = np.arange(len(doc)) - first  # word's place in its document
    n_all = (corpus - (g.words if leave_own_out else 0 * g.words))[doc]
    score = np.log(np.where(counts[0] > 0, counts[0], 0.5) / np.maximum(n_all, 1))
    full = np.zeros(len(doc), bool)
    used = np.where(counts[0] > 0, 1, 0)
    for n in range(2, order + 1):
        able = at >= n - 1
        w = np.flatnonzero(able)
        gram = counts[n - 1][(g.starts[n - 1][:-1][doc] + at - n + 1)[w]]
        context = counts[n - 2][(g.starts[n - 2][:-1][doc] + at - n + 1)[w]]
        seen = gram > 0
        score[w] = np.where(seen, np.log(np.maximum(gram, 1) / np.maximum(context, 1)), score[w] + np.log(alpha))
        used[w[seen]] = n
    full = used == np.minimum(at + 1, order)
    return np.bincount(doc, score, minlength=docs), np.bincount(doc[full], minlength=docs)


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_own_out: bool = True, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_full (words scored by their longest n-gram), log_score, mean_log: one row a document."""
    ready(docs.sparkSession)
    packed = chunks(docs, chunk)
    raw = packed.agg(F.sum("raw")).first()[0] or 0
    buckets = max(1, -(-raw // bucket))

    def send(batches):
        for row in rows_of(batches):
            _, sizes, body = open_chunk(row["ids"], row["sizes"], row["body"])
            g = Grams(sizes, body, order)
            counts, edges = g.counts, bucket_edges(g.keys, buckets)
            full = [b for b in range(buckets) if edges[b + 1] > edges[b]]
            cut = [slice(edges[b], edges[b + 1]) for b in full]
            words = [int(g.words.sum())] + [0] * (len(full) - 1)
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()), arrow_bytes([pack_sorted(g.keys[c]) for c in cut]), arrow_bytes([squeeze(counts[c].astype(np.uint32).tobytes()) for c in cut]), pa.array(words, pa.int64())], names=["key", "chunk", "keys", "counts", "words"])

    def table(batches):
        for t in by_key(batches):
            own = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
            every = np.concatenate(own)
            every.sort()
            u = every[np.concatenate([[True], every[1:] != every[:-1]])]
            del every
            total = np.zeros(len(u), np.int64)
            at = []
            for k, x in enumerate(t.column("counts")):
                at.append(np.searchsorted(u, own[k]).astype(np.int32))
                own[k] = None
                total[at[k]] += np.frombuffer(unsqueeze(x.as_py()), np.uint32)
            del own, u
            yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), pa.array([t.column("key")[0].as_py()] * len(at), pa.int32()), arrow_bytes([squeeze(np.ascontiguousarray(total[k].view(np.uint8).reshape(-1, 8).T).tobytes()) for k in at]), t.column("words").combine_chunks()], names=["chunk", "bucket", "bits", "words"])

    sent = packed.mapInArrow(send, "key int, chunk long, keys binary, counts binary, words long")
    answers = stage(dealt(sent, buckets).mapInArrow(table, "chunk long, bucket int, bits binary, words long"), "counts")
    corpus = answers.agg(F.sum("words")).first()[0] or 0
    rows = packed.join(collected(answers, "answers"), "chunk", "left")

    def score(batches):
        for row in rows_of(batches):
            ids, sizes, body = open_chunk(row["ids"], row["sizes"], row["body"])
            g = Grams(sizes, body, order, places=True)
            edges = bucket_edges(g.keys, buckets)
            total = np.zeros(len(g.keys), np.int64)
            for x in row["answers"] or []:
                planes = np.frombuffer(unsqueeze(x["bits"]), np.uint8).reshape(8, -1)
                total[edges[x["bucket"]] : edges[x["bucket"] + 1]] = np.ascontiguousarray(planes.T).view(np.int64).ravel()
            logs, full = log_scores(g, total, corpus, order, alpha, leave_own_out)
            mean = pa.array(logs / np.maximum(g.words, 1), mask=g.words == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(g.words), pa.array(full.astype(np.int64)), pa.array(logs), mean], names=["doc_id", "n_words", "n_full", "log_score", "mean_log"])

    return rows.mapInArrow(score, "doc_id long, n_words long, n_full long, log_score double, mean_log double")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, k, l[k] AS g, CASE WHEN k > 1 THEN l[k - 1] END AS p FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS k FROM d WHERE len(l) > 0)),
u AS (SELECT *, sum(c) OVER (PARTITION BY g) AS a FROM (SELECT doc_id, g, count(*) AS c FROM w GROUP BY 1, 2)),
b AS (SELECT *, sum(c) OVER (PARTITION BY p, g) AS a FROM (SELECT doc_id, p, g, count(*) AS c FROM w WHERE p IS NOT NULL GROUP BY 1, 2, 3)),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT w.doc_id, t.n, ug.a - ug.c AS c1, b.a - b.c AS c2, up.a - up.c AS cp, (SELECT sum(n) FROM t) - t.n AS rest, w.p
    FROM w JOIN t ON t.doc_id = w.doc_id JOIN u ug ON ug.doc_id = w.doc_id AND ug.g = w.g
    LEFT JOIN b ON b.doc_id = w.doc_id AND b.p = w.p AND b.g = w.g LEFT JOIN u up ON up.doc_id = w.doc_id AND up.g = w.p),
r AS (SELECT doc_id, sum(ln(CASE WHEN p IS NOT NULL AND c2 > 0 THEN c2 / cp ELSE (CASE WHEN p IS NULL THEN 1 ELSE 0.4 END) * (CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END) / greatest(rest, 1) END)) AS x,
    count(*) FILTER (CASE WHEN p IS NULL THEN c1 > 0 ELSE c2 > 0 END) AS f FROM s GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_full, round(x / len(l), 6) AS mean_log FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""

#: The same for order 3.
TRIGRAM_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, k, l[k] AS g, CASE WHEN k > 1 THEN l[k - 1] END AS p, CASE WHEN k > 2 THEN l[k - 2] END AS q FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS k FROM d WHERE len(l) > 0)),
u AS (SELECT *, sum(c) OVER (PARTITION BY g) AS a FROM (SELECT doc_id, g, count(*) AS c FROM w GROUP BY 1, 2)),
b AS (SELECT *, sum(c) OVER (PARTITION BY p, g) AS a FROM (SELECT doc_id, p, g, count(*) AS c FROM w WHERE p IS NOT NULL GROUP BY 1, 2, 3)),
x AS (SELECT *, sum(c) OVER (PARTITION BY q, p, g) AS a FROM (SELECT doc_id, q, p, g, count(*) AS c FROM w WHERE q IS NOT NULL GROUP BY 1, 2, 3, 4)),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT w.doc_id, ug.a - ug.c AS c1, b.a - b.c AS c2, x.a - x.c AS c3, up.a - up.c AS cp, bp.a - bp.c AS cq, (SELECT sum(n) FROM t) - t.n AS rest, w.p, w.q
    FROM w JOIN t ON t.doc_id = w.doc_id JOIN u ug ON ug.doc_id = w.doc_id AND ug.g = w.g
    LEFT JOIN b ON b.doc_id = w.doc_id AND b.p = w.p AND b.g = w.g LEFT JOIN u up ON up.doc_id = w.doc_id AND up.g = w.p
    LEFT JOIN x ON x.doc_id = w.doc_id AND x.q = w.q AND x.p = w.p AND x.g = w.g LEFT JOIN b bp ON bp.doc_id = w.doc_id AND bp.p = w.q AND bp.g = w.p),
r AS (SELECT doc_id, sum(ln(CASE WHEN q IS NOT NULL AND c3 > 0 THEN c3 / cq
        WHEN p IS NOT NULL AND c2 > 0 THEN (CASE WHEN q IS NULL THEN 1 ELSE 0.4 END) * c2 / cp
        ELSE (CASE WHEN p IS NULL THEN 1 WHEN q IS NULL THEN 0.4 ELSE 0.16 END) * (CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END) / greatest(rest, 1) END)) AS y,
    count(*) FILTER (CASE WHEN p IS NULL THEN c1 > 0 WHEN q IS NULL THEN c2 > 0 ELSE c3 > 0 END) AS f FROM s GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_full, round(y / len(l), 6) AS mean_log FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
