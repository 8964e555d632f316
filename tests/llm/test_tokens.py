import math
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from qspark.llm import packing, token_io, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(PATH)


def ids(text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000), max_size=200), st.integers(1, 70))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, blocks, escapes = token_io.encode(v, block)
    assert (token_io.decode(words, escapes) == v).all()
    for k in range(len(blocks)):  # any block alone
        lo, hi = blocks[k], blocks[k + 1] if k + 1 < len(blocks) else len(words)
        own = escapes[(escapes >= lo) & (escapes < hi)] - lo
        assert (token_io.decode(words[lo:hi], own) == v[block * k : block * (k + 1)]).all()


def test_cache_gives_the_library_s_ids():
    random.seed(0)
    parts = ["a", "the", " ", "  ", "\n", ".", ",", "'s", "'", "é", "1", "23", " \n", "\t", "\x1c", "\x85", "　", "<|endoftext|>", "ñ", "!", "don't ", "word, ", "word. "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(2000)]
    code = tokens.Coder(PATH)
    for part in (texts[:1000], texts[1000:]):
        flat, n = code.encode(part)
        ends = np.cumsum(n)
        assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [ids(t) for t in part]


def test_a_full_cache_gives_the_library_s_ids():
    random.seed(1)
    code = tokens.Coder(PATH)
    code.MOST = 300  # some pieces are kept, others given up
    shrink, kept = code._shrink, []
    code._shrink = lambda: (shrink(), kept.append(len(code.numbers)))
    for _ in range(30):
        texts = [" ".join(random.choice("abcdefgh") * random.randint(1, 40) + random.choice(["", ",", "?", " ", "\n"]) for _ in range(random.randint(0, 30))) for _ in range(20)]
        flat, n = code.encode(texts)
        ends = np.cumsum(n)
        assert [flat[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [ids(t) for t in texts]
    assert max(kept) > 0 and max(kept) <= 150


def test_files(spark, odd, real):
    for docs in (odd, real, odd.limit(0)):
        rows = docs.select("doc_id", "text").collect()
        got = token_io.read_tokens(token_io.write_tokens(docs, PATH, 2), with_ids=True).collect()
        assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r["doc_id"]), [*ids(r["text"]), 2]) for r in rows)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert order == sorted(order)


def test_span_of_a_row():
    v = np.array([k * k % 60_000 + (k % 997 == 0) * 2**61 for k in range(10_000)], np.uint64)
    row = token_io.encode(v)
    for start, n in ((0, 1), (2047, 2), (5000, 0), (4096, 2048), (9999, 1), (0, 10_000), (100, 7000)):
        assert (token_io.decode_span(*row, start, n) == v[start : start + n]).all()


def test_packing(spark, odd, real):
    for docs in (odd, real, odd.limit(0)):
        rows = docs.where("doc_id is not null").select("doc_id", "text").distinct().collect()
        got = packing.pack(docs, PATH).collect()
        want = {r["doc_id"]: [*ids(r["text"]), 0] for r in rows}
        for d, full in want.items():
            own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d})
            assert [p for p, *_ in own] == list(range(math.ceil(len(full) / 2048))) and sum(n for *_, n, _ in own) == len(full)
            assert all(n == 2048 for _, _, n, _ in own[1:])
            assert all(zlib.crc32(np.array(full[s : s + n], "<u4").tobytes()) == c for _, s, n, c in own)
        bins: dict = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 2048
        total = sum(r["length"] for r in got)
        assert len(bins) <= math.ceil(total / 2048) * 1.02 + 1


def test_packing_merges_over_tasks(spark):
    items = spark.range(3000).selectExpr("id", "cast(id % 97 + 3 as bigint) as filled", "array(named_struct('bin', id, 'at', cast(0 as bigint))) as members")
    merged = packing._merge(items, 3, 100).collect()
    assert sorted(m["bin"] for r in merged for m in r["members"]) == list(range(3000))
    for r in merged:
        at = 0
        for m in sorted(r["members"], key=lambda m: m["at"]):
            assert m["at"] == at
            at += m["bin"] % 97 + 3
        assert at == r["filled"] <= 100
