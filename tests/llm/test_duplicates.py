import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from qspark.llm import components, decontam, minhash, suffix_dedup
from qspark.llm.suffix_dedup import Plan

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def near(rows):
    random.seed(2)
    base = [" ".join(f"v{random.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    out = list(rows)
    for k in range(120):
        w = base[k % 4].split()
        for _ in range(random.randrange(4)):
            w[random.randrange(60)] = f"e{random.randrange(10**6)}"
        out.append((100 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [10**9, 1500])
def test_near_duplicates(spark, odd, block, monkeypatch):
    """Against all pairs; with tiny blocks clusters are cut, so pivots and the query pass take part."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rows = near([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4).collect()
    sets = {(d, t): shingles(t, 4) for d, t in rows if d is not None}
    up = {d: d for d, _ in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a[0]), find(b[0])
            up[max(a, b)] = min(a, b)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == find(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def removed(rows, least=50):
    seen, out = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - least + 1):
            if seen.setdefault(b[i : i + least], d) < d:
                m[i : i + least] = True
        spans = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
        out[d] = (len(b), int(m.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("plan", [Plan(), Plan(3000, 20_000, 10_000, 2, 3000)])
def test_suffix_dedup(spark, odd, real, plan):
    """Against a dictionary of all strings; with tiny sizes there are many chunks and buckets, and frequent keys."""
    random.seed(3)
    passage = "".join(random.choice("abc de") for _ in range(200))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(r["doc_id"] + 1000, r["text"]) for r in real.collect()[:60]]
    rows += [(5000 + k, f"{k}{passage[k % 40 :]}{k * 7}" + "x" * (k % 3 * 60)) for k in range(40)]
    got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()
    want = removed(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] == want[r["doc_id"]]
    assert suffix_dedup.removals(odd.limit(0)).count() == 0


def test_repeat_groups():
    x = "0123456789" * 5
    groups = suffix_dedup.repeat_groups([f"a{x}b".encode(), f"c{x}d".encode(), f"e{x[1:]}f".encode()], 49)
    assert groups[0] == (50, [(0, 1), (1, 1)]) and (49, [(0, 2), (1, 2), (2, 1)]) in groups


def test_signatures_keep_pairs_at_the_threshold():
    """Verification by signature against true similarities: none at the threshold is dropped, few far below pass."""
    r = np.random.default_rng(4)
    least, lost, passed = int(minhash.LEAST_EQUAL * 0.8 * 128), 0, 0
    for _ in range(60):
        base = r.integers(0, 2**63, 400, dtype=np.uint64)
        for common, bound in ((356, 0.8), (120, 0.18)):  # of 444, and of 680
            a, b = np.sort(base), np.sort(np.concatenate([base[:common], r.integers(0, 2**63, 400 - common, dtype=np.uint64)]))
            _, x = minhash.band_keys(np.concatenate([a, b]), np.array([0, 400, 800]), 32, 4)
            ok = np.count_nonzero(x[0] == x[1]) >= least
            lost += bound == 0.8 and not ok
            passed += bound < 0.8 and ok
    assert (lost, passed) == (0, 0)


@pytest.mark.parametrize("least_rare", [0, 64])
@pytest.mark.parametrize("asked", [False, True])
def test_families_with_many_apart(monkeypatch, asked, least_rare):
    """Copies of a text with few and with many edits, against all pairs; full sets are compared for few of the pairs that stay apart."""
    random.seed(5)
    base, texts = [f"v{random.randrange(10**6)}" for _ in range(150)], []
    for k in range(400):
        w = list(base)
        for _ in range(random.randrange(1, 4) if k % 2 else random.randrange(4, 16)):
            i = random.randrange(len(w) - 1)
            w[i : i + 1] = random.choice([[], [w[i], "new"], [f"e{random.randrange(50)}"], [f"e{random.randrange(10**6)}"]])
        texts.append(" ".join(w))
    h, at = minhash.shingle_sets([t.encode() for t in texts], 4)
    keys, signature = minhash.band_keys(h, at, 32, 4)
    query = np.array([k % 3 == 0 for k in range(400)]) if asked else None
    label = [k // 40 if asked and k % 40 < 3 else None for k in range(400)]
    compared = [0]

    def counted(f, n):
        def run(*a):
            compared[0] += n(*a)
            return f(*a)

        return run

    monkeypatch.setattr(minhash, "LEAST_RARE", least_rare, raising=False)
    monkeypatch.setattr(minhash, "_alike", counted(minhash._alike, lambda *a: 1))
    if hasattr(minhash, "_Shared"):
        monkeypatch.setattr(minhash._Shared, "count", counted(minhash._Shared.count, lambda _, x, others: len(others)))
    got = minhash._confirm(list(range(400)), [h[a:b] for a, b in itertools.pairwise(at)], keys.view(np.int64), signature, label, query, 80)
    sets = [shingles(t, 4) for t in texts]
    alike = [(a, b) for a, b in itertools.combinations(range(400), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (not asked or query[a] or query[b])]
    assert set(map(tuple, map(sorted, got))) <= set(alike)

    def parts(links):
        up = list(range(400))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in [*links, *((k, k // 40 * 40) for k, x in enumerate(label) if x is not None)]:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return [find(k) for k in range(400)]

    assert parts(got) == parts(alike) and len(set(parts(got))) > 100
    assert compared[0] < 8000


def test_decontamination_by_brute_force(spark):
    """Items of all sizes, some spread over a document, at and around the threshold."""
    random.seed(11)
    word = lambda: f"w{random.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(random.choice([5, 6, 9, 17, 40, 130])))) for k in range(60)]
    docs = []
    for k in range(120):
        w = [word() for _ in range(random.randrange(200))]
        for _ in range(3):
            own = random.choice(items)[1].split()
            for _ in range(random.randrange(3)):
                own[random.randrange(len(own))] = word()
            at = random.randrange(len(w) + 1)
            w[at:at] = own[: len(own) - random.randrange(3)]
        docs.append((k, " ".join(w)))
    sets = lambda t: {tuple(x) for x in zip(*(t.split()[k:] for k in range(5)))}
    want = {(d, i, len(sets(s)), len(sets(t) & sets(s))) for d, t in docs for i, s in items if sets(s) and len(sets(t) & sets(s)) >= 0.8 * len(sets(s))}
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_found"]) for r in got.collect()} == want and len(want) > 100


def test_decontamination(spark, odd):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Some text. {item.upper()}! More"), (2, "one two three four five six seven eight other words"), (3, "one two three four five"), (4, None), (None, item), (1, item)]
    items = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, "too short", 1), (None, None, 1), (9, "", 1)], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_found"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()), key=str)
    assert got == sorted([(1, 7, 6, 6), (1, 7, 6, 6), (None, 7, 6, 6)], key=str)
    assert decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.contaminated(odd.limit(0), items).count() == 0
    clean = decontam.uncontaminated(spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int"), items).collect()
    assert sorted((tuple(r) for r in clean), key=str) == sorted([(d, t, 5) for d, t in docs[1:4]], key=str)
    close = decontam.contaminated(spark.createDataFrame([(2, docs[1][1])], "doc_id long, text string"), items, threshold=0.6).collect()
    assert [(r["n_found"], r["n_item"]) for r in close] == [(4, 6)]
