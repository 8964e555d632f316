import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from qspark.llm import chat, langid, lm, queries, quality, toxicity
from qspark.llm.common import crc_mod

DIR = "/root/testdata/sf0.001"


def test_quality(spark, odd, real):
    for docs in (odd, real):
        got = {(r["doc_id"], r["n_words"]): r for r in quality.quality_rules(docs).collect()}
        for r in docs.select("doc_id", "text").collect():
            text = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            x = got[r["doc_id"], len(w)]
            lines = [y for y in text.split("\n")]
            dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", y)) and y in lines[:k] for k, y in enumerate(lines))
            three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            count: dict = {}
            for t in three:
                count[t] = count.get(t, 0) + 1
            repeat = {k + j for k, t in enumerate(three) if count[t] > 1 for j in range(3)}
            assert (x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat))
            assert x["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (x["base_failed"] and x["kept"])
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_verdict():
    clean = " ".join(f"a{k}" for k in range(300)).encode()
    again = (" ".join(f"a{k}" for k in range(100)) + " " + " ".join(f"a{k}" for k in range(80)) + " " + " ".join(f"b{k}" for k in range(300))).encode()
    x = quality.analyse([clean, again])
    assert x["kept"].tolist() == [True, False] and x["longest_repeat"].tolist() == [0, 80] and x["n_covered"].tolist() == [0, 160]


def test_quality_repeats_by_brute_force():
    r = random.Random(5)
    texts = []
    for _ in range(25):
        w = [f"w{r.randrange(40)}" for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            a = r.randrange(len(w) + 1)
            w[r.randrange(len(w) + 1) : 0] = w[a : a + r.randrange(30)]
        texts.append(w)
    texts += [["x"] * 60, [], ["one"]]
    got = quality.analyse([" ".join(w).encode() for w in texts])
    for k, w in enumerate(texts):
        n = len(w)
        longest, cover = 0, set()
        for i in range(n):
            for j in range(n):
                m = 0
                while i != j and i + m < n and j + m < n and w[i + m] == w[j + m]:
                    m += 1
                if m >= quality.LEAST_WORDS:
                    longest = max(longest, m)
                    cover |= set(range(i, i + m))
        assert (got["n_covered"][k], got["longest_repeat"][k]) == (len(cover), longest)
        assert got["kept"][k] == (not got["base_failed"][k] and len(cover) <= 0.3 * n and longest <= max(8, 0.2 * n) and longest <= 200)


def test_quality_of_a_long_text():
    x = quality.analyse([b"a " * 300_000])
    assert (x["n_words"][0], x["n_covered"][0], x["longest_repeat"][0]) == (300_000, 300_000, 299_999)


def grams(text):
    """Counts of letter n-grams as (place keys): by definition."""
    from collections import Counter

    out: Counter = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        c = [0, *map(ord, w), 0]
        f = langid.FILLER
        out.update((f, f, x) for x in c[1:-1])
        out.update((a, f, b) for a, b in zip(c, c[1:]))
        out.update(zip(c, c[1:], c[2:]))
    return out


def test_language_by_brute_force(spark, odd):
    docs = odd.unionByName(spark.read.parquet(f"{DIR}/documents.parquet").select(F.col("doc_id") + 1000, "text", "lang", "source", "n_chars", F.lit("c").alias("chunk"), F.lit(0).alias("score")).toDF(*odd.columns).limit(60))
    rows = docs.select("doc_id", "text", "lang").collect()
    total: dict = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            total[r["lang"]] = total.get(r["lang"], grams("")) + grams(r["text"])
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]
    profiles = {k: {g: i for i, g in enumerate(order(c))} for k, c in total.items() if c}
    want = []
    for r in rows:
        own = order(grams(r["text"] or ""))
        far = {k: sum(abs(i - p[g]) if g in p else langid.TOP for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want.append((r["doc_id"], best if own else "und", round(1 - far[best] / (len(own) * langid.TOP), 9) if own else 0.0))
    for block in (1000, 2):  # all languages at once, and two by two
        got = langid.language_id(docs, F.col("lang").isNotNull(), block=block).collect()
        assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got), key=str) == sorted(want, key=str)


def test_language(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = queries.op6_language_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) > 0
    x = {r["doc_id"]: r for r in langid.language_id(odd, F.col("lang").isNotNull()).collect()}
    assert len(x) == 10 and all(x[k]["lang_pred"] == "und" and x[k]["score"] == 0 for k in (3, 4, 5, 6)) and x[1]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.language_id(odd, F.lit(False)).collect()} == {"und"}
    assert langid.language_id(odd.limit(0), F.lit(True)).count() == 0


def test_language_profile_counts():
    import numpy as np

    who, gram, n = langid.gram_counts([b"ab a", b"B1"], np.arange(2))
    text = {}
    for w, g, k in zip(who.tolist(), gram.tolist(), n.tolist(), strict=True):
        text[w, "".join({0: "_", langid.FILLER: ""}.get(c, chr(c) if c < 0x110000 else "") for c in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))] = k
    assert text == {(0, "a"): 2, (0, "b"): 1, (0, "_a"): 2, (0, "ab"): 1, (0, "b_"): 1, (0, "a_"): 1, (0, "_ab"): 1, (0, "ab_"): 1, (0, "_a_"): 1, (1, "b"): 1, (1, "_b"): 1, (1, "b_"): 1, (1, "_b_"): 1}


def test_toxicity(spark, odd):
    texts = [(k, " ".join(f"w{k}q{j}" for j in range(12)) + (" you IDI0T" if k % 2 else ""), k % 2) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in texts] + [(None, 1, 1), (1, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    assert "idiot" in model.weights
    new = [(1, "an іdiоt, they said"), (2, "idiot proof design"), (3, "idiotic"), (4, None), (5, ""), (6, "a clean text")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert [got[k]["predicted"] for k in range(1, 7)] == [1, 0, 0, 0, 0, 0] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(odd, model).count() == odd.count()
    empty = toxicity.train(docs, labels.limit(0))
    assert not empty.weights and {r["score"] for r in toxicity.score(odd, empty).collect()} == {0.0}


def test_toxicity_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for k in range(200):
        w = [f"c{r.randrange(3000)}" for _ in range(r.randrange(8, 30))]
        bad = k % 4 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["grubber", "snarfle"]))
        elif k % 20 == 1:
            w += ["snarfle", "soup"]
        rows.append((k, " ".join(w), int(bad)))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, labels, exceptions=())
    folded = {k: re.findall(r"\w+", toxicity.fold(t)) for k, t, _ in rows}
    toxic = sum(y for *_, y in rows)
    want = {}
    for w in {w for x in folded.values() for w in x if len(w) > 2}:
        bad = sum(y and w in folded[k] for k, _, y in rows)
        good = sum(not y and w in folded[k] for k, _, y in rows)
        odds = math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (len(rows) - toxic + 1))
        if bad >= max(toxicity.LEAST_DOCS, math.ceil(0.01 * toxic)) and odds >= toxicity.LEAST_ODDS:
            want[w] = odds
    # a word that clean documents have as well is no lexicon word; without the dish it is
    assert "grubber" in want and model.weights == pytest.approx(want)
    texts = [t for _, t, _ in rows[:40]] + ["grubber " * 50, "agrubber", "a GRUBB3R!"]
    got = {x["doc_id"]: x for x in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        total = sum(want.get(w, 0) for w in re.findall(r"\w+", toxicity.fold(t)))
        z = model.curve[0] + model.curve[1] * (total > 0) + model.curve[2] * math.log1p(10 * total / math.sqrt(max(1, len(t.split()))))
        assert (got[k]["weight"], got[k]["score"]) == (pytest.approx(total), pytest.approx(1 / (1 + math.exp(-z))))
        assert got[k]["predicted"] == (got[k]["score"] >= 0.5)


def test_toxicity_learns_exceptions(spark):
    rows = [(k, " ".join(f"t{k}q{j}" for j in range(9)) + tail, y) for k, (tail, y) in enumerate([(" wretched grubber", 1)] * 60 + [(" grubber hoe", 0)] * 4 + [("", 0)] * 400)]
    model = toxicity.train(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    assert "grubber hoe" in model.exceptions and "wretched grubber" not in model.exceptions and "grubber" in model.weights
    got = toxicity.score(spark.createDataFrame([(1, "my grubber hoe"), (2, "you grubber, no hoe"), (3, "grubber hoe or grubber")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["weight"] for r in got] == [0.0, model.weights["grubber"], model.weights["grubber"]]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got) > 0


def backoff(rows, alpha=0.4):
    from collections import Counter

    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    one, two = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:], strict=False))
    out = []
    for x in words:
        o, t = Counter(x), Counter(zip(x, x[1:], strict=False))
        n, s = max(sum(one.values()) - len(x), 1), 0.0
        for k, w in enumerate(x):
            p = x[k - 1] if k else None
            c = one[w] - o[w]
            if k and two[p, w] - t[p, w] > 0:
                s += math.log((two[p, w] - t[p, w]) / (one[p] - o[p]))
            else:
                s += math.log((alpha if k else 1) * (c or 0.5) / n)
        out.append((len(x), round(s, 6)))
    return out


@pytest.mark.parametrize("chunk,bucket", [(8 << 20, 24 << 20), (1000, 5000)])
def test_backoff(spark, odd, chunk, bucket):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lm.scores(odd, chunk=chunk, bucket=bucket).collect()
    assert sorted((r["n_words"], round(r["log_score"], 4)) for r in got) == sorted((n, round(s, 4)) for n, s in backoff(rows))
    assert all((r["mean_log"] is None) == (r["n_words"] == 0) for r in got)
    assert lm.scores(odd.limit(0)).count() == 0


def test_backoff_trigrams(spark, odd, tmp_path):
    from collections import Counter

    odd.where("doc_id <> 8 or doc_id is null").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in odd.collect() if r["doc_id"] != 8}
    grams = lambda x: Counter(tuple(x[k : k + n]) for n in (1, 2, 3) for k in range(len(x) - n + 1))
    total = sum((grams(x) for x in rows.values()), Counter())
    got = {r["doc_id"]: r for r in queries.op8_trigram_scores(spark, str(tmp_path)).collect()}
    assert got.keys() == rows.keys()
    for d, x in rows.items():
        left, rest, s, full = total - grams(x), sum(map(len, rows.values())) - len(x), 0.0, 0
        for k in range(len(x)):
            n = next((n for n in range(min(k + 1, 3), 0, -1) if left[tuple(x[k - n + 1 : k + 1])]), 0)
            full += n == min(k + 1, 3)
            seen = left[tuple(x[k - n + 1 : k + 1])] if n else 0.5
            s += math.log(0.4 ** (min(k + 1, 3) - max(n, 1)) * seen / (left[tuple(x[k - n + 1 : k])] if n > 1 else max(rest, 1)))
        assert (got[d]["n_words"], got[d]["n_full"]) == (len(x), full)
        assert got[d]["mean_log"] == (pytest.approx(s / len(x), abs=2e-6) if x else None)
    assert 0 < got[1]["n_full"] == got[1]["n_words"]  # its copies support every trigram


def test_chat(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", None),
            (2, "chosen", None, None, None), (2, "rejected", None, None, None), (2, "rejected", 0, "assistant", ""), (3, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"),
            (4, "chosen", 0, "user", "same"), (4, "chosen", 0, "user", "same"), (4, "rejected", 0, "user", "same"), (4, "other", 0, "user", "same"),
            *((5, "chosen", 0, "user", x) for x in "ABBD"), *((5, "rejected", 0, "user", x) for x in "ACCD")]
    parts = chat.preference(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"))
    got = sorted((r["pair_id"], r["part"], str(r["turn"]), r["loss"]) for r in parts.collect())
    assert got == sorted([(1, "prompt", "0", False), (1, "chosen", "1", True), (1, "rejected", "1", True), (1, "rejected", "2", False), (2, "prompt", "None", False), (2, "rejected", "0", True), (4, "chosen", "0", False), (4, "chosen", "0", False), (4, "rejected", "0", False), *[(5, "chosen", "0", False)] * 4, *[(5, "rejected", "0", False)] * 4])
    r = next(x for x in chat.assemble(parts).collect() if x["pair_id"] == 1)
    assert r["prompt"] == "<|user|>\nhi\n<|end|>\n" and r["rejected"] == "<|assistant|>\nbad\n<|end|>\n<|user|>\n\n<|end|>\n"
    a, = r["rejected_loss"]
    assert r["rejected"][a["start"] : a["start"] + a["length"]] == "<|assistant|>\nbad\n<|end|>\n"
    assert "Python" not in parts._jdf.queryExecution().executedPlan().toString()


def test_all_pairs(spark, tmp_path):
    answers = {0: "a0", 1: "a1", 2: "a2", 5: "a5", 8: "a8"}  # 3 has none
    partner = {0: 1, 1: 0, 2: 5, 5: 2, 8: 0}
    rows = [(k, 0, "user", f"q{k}") for k in (0, 1, 2, 3, 5, 8)] + [(k, 1, "assistant", a) for k, a in answers.items()] + [(2, 2, "user", "thanks"), (None, 1, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["pair_id"]: r for r in queries.op3_preference_records(spark, str(tmp_path)).collect()}
    assert got.keys() == answers.keys()
    for k, r in got.items():
        own, theirs = (f"<|assistant|>\n{answers[x]}\n<|end|>\n" for x in (k, partner[k]))
        assert (r["prompt"], r["rejected"]) == (f"<|user|>\nq{k}\n<|end|>\n", theirs) and r["chosen"].startswith(own)
        assert (r["chosen_starts"], r["chosen_lengths"], r["rejected_lengths"]) == ([0], [len(own)], [len(theirs)])
    one = spark.createDataFrame([(3, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert chat.all_pairs(one).count() == 0 and chat.all_pairs(one.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    from tests.test_registry import table

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert table(queries.QUERIES[name](spark, DIR).toPandas()) == table(db.execute(queries.ORACLES[name]).df())


def test_crc(spark):
    import zlib

    r = spark.range(20).select("id", crc_mod(F.col("id"), 5).alias("m")).collect()
    assert all(x["m"] == zlib.crc32(str(x["id"]).encode()) % 5 for x in r)
