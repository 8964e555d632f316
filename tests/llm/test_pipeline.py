"""The pipeline's stages on a small fixture: each decision against brute force or a planted case."""

import random

import corpus_pipeline
from qspark.llm.common import stage
from tests.llm.test_duplicates import removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages(spark, tmp_path):
    passage, item = text("passage", 60), text("item", 12)
    rows = [(k, text(k), "en", "s", 1) for k in range(20)]
    rows += [(30, text(3), "en", "s", 1), (31, text(4) + " end", None, "s", None)]  # copies of 3 and 4
    rows += [(40, f"{text(40)} {passage}", "en", "s", 1), (41, f"{text(41)} {passage} {text(42)}", "en", "s", 1)]
    rows += [(50, f"{text(50)} {item} {text(51)}", "en", "s", 1), (60, "123 456", "en", "s", 1), (61, None, "en", "s", 1), (62, "", "en", "s", 1), (None, text("none"), "en", "s", 1)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    at = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, str(tmp_path)), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        at[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(at["language_id"]) == {r[0] for r in rows} - {60, 61, 62}
    assert set(at["near_duplicates"]) == set(at["language_id"]) - {30, 31}
    want = removed(list(at["near_duplicates"].items()))
    cut = at["suffix_dedup"]
    assert all(len(cut[d].encode()) == want[d][0] - want[d][1] for d in cut if d is not None) and passage[5:] not in cut[41] and passage in cut[40]
    assert set(at["decontamination"]) == set(cut) - {50}
    packed = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(at["decontamination"])


def test_foreign_and_gibberish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    letters = random.Random(7)
    planted = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi.",
        *(" ".join("".join(letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(letters.randint(2, 9))) for _ in range(n)) for n in (5, 30, 400, 4000)),
    ]
    rows = spark.createDataFrame([(10**9 + k, t, None, "planted", len(t)) for k, t in enumerate(planted)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(rows), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path)) if docs.columns == corpus_pipeline.COLUMNS else docs
    assert docs.count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
