"""The registered queries of this subpackage: thin, each through its operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, lm, minhash, packing, suffix_dedup, token_io, toxicity
from .common import crc_mod
from .quality import quality_rules

def tokenizer() -> str:
    """Where the tokenizer file is; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "weight")


@query
def op2_near_duplicates(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents"), n=4, percent=80)


@query
def op3_preference_records(spark, d):
    records = chat.assemble(chat.preference(chat.all_pairs(table(spark, d, "conversations"))))
    spans = (F.col(f"{side}_loss.{of}").alias(f"{side}_{of}s") for side in ("chosen", "rejected") for of in ("start", "length"))
    return records.select("pair_id", "prompt", "chosen", "rejected", *spans)


ORACLES["op3_preference_records"] = chat.RECORDS_SQL


@query
def op3_preference(spark, d):
    return chat.preference(chat.pairs(table(spark, d, "conversations")))


ORACLES["op3_preference"] = chat.SQL


@query
def op4_suffix_dedup(spark, d):
    return suffix_dedup.removals(table(spark, d, "documents"))


@query
def op5_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), tokenizer())


@query
def op6_language_id(spark, d):
    docs = table(spark, d, "documents")
    found = langid.language_id(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_token_files(spark, d):
    return token_io.read_tokens(token_io.write_tokens(table(spark, d, "documents"), tokenizer(), end_id=2))


@query
def op8_trigram_scores(spark, d):
    return lm.scores(table(spark, d, "documents"), order=3).select("doc_id", "n_words", "n_full", F.round("mean_log", 6).alias("mean_log"))


ORACLES["op8_trigram_scores"] = lm.TRIGRAM_SQL


@query
def op8_backoff_scores(spark, d):
    return lm.scores(table(spark, d, "documents")).select("doc_id", "n_words", "n_full", F.round("mean_log", 6).alias("mean_log"))


ORACLES["op8_backoff_scores"] = lm.SQL


@query
def op9_decontamination(spark, d):
    return decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLES["op9_decontamination"] = decontam.SQL


@query
def op10_quality(spark, d):
    return quality_rules(table(spark, d, "documents"))
