"""A corpus pipeline over documents: (name, function) stages, each through one operator.

Each stage gets the documents that its predecessor kept; all but the last return the columns of documents (n_chars is counted
again where a text changes). A document with a null doc_id is no copy of another and loses no passage; its language and benchmark
items are judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qspark.llm import decontam, langid, minhash, packing, suffix_dedup
from qspark.llm.common import stage
from qspark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text closer to no language than this (of 0 to 1) is rejected, and one without letters. Of the rows of sf0.1 the lowest
#: has 0.40; Polish, Finnish, Vietnamese and 5 to 4000 words of random letters have 0.15 to 0.30, Dutch 0.37, "asdf qwer zxcv" 0.37.
LEAST_LANGUAGE_SCORE = 0.33


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters or far from every learned language."""
    found = langid.language_id(docs, F.col("lang").isNotNull(), keep=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller doc_id has, too, are cut out; documents of which nothing is left go. Each row gets its own result."""
    kept = suffix_dedup.deduplicated(docs, keep=tuple(COLUMNS[2:]))
    out = kept.where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; each row is judged by itself, also one without a doc_id."""
    return decontam.uncontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, tokenizer())


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("suffix_dedup", repeated_passages), ("decontamination", benchmark_leaks), ("packing", packed)]
#: SQL can express neither the language profiles' training order nor the packing; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
