"""Training-corpus pipeline: documents in, token ids out.

Each stage takes all documents that the one before it kept, is written to the
shared folder and read again. Toxic documents, all but one of each group of near
copies, and documents that hold a benchmark item go; personal data in what is left
is replaced; the texts end as byte-level BPE ids with the text decoded from them.

Cases: null texts count as empty and null ids are documents like others; empty
tables give an empty result with the same columns; other columns of documents pass
through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import bpe, privacy, simhash, tiling, toxicity
from shelfscope.llm.common import materialise

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0, by a model of the labelled ones (operator 5)."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id (operator 9)."""
    return simhash.keep_one(docs, simhash.SHINGLE, simhash.DISTANCE)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order of its passages (operator 6)."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and what reveals it replaced; n_chars follows the text (operator 4)."""
    clean = privacy.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids and n_tokens; text is what the ids decode to (operator 2)."""
    both = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, ids="token_ids", decoded="_decoded")
    return (both.withColumn("text", F.col("_decoded").cast("string")).drop("_decoded")
            .withColumn("n_tokens", F.size("token_ids").cast("long")))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("bpe", to_tokens),
]

#: Trained models, fingerprints and merges have no SQL form; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
