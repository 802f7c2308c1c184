"""The corpus pipeline: documents in, a mix of clean, distinct documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import Scratch
from larkspur.llm.decontaminate import drop_contaminated
from larkspur.llm.jaccard_join import one_of_each
from larkspur.llm.language_id import keep_identified
from larkspur.llm.mixing import mix
from larkspur.llm.secrets import redact

#: SQL can't express the stages (learned filters, hashed signatures, seeded draws); tests hold each
#: against a brute-force version instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null, letterless and unidentifiable texts go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, 5, 0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars is the length of the text as it is now."""
    from pyspark.sql import functions as F

    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: (doc_id, size, source_size, target, taken, copies, source)."""
    return mix(docs)


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("secret_scan", secrets), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes once the next one's is written."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
