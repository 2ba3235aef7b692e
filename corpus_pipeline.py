"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage works on all that the one before kept. Language ID drops texts in
no known language, line dedup deletes aligned common blocks from the later
document, SimHash near-dedup keeps the least id of each group, decontamination
drops documents that hold a benchmark passage, and the last stage codes what
is left.

Cases, for every stage: columns beyond doc_id and text stay as they are, under
any name but linedup's two own. Null texts are empty ones; repeated rows are rows of
their own until near-dedup keeps one of them. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import bpe, common, decontam, langid, linedup, simhash

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Below this kernel score a text is in no known language.
LEAST_SCORE = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null, empty and letterless texts go. Without labels all stay."""
    return langid.keep_known(docs, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that a document of smaller id holds; null texts and documents without id stay as they are."""
    return linedup.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least id; of equal rows one. Texts without words are one group."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copied passage of a test item; wordless texts hold none, an empty benchmark drops nothing."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's tokens; null and empty texts have none."""
    return bpe.digest(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs, f"stage-{k}-{stage.__name__}")
    return docs
