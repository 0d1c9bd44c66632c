"""From raw documents to packed training sequences, in five stages of whole-table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridrift.llm import langid, packing, quality, simhash, suffix_dedup, token_counts
from veridrift.llm.common import shared_folder
from veridrift.llm.queries import piece_model_path
from veridrift.sources.session import importable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; what has no letters or parses like none goes."""
    importable(spark)
    return langid.keep_identified(docs, langid.learn(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    return quality.keep_good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles alike by 0.8 or more."""
    return simhash.keep_one_copy(docs, similarity=0.8, size=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document with the smallest id only."""
    return suffix_dedup.cut_passages(docs, window=50)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, capacity and offset."""
    return packing.pack(token_counts.count_tokens(docs, piece_model_path(), entries=0))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("bestfit_packing", pack_sequences),
]

#: No SQL expresses the trained stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
