"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

quality rules -> exact dedup -> SimHash near-dedup -> source mixing -> packing. All but the last return the columns
of ``documents``; the mix repeats a document that it takes twice. Near-duplicates are texts whose sets of five-word
shingles are alike from 0.8 on.

Null texts fail the quality rules; null keys are kept as documents of their own, and of equal or alike texts a row with
a key stays before one without. Rows that repeat count as copies. An empty table gives an empty result. Extra columns
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import exact, mixing, packing, quality, simhash
from kinetrace.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixing_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the fingerprints nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
