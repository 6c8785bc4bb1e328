"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Rows that a filter rejects go; the near-dedup keeps one row of each component, the one with the smallest id; suffix-array dedup
rewrites texts (and n_chars); packing gives every document that is left its bucket, batch and place,
and keeps its text and other columns, so that batches can be read as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common as C
from corvane.llm import hyperlang, quality
from corvane.llm.minhash import STAGE, one_of_each
from corvane.llm.packing import pack
from corvane.llm.suffixarray import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, C.read(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperlang.keep_known(docs, hyperlang.train(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, *STAGE)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, whole=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]
#: Trained models and suffix arrays have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
