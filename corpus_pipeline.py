"""Documents to training sequences: the stages that a corpus passes, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteloom.llm import decontaminate, near_dedup, packing, pii, quality
from noteloom.llm._shared import cut, drop, table, temporary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: No SQL: the classifier's vectors and the packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. What a stage wrote meanwhile goes when its result is stored, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with temporary() as made:
            docs = cut(stage(spark, docs, sf_dir))
        drop(before, *(t for t in made if t is not docs))
