"""A training-data pipeline in five stages.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> personal data
-> packing.  Each stage works on all rows its predecessor kept; its result is
written as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``; packing returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritome.llm import decontamination, jaccard_join, packing, personal_data, quality_rules, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    scratch.bound_batches(spark)
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    scratch.bound_batches(spark)
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item or an edited copy of one."""
    scratch.bound_batches(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    scratch.bound_batches(spark)
    return personal_data.redact(docs, personal_data.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    scratch.bound_batches(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("personal data", redact),
    ("packing", pack),
]

#: The tagger and the tokenizer have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.cut(docs)
    return docs
