"""From raw documents to a sharded training corpus.

Stages, in order: quality rules (rejected documents go), MinHash near-dedup (one
document of each group stays), benchmark decontamination (documents that hold a
benchmark item go), mixing sources to target weights (documents come as often as
the mix takes them), sharding (each row gets its old and new shard).

A null column never stops a stage: null texts fail the length rule; a null id is
never a duplicate; a null source is a source of its own. No stage but the first can
be expressed in SQL as a whole, so the pipeline is tested stage by stage against
brute force.

Stages bound the bytes of Arrow batches in the session, since their plans run
after they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakforge.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from peakforge.llm.common import ARROW_BYTES, BATCH_BYTES, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
