"""The corpus pipeline: five stages from raw documents to shards, each applied to all that its predecessor kept.

Defined cases. Null, empty and very long texts: whole texts everywhere; a null or empty text has no evidence of its own
(its site decides), is never a near copy, holds no benchmark passage, has no tokens, and weighs one row in its shard.
Null ids: their rows are never near copies and stay. Repeated rows: the near-dedup keeps one row of an id; mixing may
repeat it again, on purpose. Ties: the smallest id stays; the lowest shard takes. Empty documents: an empty result.
Empty labels: nothing is rejected and nothing repeated; an empty benchmark: nothing is dropped. Columns beside those of
documents pass through all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import decontam, mixing, quality, sharding, simhash
from glosswork.llm.common import cut, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs, read(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [("quality classifier", classify), ("simhash near-dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Trained models, SimHash groups, edit distances and greedy packing have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over documents; lineage is cut between them."""
    docs = read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
    return docs
