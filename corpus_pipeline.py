"""A training corpus in five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, with their decisions in effect.  The last returns the shard manifest.

Defined cases, in every stage: an empty table gives an empty one; columns of any other name pass
through unread, whatever their names; rows that repeat a doc_id are rows of their own.  A null text
is an empty one: quality rejects it, and in a later stage alone it is a class of near duplicates with
the other empty texts, is never contaminated, has size 0 in the mix (so it isn't taken) and size 1
in the manifest.  A null source is a source of its own; a null doc_id counts as the largest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, jaccard_join, quality_rules, sharding, source_mixing
from spindrift.llm.common import cut, read
from spindrift.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_rules.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    ship(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document comes as often as it is taken."""
    ship(spark)
    return source_mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ship(spark)
    return sharding.sharding_query(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: MinHash candidates and label propagation aren't expressible in SQL; tests hold the near-duplicate
#: stage against brute force and the others against their operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
