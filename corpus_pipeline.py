"""A corpus pipeline over ``documents``: each stage calls one operator of ``dimlark.llm``.

Each stage works on all that its predecessor kept; the last deals the mix to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimlark.llm import decontam, langid, mixing, nearcopies, secrets
from dimlark.llm.common import col, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that identification rejects go."""
    model = langid.fit(docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), "text")
    return langid.predict(rows, model).where(~F.col("rejected")).select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard of 0.8 or more): that with the smallest id."""
    return nearcopies.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; what is mostly benchmark goes."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in its shard's order."""
    return mixing.shard_rows(mixing.mixed(docs, keep=tuple(docs.columns)))


STAGES = [
    ("language id", identified),
    ("simhash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scan", redacted),
    ("source mix", mixed),
]

#: SQL can't express the first three stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
