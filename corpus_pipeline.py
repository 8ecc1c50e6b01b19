"""A corpus pipeline of the operators: rate, deduplicate, decontaminate, mix, shard.

Edge cases, of every stage: an empty table stays empty; null ids and texts are documents as others
are (a null text counts as empty); repeated rows are each decided on their own, except that near-duplicates
leave one; columns beside doc_id, text and source pass unchanged under any name, but that sharding
replaces columns named shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, neardup, quality, sharding
from tidemark.llm.common import SPACED, durable, hidden, table

N_SHARDS = 24


#: The columns that operators read here.
READ = ("doc_id", "text", "source")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those with a score under its threshold.

    Texts without words have the classifier's bias as score; without labels of both kinds all rows share one score."""
    plain, back = hidden(docs, *READ)
    return quality.score_quality(plain, table(spark, sf_dir, "labels"), keep=plain.columns).where("predicted = 1").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Groups are told apart by their rows, not by ids: documents that share an id or have none all
    stay, unless their texts are near-duplicates. Texts without words link with nothing and all stay."""
    return neardup.unlike_documents(docs, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Texts without words contain none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents are left out or repeated. Null is a source of its own."""
    plain, back = hidden(docs, *READ)
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = mixing.mix(plain, F.regexp_count(text, F.lit(SPACED)), [F.col("doc_id"), F.md5(text)])
    return mixing.emit(mixed, plain.columns).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and slot; each shard matches the mixture."""
    return sharding.interleave(docs, N_SHARDS, [F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))])


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: The classifier and the links have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
