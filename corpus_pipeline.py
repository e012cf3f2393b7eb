"""A training corpus from raw documents: quality, near copies, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import documents, stored
from candlewick.llm.decontaminate import leaks
from candlewick.llm.mixing import mix
from candlewick.llm.near_dedup import near_duplicates
from candlewick.llm.quality import reject
from candlewick.llm.sharding import shard

#: Model training draws batches from so many shards.
SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject, and lines over the limit of their host."""
    return reject(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies (five words, 0.8).

    Rows of one id are one document and stay together; rows without an id stay.
    """
    gone = stored(near_duplicates(docs, size=5, percent=80).where("NOT kept").select(
        F.col("doc_id").alias("gone")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = stored(leaks(docs, benchmark).select(
        F.col("doc_id").alias("leaked"), F.col("version").alias("leaked_version")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"))
    version = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    return rows.join(
        found, F.col("row.doc_id").eqNullSafe(F.col("leaked")) & (version == F.col("leaked_version")), "left_anti",
    ).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources reach their target shares, in random order."""
    return mix(docs).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all rows to shards whose counts differ by one at most: the columns of ``docs``, ``shard``, ``slot``.

    Columns of ``docs`` that have one of these two names already give way to the new ones.
    """
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard(docs, SHARDS).select(*own, "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shards", shards),
]

#: The stages hash, sketch and draw in ways that SQL of another engine does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
