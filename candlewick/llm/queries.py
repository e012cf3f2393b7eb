"""The queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.alignment import align
from candlewick.llm.bloom_lm import score
from candlewick.llm.common import documents
from candlewick.llm.decontaminate import leaks
from candlewick.llm.extract import extract
from candlewick.llm.line_dedup import line_dedup
from candlewick.llm.merkle import manifest
from candlewick.llm.mixing import mix
from candlewick.llm.near_dedup import near_duplicates
from candlewick.llm.pii import KINDS, pii
from candlewick.llm.quality import quality
from candlewick.llm.secrets import STRONG, secrets, span_text
from candlewick.llm.sharding import shard
from candlewick.llm.toxicity import toxicity


def op1_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score(documents(spark, folder))


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return secrets(documents(spark, folder)).select(
        "doc_id",
        *[F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}")
          for kind in STRONG],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")).drop("version")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(documents(spark, folder)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), size=2)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii(documents(spark, folder)).withColumn("span", F.expr(
        "transform(kinds, (k, i) -> struct(k AS kind, concat_ws(':', k, starts[i], ends[i]) AS text))"))
    base = F.filter("span", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.expr(f"filter(kinds, k -> k = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(F.transform(base, lambda s: s["text"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("span", lambda s: s["text"]), ",").alias("spans"))


def op7_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("row.doc_id", "row.source", "copy", "row.text")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder)).drop("over_at", "body")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(documents(spark, folder), carry=False).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(documents(spark, folder))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bloom_lm": op1_bloom_lm,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_pii": op6_pii,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_main_text": op11_main_text,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}
