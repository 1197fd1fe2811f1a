"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, jaccard, line_dedup, packing, quality_classifier, quality_rules, repair, topk, toxicity, warc
from .common import shared_dir, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    repair.write_ids(table(spark, sf_dir, "documents"), path)
    return repair.documents_of(repair.read_ids(spark, path))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("lang", "text")
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_repair": op3_repair,
    "op4_topk": op4_topk,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op4_topk": topk.SQL,
    "op5_warc": warc.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
