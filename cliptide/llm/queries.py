"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliptide.llm import license_scan, near_dedup, warc
from cliptide.llm._common import table
from cliptide.llm.language_model import score_texts
from cliptide.llm.mixing import mix
from cliptide.llm.neighbours import nearest
from cliptide.llm.packing import pack
from cliptide.llm.quality import quality
from cliptide.llm.toxicity import toxicity
from cliptide.llm.url_filter import judge_urls


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_model": op2_language_model,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_url_filter": op8_url_filter,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": near_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op9_license_scan": license_scan.oracle(),
}
