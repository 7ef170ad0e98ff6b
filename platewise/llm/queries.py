"""Registry of the corpus queries: thin functions that read the tables and call the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import decontaminate, langid, licenses, media, neardup, packing, pii, quality, spelling, substrings, urlfilter, warc, whitening
from platewise.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), shingle=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_media_columns, op4_language_id, op5_best_fit_packing, op6_quality_classifier, op7_benchmark_decontamination, op8_minhash_near_dedup, op9_warc, op10_substring_dedup, op11_spelling_variants, op12_embedding_whitening, op13_pii)}
ORACLES: dict[str, str] = {"op7_benchmark_decontamination": decontaminate.ORACLE_SQL, "op8_minhash_near_dedup": neardup.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op10_substring_dedup": substrings.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL}
