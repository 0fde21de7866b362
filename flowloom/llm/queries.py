"""The registered queries of the operators: whole tables, production parameters, contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import alignment, decontaminate, divergence, language_id, license_scan, packing, pii, quality_rules, secrets, simhash, sql, token_counts, toxicity, url_filters
from flowloom.llm.common import ORACLES, QUERIES, query, read

__all__ = ["ORACLES", "QUERIES"]


@query("op1_quality_rules", sql.QUALITY)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_url_filters", sql.URLS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the label of the same number calls it toxic or of low quality."""
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality")).cast("int").alias("bad")
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad)
    return url_filters.url_filters(read(spark, sf_dir, "pages"), outcomes).drop("host_bad_rate")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op6_license_scan", sql.licenses(license_scan.PHRASES, license_scan.TEMPLATES, license_scan.TELLING, license_scan.PAIRS, license_scan.wanted_tells()))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_decontamination", sql.LEAKS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


@query("op11_source_divergence", sql.DIVERGENCE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


@query("op12_secret_scan", sql.secrets(secrets.STRONG, secrets.PARTS, secrets.HINT, secrets.MIXED_NEEDS, secrets.REACH, secrets.ASSIGN_CHARS))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
