"""The thin queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm import decontaminate, fill_middle, language, licenses, mixing, near_dup, quality_knn, quality_rules, repeats, secret_scan, spelling, toxicity, url_filter
from emberfold.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key").withColumn("first_slot", F.coalesce("first_slot", F.lit(-1).cast("long")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secret_scan.BASE.index(kind))).cast("long").alias(f"n_{kind}")
    digest = F.sha2(secret_scan.listed(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *map(count, secret_scan.BASE), digest.alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda x, name: F.sha2(x.cast("binary"), 256).alias(name)
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(back, "restored_sha256"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_repeats": op7_repeats,
    "op8_licenses": op8_licenses,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.oracle(),
    "op4_secrets": secret_scan.oracle(),
    "op6_near_duplicates": near_dup.oracle(),
    "op7_repeats": repeats.oracle(),
    "op8_licenses": licenses.oracle(),
    "op9_quality_rules": quality_rules.oracle(),
    "op10_decontamination": decontaminate.oracle(),
    "op11_spelling": spelling.oracle(),
    "op12_fill_in_middle": fill_middle.oracle(),
}
