"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, language_model, line_dedup, merkle, mixing, near_dedup, neighbours, quality, secret_scan, spelling, substring_dedup, warc
from tidemark.llm.common import is_held_out, table


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and weight of labelled documents: 2 for good ones, a half for others."""
    known = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    return known.agg(F.max(F.when(F.col("quality") == 1, 2.0).otherwise(0.5)).alias("weight"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~is_held_out(F.col("doc_id")))
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents; labelled quality scales the exponential keys."""
    return mixing.mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).drop("source")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~is_held_out(F.col("doc_id")))
    named = language_id.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_neighbours": op5_neighbours,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_secret_scan": op10_secret_scan,
    "op11_lm_scores": op11_lm_scores,
    "op12_manifest": op12_manifest,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.REPORT_SQL,
    "op3_substring_dedup": substring_dedup.REPORT_SQL,
    "op4_line_dedup": line_dedup.REPORT_SQL,
    "op6_mixing": mixing.MIX_SQL,
    "op8_near_dedup": near_dedup.GROUPS_SQL,
    "op9_warc": warc.ROUND_TRIP_SQL,
    "op12_manifest": merkle.REPORT_SQL,
    "op13_spelling": spelling.REPORT_SQL,
}
