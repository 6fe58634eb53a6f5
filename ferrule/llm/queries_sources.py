"""Queries of problems 3, 5 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import credentials, provenance, quality
from ferrule.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.foreign_files(table(spark, folder, "chunks")).where("foreign").select("path").distinct()


def p3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.foreign_files(table(spark, folder, "chunks"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of chunks and of rank_items in one table: origin, item_key, text."""
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("origin"), F.col("chunk_id").cast("string").alias("item_key"), "text")
    return chunks.unionByName(table(spark, folder, "rank_items").select(F.lit("item").alias("origin"), F.col("id").alias("item_key"), "text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.find_credentials(_texts(spark, folder), ["origin", "item_key"])
    return found.where("kind <> 'continued'").select("origin", "item_key", "line_no").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.redact(_texts(spark, folder), ["origin", "item_key"])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    got = quality.text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))
    return got.where("is_prose").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))


QUERIES = {f.__name__: f for f in (p3_found, p3_evidence, p5_found, p5_redacted, p10_found, p10_statistics)}
ORACLE: dict[str, str] = {}
