"""Queries of the operators on training text, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, leakage, mojibake, pii, reading
from ravelin.llm.common import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "tickets"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(table(spark, sf_dir, "tickets"))


#: Key of the registered query; users pass their own secret.
DEMO_KEY = "ravelin-demo-key"


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "tickets"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "tickets"), DEMO_KEY)


def p4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_table(table(spark, sf_dir, "tickets"), DEMO_KEY)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies, and items asked again with other values."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where(F.col("kind") == leakage.COPY).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.demanding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_restored, p4_found, p4_redacted, p4_surrogates, p6_ids, p7_found, p7_leaks, p8_found, p8_levels)}
SQL: dict[str, str] = {}
