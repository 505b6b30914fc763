"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import parsing as P
from codeloom.tables import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", "file_id", "project", "file_path", "raw_source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return P.invalid_files(_files(spark, d))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return P.rates(_files(spark, d), p3_found(spark, d))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_rates": p3_rates}


def oracle_sql() -> dict[str, str]:
    return {}
