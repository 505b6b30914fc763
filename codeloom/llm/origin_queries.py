"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import origin as O
from codeloom.tables import table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return O.judged(table(spark, d, "files", "file_id", "project", "file_path", "raw_source"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("kind is not null").select("file_id", "kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return O.report(_judged(spark, d))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report}


def oracle_sql() -> dict[str, str]:
    return {}
