"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import defects as D
from codeloom.tables import table


def p1_scored(spark: SparkSession, d: str) -> DataFrame:
    conversions = table(spark, d, "conversions", "conversion_id", "method_id", "python_code", "explanation",
                        "confidence_notes")
    return D.scored(conversions, table(spark, d, "methods", "method_id", "source_code")).groupBy(
        "conversion_id", "defect").agg(F.max("posterior").alias("posterior"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return D.found(p1_scored(spark, d))


def p1_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each sign's model on pairs damaged on purpose."""
    conversions = table(spark, d, "conversions", "conversion_id", "method_id", "python_code", "explanation", "confidence_notes")
    return D.validation(conversions, table(spark, d, "methods", "method_id", "source_code"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_scored": p1_scored, "p1_validation": p1_validation}


def oracle_sql() -> dict[str, str]:
    return {}
