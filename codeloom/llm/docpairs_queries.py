"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import docpairs as D
from codeloom.tables import table


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (table(spark, d, "methods", "method_id", "qualified_name", "source_code"),
            table(spark, d, "conversions", "method_id", "qualified_name", "documentation"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return D.described(*_tables(spark, d))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.pairs(*_tables(spark, d))


def p4_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.file_pairs(table(spark, d, "files", "file_id", "file_path", "raw_source"))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_file_pairs": p4_file_pairs}


def oracle_sql() -> dict[str, str]:
    return {}
