"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import packing as P
from codeloom.llm.tokens import token_sizes
from codeloom.tables import table


def _placed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(table(spark, d, "documents", "doc_id", "text"))
    return P.placed(P.pieces(sizes, table(spark, d, "context_budgets")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return P.containers(_placed(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.fill_report(P.containers(_placed(spark, d)))


def queries() -> dict:
    return {"p7_containers": p7_containers, "p7_fill": p7_fill}


def oracle_sql() -> dict[str, str]:
    return {}
