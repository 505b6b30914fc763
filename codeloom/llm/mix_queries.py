"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import mixing as M
from codeloom.tables import table, written


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    targets = M.targets_of(table(spark, d, "mix_targets"))
    members = written(M.members(table(spark, d, "documents", "doc_id", "text", "source"), targets), "members")
    return M.mixture(members, targets), targets


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.shares(*_mixture(spark, d))


def queries() -> dict:
    return {"p8_mixture": p8_mixture, "p8_shares": p8_shares}


def oracle_sql() -> dict[str, str]:
    return {}
