"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import secrets as S
from codeloom.tables import table, written


def _owners(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("files", table(spark, d, "files", "file_id", "project", "raw_source"), "file_id", "raw_source"),
            ("methods", table(spark, d, "methods", "method_id", "project", "source_code"), "method_id", "source_code")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return S.secrets(_owners(spark, d)).select("owner", "owner_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    owners = _owners(spark, d)
    found = written(S.secrets(owners), "secrets")
    parts = [S.redacted(owner, df, key, text, found) for owner, df, key, text in owners]
    return parts[0].unionByName(parts[1])


def p5_decisions(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of each kind of place the segmentation explains, and how many remain."""
    return S.decisions(S.judged_candidates(_owners(spark, d)))


def queries() -> dict:
    return {"p5_found": p5_found, "p5_redacted": p5_redacted, "p5_decisions": p5_decisions}


def oracle_sql() -> dict[str, str]:
    return {}
