"""Queries of problem 6 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import orphans as O
from codeloom.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_names(
        table(spark, d, "methods", "method_id", "project", "name", "qualified_name", "calls", "scanned_at", "deleted_at"),
        table(spark, d, "edges", "edge_id", "project", "target", "scanned_at"),
        table(spark, d, "classes", "class_id", "project", "name", "extends", "scanned_at", "deleted_at"),
        table(spark, d, "external_types", "name"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("scanned_at")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_name_report(_orphans(spark, d))


def p6_keys(spark: SparkSession, d: str) -> DataFrame:
    """Integer references between the tables, by contiguous runs of the parent ids."""
    parts = []
    for ref_table, key, parent in (("classes", "file_id", "files"), ("methods", "class_id", "classes"),
                                   ("conversions", "method_id", "methods")):
        found = O.orphan_keys(table(spark, d, ref_table, key), key, table(spark, d, parent, key), key)
        parts.append(found.select(F.lit(ref_table).alias("ref_table"), F.lit(parent).alias("parent_table"), "key",
                                  "ref_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: (table, its reference, its time, the parents' table) of integer references.
_TIMED = (("classes", "file_id", "scanned_at", "files"), ("methods", "class_id", "scanned_at", "classes"), ("conversions", "method_id", "converted_at", "methods"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Integer references per table: all of them, and those whose record is not there at the time of the reference."""
    parts = []
    for ref_table, key, at, parent in _TIMED:
        held = table(spark, d, parent, key, "scanned_at", *([] if parent == "files" else ["deleted_at"]))
        refs = table(spark, d, ref_table, key, at)
        found = O.orphan_ids(refs, key, at, held, key).agg(*[
            F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("ref_rows"))), F.lit(0)).alias(r) for r in ("missing", "late", "deleted")])
        judged = refs.where(F.col(key).isNotNull() & F.col(at).isNotNull()).agg(F.count(F.lit(1)).alias("ref_rows"), F.countDistinct(key).alias("ids"))
        parts.append(judged.join(found).select(F.lit(ref_table).alias("ref_table"), F.lit(parent).alias("parent_table"), "ids", "ref_rows", "missing", "late", "deleted"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ids_sql() -> str:
    parts = []
    for ref_table, key, at, parent in _TIMED:
        alive = f"p.scanned_at <= r.{at}" + ("" if parent == "files" else f" AND (p.deleted_at IS NULL OR p.deleted_at > r.{at})")
        reasons = ", ".join(f"CAST(coalesce(sum(n) FILTER (reason = '{r}'), 0) AS BIGINT) AS {r}" for r in ("missing", "late", "deleted"))
        parts.append(f"""
SELECT '{ref_table}' AS ref_table, '{parent}' AS parent_table, count(DISTINCT {key}) AS ids, CAST(sum(n) AS BIGINT) AS ref_rows, {reasons} FROM (
  SELECT r.{key}, r.{at}, r.n, CASE WHEN count(*) FILTER ({alive}) > 0 THEN 'held' WHEN count(p.{key}) = 0 THEN 'missing'
         WHEN count(*) FILTER (p.scanned_at > r.{at}) > 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM (SELECT {key}, {at}, count(*) AS n FROM {ref_table} WHERE {key} IS NOT NULL AND {at} IS NOT NULL GROUP BY ALL) r LEFT JOIN {parent} p ON p.{key} = r.{key}
  GROUP BY r.{key}, r.{at}, r.n)""")
    return " UNION ALL ".join(parts)


_ORPHANS = r"""
WITH m AS (SELECT DISTINCT ON (method_id) * FROM methods ORDER BY method_id, scanned_at),
     e AS (SELECT DISTINCT ON (edge_id) * FROM edges ORDER BY edge_id, scanned_at),
     c AS (SELECT DISTINCT ON (class_id) * FROM classes ORDER BY class_id, scanned_at),
     raw AS (
       SELECT 'methods' AS ref_table, method_id AS ref_id, project, scanned_at, unnest(calls) AS ref FROM m
       UNION ALL SELECT 'edges', edge_id, project, scanned_at, target FROM e
       UNION ALL SELECT 'classes', class_id, project, scanned_at, extends FROM c),
     cut AS (
       SELECT *, regexp_replace(ref, '^\s+|\s+$', '', 'g') AS t FROM raw WHERE ref IS NOT NULL),
     named AS (
       SELECT *, regexp_extract(t, '(?:^|\.)(\p{Lu}[^.]*(?:\.[^.]*)?)', 1) AS n FROM cut),
     refs AS (
       SELECT DISTINCT ref_table, ref_id, project, scanned_at,
              CASE WHEN n <> '' THEN n WHEN NOT contains(t, '.') AND t <> '' THEN t END AS target FROM named),
     judged AS (
       SELECT * FROM refs WHERE target IS NOT NULL
         AND split_part(target, '.', 1) NOT IN (SELECT name FROM external_types WHERE name IS NOT NULL)),
     parents AS (
       SELECT project, 'q' AS kind, qualified_name AS k, scanned_at AS s, deleted_at AS d FROM m
       UNION ALL SELECT project, 'm', name, scanned_at, deleted_at FROM m
       UNION ALL SELECT project, 'c', name, scanned_at, deleted_at FROM c),
     hit AS (
       SELECT r.ref_table, r.ref_id, r.target, r.scanned_at,
              count(p.k) AS n_rows,
              count(*) FILTER (p.s <= r.scanned_at AND (p.d IS NULL OR p.d > r.scanned_at)) AS n_alive,
              count(*) FILTER (p.s > r.scanned_at) AS n_late
       FROM judged r LEFT JOIN parents p ON p.project = r.project AND p.k = r.target
        AND p.kind = CASE WHEN contains(r.target, '.') THEN 'q' WHEN regexp_matches(r.target, '^\p{Lu}') THEN 'c' ELSE 'm' END
       GROUP BY ALL),
     orphans AS (
       SELECT ref_table, ref_id, target, scanned_at,
              CASE WHEN n_rows = 0 THEN 'missing' WHEN n_late > 0 THEN 'late' ELSE 'deleted' END AS reason
       FROM hit WHERE n_alive = 0)
"""


def queries() -> dict:
    return {"p6_found": p6_found, "p6_report": p6_report, "p6_keys": p6_keys, "p6_ids": p6_ids}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _ORPHANS + "SELECT ref_table, ref_id, target, reason FROM orphans",
        "p6_report": _ORPHANS + "SELECT ref_table, strftime(scanned_at, '%Y-%m') AS month, reason, count(*) AS orphans"
                                " FROM orphans GROUP BY ALL",
        "p6_ids": _ids_sql(),
        "p6_keys": """
SELECT 'classes' AS ref_table, 'files' AS parent_table, file_id AS key, count(*) AS ref_rows FROM classes
 WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM files WHERE file_id IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'methods', 'classes', class_id, count(*) FROM methods
 WHERE class_id IS NOT NULL AND class_id NOT IN (SELECT class_id FROM classes WHERE class_id IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'conversions', 'methods', method_id, count(*) FROM conversions
 WHERE method_id IS NOT NULL AND method_id NOT IN (SELECT method_id FROM methods WHERE method_id IS NOT NULL) GROUP BY ALL""",
    }
