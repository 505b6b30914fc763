"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import spans as S
from codeloom.tables import table, written


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return S.shared_pairs(written(S.shared_spans(table(spark, d, "documents", "doc_id", "text")), "spans"))


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return S.shared_share(docs, S.shared_spans(docs))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each set of documents that hold one passage."""
    return S.shared_classes(written(S.shared_spans(table(spark, d, "documents", "doc_id", "text")), "spans"))[0]


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each such set."""
    return S.shared_classes(written(S.shared_spans(table(spark, d, "documents", "doc_id", "text")), "spans"))[1]


def queries() -> dict:
    return {"p9_found": p9_found, "p9_share": p9_share, "p9_classes": p9_classes, "p9_members": p9_members}


_WINDOWS = """
WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
     w AS (SELECT doc_id, i, substr(text, i, 200) AS s FROM t, LATERAL (SELECT unnest(generate_series(1, length(text) - 199)) AS i)),
     common AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": _WINDOWS + """, held AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN common USING (s)),
     sets AS (SELECT DISTINCT list(doc_id ORDER BY doc_id) AS docs FROM held GROUP BY s)
SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM (SELECT docs, unnest(docs) AS a FROM sets), LATERAL (SELECT unnest(docs) AS b) WHERE a < b""",
        "p9_share": _WINDOWS + """, hit AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN common USING (s)),
     step AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
     covered AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 200 ELSE least(200, i - p) END) AS n FROM step GROUP BY doc_id),
     docs AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, n_chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(n, 0) / n_chars ELSE 0.0 END AS shared_share
  FROM docs LEFT JOIN covered USING (doc_id)""",
    }
