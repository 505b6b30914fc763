"""The current state of the code tables: one row per id, without what was deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(df: DataFrame, key: str) -> DataFrame:
    """The earliest delivered row of each id; rows deleted later are left out, as are null ids.

    Repeated deliveries are equal but for their time, so the earliest one stands for all; of different rows of one time
    the least one by all columns does.
    """
    others = [c for c in df.columns if c not in (key, "scanned_at")]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("scanned_at", *others)).alias("_r"))
    rows = first.select(key, "_r.*")
    return rows.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else rows
