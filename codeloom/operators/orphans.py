"""References to records that do not exist (as-of match against contiguous key runs).

Keys are integers that stand in blocks: plain ids in blocks of the key range, or the microseconds at which a record is
alive in the block of its name.  The sorted keys of a block are compressed into contiguous runs ``[run_start, run_end]``;
a reference is matched as-of to the run with the greatest start not after it, and is an orphan if it lies beyond that
run's end.  References are counted per key before the match, so a key that a third of all rows refer to is one row, and
runs and references of a block meet in one sorted window without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.tables import written

#: End of a record that was never deleted, in microseconds.
FOREVER = 9223372036854775807


def micros(at: Column) -> Column:
    """Microseconds of a time stamp by its own clock fields, with or without a zone: no session zone is involved."""
    seconds = F.unix_date(at.cast("date")) * F.lit(86_400) + F.hour(at) * F.lit(3_600) + F.minute(at) * F.lit(60)
    return seconds.cast("bigint") * F.lit(1_000_000) + (F.extract(F.lit("second"), at) * 1_000_000).cast("bigint")


def reference_target(ref: Column) -> Column:
    """Trimmed reference cut to its first dot-separated segment with a capital first letter, two segments at most.

    Without such a segment a single name is kept; a longer reference, a blank one and null give null.
    """
    trimmed = F.regexp_replace(ref, r"^\s+|\s+$", "")
    named = F.regexp_extract(trimmed, r"(?:^|\.)(\p{Lu}[^.]*(?:\.[^.]*)?)", 1)
    return (
        F.when(named != "", named)
        .when(~trimmed.contains(".") & (trimmed != ""), trimmed)
    )


def key_kind(target: Column) -> Column:
    """Which parent column a target has to match: ``qualified``, ``class`` or ``method``."""
    return (
        F.when(target.contains("."), F.lit("qualified"))
        .when(target.rlike(r"^\p{Lu}"), F.lit("class"))
        .otherwise(F.lit("method"))
    )


def earliest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The earliest row of each ``key`` by ``scanned_at``; rows without key or time are left out.

    Ties take the smallest remaining values.  Columns clashing with the names used here can't occur, as all other
    columns are projected away first.
    """
    rows = df.select(key, "scanned_at", *columns).where(F.col(key).isNotNull() & F.col("scanned_at").isNotNull())
    first = rows.groupBy(key).agg(F.min(F.struct("scanned_at", *columns)).alias("_first"))
    return first.select(key, "_first.*")


def _alive(df: DataFrame, kind: str, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull() & F.col("project").isNotNull()).select(
        "project",
        F.lit(kind).alias("kind"),
        F.col(name).alias("target"),
        micros(F.col("scanned_at")).alias("from_us"),
        F.coalesce(micros(F.col("deleted_at")) - 1, F.lit(FOREVER)).alias("to_us"),
    )


def key_runs(parents: DataFrame, block: list[str], low: str, high: str) -> DataFrame:
    """(block..., run_start, run_end, last_start): the integers ``low..high`` of each block as sorted disjoint runs.

    Stretches that overlap or touch become one run.  ``last_start`` is the greatest ``low`` in a run; a stretch that ends
    before it starts covers nothing but still has its start.  Null blocks and bounds are ignored.
    """
    known = parents.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    for c in block:
        known = known.where(F.col(c).isNotNull())
    stretches = known.groupBy(*block, F.col(low).alias("_lo")).agg(F.max(high).alias("_hi"))
    order = W.partitionBy(*block).orderBy("_lo")
    before = F.max("_hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = (before.isNull() | (F.col("_lo") - 1 > before)).cast("int")
    island = F.sum("_cut").over(order.rowsBetween(W.unboundedPreceding, 0))
    return stretches.withColumn("_cut", cut).withColumn("_island", island).groupBy(*block, "_island").agg(
        F.min("_lo").alias("run_start"), F.max("_hi").alias("run_end"), F.max("_lo").alias("last_start")).drop("_island")


def beyond_runs(refs: DataFrame, runs: DataFrame, block: list[str], at: str) -> DataFrame:
    """(block..., at, ref_rows, last_start): distinct references that lie in no run, with the number of rows that make them.

    ``last_start`` is the greatest start in the block, null in a block without runs.  Null blocks and references are no
    orphans; without runs every reference is one.
    """
    known = refs.where(F.col(at).isNotNull())
    for c in block:
        known = known.where(F.col(c).isNotNull())
    counted = known.groupBy(*block, F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("ref_rows"))
    none = F.lit(None).cast("bigint")
    stream = counted.select(*block, "_at", "ref_rows", none.alias("run_end"), none.alias("last_start"), F.lit(1).alias("_side"))
    stream = stream.unionByName(runs.select(*block, F.col("run_start").alias("_at"), none.alias("ref_rows"), "run_end", "last_start", F.lit(0).alias("_side")))
    preceding = W.partitionBy(*block).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    matched = stream.withColumns({"_covered": F.last("run_end", ignorenulls=True).over(preceding),
                                  "_last": F.max("last_start").over(W.partitionBy(*block))})
    return matched.where((F.col("_side") == 1) & (F.col("_covered").isNull() | (F.col("_at") > F.col("_covered")))).select(
        *block, F.col("_at").alias(at), "ref_rows", F.col("_last").alias("last_start"))


def reason(at: Column, last_start: Column) -> Column:
    """``missing`` where nothing of that name or id was ever there, ``late`` where it comes later, else ``deleted``."""
    return F.when(last_start.isNull(), "missing").when(last_start > at, "late").otherwise("deleted")


def name_references(methods: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(ref_table, ref_id, project, target, kind, at_us, scanned_at): one row per id and distinct target."""
    m = earliest(methods, "method_id", "project", "calls").select(
        F.lit("methods").alias("ref_table"), F.col("method_id").alias("ref_id"), "project", "scanned_at",
        F.explode(F.array_distinct(F.transform("calls", reference_target))).alias("target"))
    e = earliest(edges, "edge_id", "project", "target").select(
        F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_id"), "project", "scanned_at",
        reference_target(F.col("target")).alias("target"))
    c = earliest(classes, "class_id", "project", "extends").select(
        F.lit("classes").alias("ref_table"), F.col("class_id").alias("ref_id"), "project", "scanned_at",
        reference_target(F.col("extends")).alias("target"))
    refs = m.unionByName(e).unionByName(c).where(F.col("target").isNotNull())
    return refs.select(
        "ref_table", "ref_id", "project", "target", key_kind(F.col("target")).alias("kind"),
        micros(F.col("scanned_at")).alias("at_us"), "scanned_at")


def orphan_names(methods: DataFrame, edges: DataFrame, classes: DataFrame, external_types: DataFrame) -> DataFrame:
    """References by name to methods or classes their project doesn't hold at that time.

    Returns (ref_table, ref_id, target, reason, scanned_at); reason is ``missing``, ``late`` or ``deleted``.
    Null or blank references, null projects and null times give no row; repeated rows and repeated targets of an id
    count once; an empty parent table makes every judged reference ``missing``.  A name is a block, its keys are the
    microseconds at which one of its records is alive.  Only the orphans among the distinct (name, time) pairs are
    joined back to the references.
    """
    em = earliest(methods, "method_id", "project", "name", "qualified_name", "deleted_at")
    ec = earliest(classes, "class_id", "project", "name", "deleted_at")
    parents = (
        _alive(em, "qualified", "qualified_name")
        .unionByName(_alive(em, "method", "name"))
        .unionByName(_alive(ec, "class", "name"))
    )
    external = external_types.select(F.col("name").alias("_external")).distinct()
    refs = name_references(methods, edges, classes).where(F.col("project").isNotNull())
    refs = written(refs.join(external, F.substring_index("target", ".", 1) == F.col("_external"), "left_anti"), "references")
    block = ["project", "kind", "target"]
    orphans = written(beyond_runs(refs, key_runs(parents, block, "from_us", "to_us"), block, "at_us"), "orphans")
    judged = orphans.select(*block, "at_us", reason(F.col("at_us"), F.col("last_start")).alias("reason"))
    return refs.join(judged, [*block, "at_us"]).select("ref_table", "ref_id", "target", "reason", "scanned_at")


def orphan_name_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month of ``scanned_at`` and reason."""
    return orphans.groupBy(
        "ref_table", F.date_format("scanned_at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count(F.lit(1)).alias("orphans"))


def orphan_keys(refs: DataFrame, key: str, parents: DataFrame, parent_key: str, block: int = 1 << 20) -> DataFrame:
    """(key, ref_rows): distinct values of ``refs[key]`` that no parent has, with the number of rows that carry them.

    Blocks are stretches of ``block`` keys, so that no window spans more distinct keys, whatever the tables' sizes.  Null
    references are no orphans; an empty parent table makes every key one.
    """
    def blocked(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col(c).cast("bigint").alias("key")).withColumn("block", F.floor(F.col("key") / F.lit(block)).cast("bigint"))

    runs = key_runs(blocked(parents, parent_key), ["block"], "key", "key")
    return beyond_runs(blocked(refs, key), runs, ["block"], "key").select("key", "ref_rows")


def orphan_ids(refs: DataFrame, key: str, at: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(key, at, reason, ref_rows): references by id to a record that is not there at the time ``refs[at]``.

    Every delivered row counts.  An id is a block, its keys are the microseconds at which one of its records is alive.
    ``parents`` without ``deleted_at`` keep their records.
    """
    gone = F.col("deleted_at") if "deleted_at" in parents.columns else F.lit(None).cast("timestamp_ntz")
    alive = parents.select(F.col(parent_key).cast("bigint").alias("key"), micros(F.col("scanned_at")).alias("from_us"), gone.alias("gone")).select(
        "key", "from_us", F.coalesce(micros(F.col("gone")) - 1, F.lit(FOREVER)).alias("to_us"))
    asked = refs.select(F.col(key).cast("bigint").alias("key"), micros(F.col(at)).alias("at_us"))
    found = beyond_runs(asked, key_runs(alive, ["key"], "from_us", "to_us"), ["key"], "at_us")
    return found.select("key", F.col("at_us").alias("at"),
                        reason(F.col("at_us"), F.col("last_start")).alias("reason"), "ref_rows")
