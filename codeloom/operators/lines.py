"""Noise in source text: runs of comment lines, cleaned source and noise statistics.

Runs are found by gaps and islands over per-line flags; only flags are shuffled, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.functions import text as T

THRESHOLD = 3
CODE_THRESHOLD = 2
_REGIONS = "array<struct<start_line:int,end_line:int,noise_type:string,reason:string>>"


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ln, line): lines counted from 1; null texts have none."""
    return df.select(key, F.posexplode(T.lines_of(F.col(text))).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("ln"), "line")


def _runs(flags: DataFrame, key: str, flag: str, least: int) -> DataFrame:
    marked = flags.where(flag)
    island = F.col("ln") - F.row_number().over(W.partitionBy(key).orderBy("ln"))
    return marked.withColumn("_island", island).groupBy(key, "_island").agg(
        F.min("ln").alias("start_line"), F.max("ln").alias("end_line"), F.max("tagged").alias("tagged"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def noise_regions(df: DataFrame, key: str, text: str, threshold: int = THRESHOLD, commented_code: bool = False) -> DataFrame:
    """(key, noise_type, start_line, end_line, n_lines, reason): maximal runs of comment lines.

    A run with a tag anywhere is a ``todo_block``, else ``excessive_comments``.  Runs of commented-out code are part of
    comment runs and are reported as regions of their own only where ``commented_code`` is set.  Keys must be unique.
    """
    flags = line_table(df, key, text).select(
        key, "ln", T.is_comment_line(F.col("line")).alias("comment"), T.is_commented_code(F.col("line")).alias("code"),
        T.has_tag(F.col("line")).alias("tagged"))
    runs = _runs(flags, key, "comment", threshold).select(
        key, F.when(F.col("tagged"), "todo_block").otherwise("excessive_comments").alias("noise_type"),
        "start_line", "end_line", F.col("n").cast("int").alias("n_lines"),
        F.when(F.col("tagged"), F.format_string("TODO/FIXME block (%d lines) — irrelevant to LLM", "n"))
        .otherwise(F.format_string("Excessive comment block (%d lines)", "n")).alias("reason"))
    if commented_code:
        runs = runs.unionByName(_runs(flags, key, "code", CODE_THRESHOLD).select(
            key, F.lit("commented_out_code").alias("noise_type"), "start_line", "end_line", F.col("n").cast("int").alias("n_lines"),
            F.format_string("Commented-out code (%d lines)", "n").alias("reason")))
    return runs


def cleaned_text(lines: Column, regions: Column) -> Column:
    """Lines outside all regions with successive blank lines made one; without regions the text stays as it is."""
    kept = F.filter(lines, lambda _, i: ~F.exists(regions, lambda r: (i + 1 >= r.start_line) & (i + 1 <= r.end_line)))
    return F.when(F.size(regions) == 0, lines).otherwise(kept)


def clean_source(df: DataFrame, key: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """(key, cleaned_source, original_lines, cleaned_lines, noise_ratio) of every row with a text."""
    regions = noise_regions(df, key, text, threshold).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start_line", "end_line", "noise_type", "reason"))).alias("_regions"))
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), T.lines_of(F.col(text)).alias("_lines"))
    joined = rows.join(regions, key, "left").withColumn("_regions", F.coalesce("_regions", F.array().cast(_REGIONS)))
    kept = joined.withColumn("_kept", cleaned_text(F.col("_lines"), F.col("_regions")))
    blank = lambda x: T.strip(x) == ""
    collapsed = F.filter("_kept", lambda x, i: ~(blank(x) & (i > 0) & blank(F.get("_kept", i - 1))))
    out = kept.withColumn("_out", F.when(F.size("_regions") > 0, collapsed).otherwise(F.col("_kept")))
    return out.select(
        key, F.when(F.size("_regions") > 0, F.array_join("_out", "\n")).otherwise(F.col("_text")).alias("cleaned_source"),
        F.size("_lines").alias("original_lines"), F.size("_out").alias("cleaned_lines"),
        T.safe_ratio(F.size("_out"), F.size("_lines")).alias("noise_ratio"))


def noise_summary(df: DataFrame, group: str, key: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """(group, total_lines, noise_lines, noise_ratio, excessive_comments, todo_block) lines per group."""
    sizes = df.select(group, key, F.coalesce(F.size(T.lines_of(F.col(text))), F.lit(0)).alias("_n"))
    regions = noise_regions(df, key, text, threshold).groupBy(key).agg(
        F.sum("n_lines").alias("_noise"),
        F.sum(F.when(F.col("noise_type") == "excessive_comments", F.col("n_lines")).otherwise(0)).alias("_c"),
        F.sum(F.when(F.col("noise_type") == "todo_block", F.col("n_lines")).otherwise(0)).alias("_t"))
    total, noise = F.sum(F.greatest("_n", F.lit(0))), F.coalesce(F.sum("_noise"), F.lit(0))
    return sizes.join(regions, key, "left").groupBy(group).agg(
        total.alias("total_lines"), noise.alias("noise_lines"),
        F.when(total > 0, noise / total).otherwise(0.0).alias("noise_ratio"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("excessive_comments"), F.coalesce(F.sum("_t"), F.lit(0)).alias("todo_block"))
