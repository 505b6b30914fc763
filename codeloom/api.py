"""Whole projects in folders of Java sources: analyse them, or convert them to Python modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import convert
from codeloom.plans import pipeline
from codeloom.sinks import modules
from codeloom.sources import java, scan
from codeloom.tables import written


def project_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files, classes and methods of the projects below ``root``; the first folder of a path is the project.

    Ids are hashes of path and position, so they stay the same from scan to scan.
    """
    found = scan.scan(spark, root).select(
        F.xxhash64("file_path").alias("file_id"), F.substring_index("file_path", "/", 1).alias("project"), "file_path", "raw_source")
    parsed = written(java.parsed_files(found, "file_id", "project", "file_path", "raw_source"), "parsed")
    files = parsed.select("file_id", "project", "file_path", "package", "imports", "raw_source", "parse_errors")
    classes = parsed.select("file_id", "project", "file_path", "package", F.posexplode("classes").alias("class_ord", "c")).select(
        F.xxhash64("file_path", "class_ord").alias("class_id"), "file_id", "project", "file_path", "class_ord", F.col("c.name").alias("name"),
        "package", F.col("c.extends").alias("extends"), F.col("c.implements").alias("implements"), F.col("c.fields").alias("fields"),
        F.col("c.is_interface").alias("is_interface"), F.col("c.methods").alias("_methods"))
    methods = classes.select("project", "file_path", "class_ord", F.col("name").alias("class_name"), F.posexplode("_methods").alias("_ord", "m")).select(
        F.xxhash64("file_path", "class_ord", "_ord").alias("method_id"), "project", "file_path", "class_name", "m.*").withColumn(
        "qualified_name", F.concat_ws(".", "class_name", "name"))
    return files, classes.drop("_methods"), methods


def analyze_projects(spark: SparkSession, root: str) -> DataFrame:
    """One row of statistics per project; see :func:`codeloom.plans.pipeline.analyze`."""
    return pipeline.analyze(*project_tables(spark, root))


def modernize_projects(spark: SparkSession, root: str, output: str, converter: Callable[[str], str] = convert.stub_converter,
                       settings: scan.Settings | None = None) -> DataFrame:
    """Convert all live methods, write one module per class below ``output`` and return one result row per project.

    ``settings`` default to those in the environment; their budget decides how much of its dependencies a request shows.
    """
    settings = settings or scan.Settings.from_env()
    files, classes, methods = project_tables(spark, root)
    done = written(pipeline.modernize(classes, methods, files, converter, settings.max_context_tokens), "converted")
    modules.write_modules(modules.module_texts(done), output).write.format("noop").mode("overwrite").save()
    return pipeline.project_result(files, done)
