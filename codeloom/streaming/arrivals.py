"""Files that keep arriving: the same operators on a stream, each delivery handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.sources import java


def file_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """A stream of file rows from parquet deliveries in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deliveries(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each file_id once within the watermark, whatever the number of its deliveries."""
    timed = stream.withColumn("scanned_at", F.col("scanned_at").cast("timestamp"))
    return timed.withWatermark("scanned_at", late).dropDuplicatesWithinWatermark(["file_id"])


def parsed_stream(stream: DataFrame) -> DataFrame:
    """(file_id, scanned_at, package, imports, classes, parse_errors) of arriving Java files."""
    return java.parsed_files(stream.where(F.col("file_path").endswith(".java")), "file_id", "scanned_at")


def daily_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """(day, project, files, lines): arriving files counted by event time in tumbling days."""
    once = deliveries(stream, late)
    return once.groupBy(F.window("scanned_at", "1 day"), "project").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size(T.lines_of(F.col("raw_source")))), F.lit(0)).alias("lines")
    ).select(F.col("window.start").alias("day"), "project", "files", "lines")
