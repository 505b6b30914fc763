"""Source trees, archives and project listings as file tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T


@dataclass(frozen=True)
class Settings:
    """Analysis settings; each can be set in the environment under its upper-case name."""

    max_context_tokens: int = 6000
    noise_comment_threshold: int = 3
    search_depth: int = 3
    max_completion_tokens: int = 4096
    temperature: float = 0.1

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Values that don't parse fall back to the defaults."""
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            kind = type(f.default)
            try:
                given[f.name] = kind(env[f.name.upper()])
            except (KeyError, ValueError):
                continue
        return cls(**given)


def scan(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """(file_path, raw_source) of all files below ``root`` with the suffix, one row each; bad bytes become U+FFFD.

    ``file_path`` is relative to ``root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    base = root.rstrip("/").removeprefix("file://")
    return files.select(
        F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{base}/+", "").alias("file_path"),
        F.col("content").cast("string").alias("raw_source"))


def scan_archives(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """(project, file_path, raw_source) of the members of all .zip files below ``root``.

    A single top folder is dropped from the paths.  Archives are opened in tasks, one at a time.  Members that lead out
    of the archive are left out, as are archives that can't be read.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith("/") and ".." not in n.split("/")]
                        tops = {n.split("/")[0] for n in names}
                        cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                        kept = [n for n in names if n.endswith(suffix)]
                        rows = [(os.path.basename(path)[:-4], n[cut:], z.read(n).decode("utf-8", "replace")) for n in kept]
                except (zipfile.BadZipFile, OSError):
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=["project", "file_path", "raw_source"])

    return archives.select("path", "content").mapInPandas(run, "project string, file_path string, raw_source string")


def project_listing(files: DataFrame, suffix: str = ".java") -> DataFrame:
    """(project, files, suffix_files, lines, failed) per project; failed are files with parse errors."""
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("file_path").endswith(suffix)).alias("suffix_files"),
        F.coalesce(F.sum(F.greatest(F.size(T.lines_of(F.col("raw_source"))), F.lit(0))), F.lit(0)).alias("lines"),
        F.count_if(F.size("parse_errors") > 0).alias("failed"))


def parse_status(files: DataFrame) -> DataFrame:
    """(project, ok, failed): files without and with parse errors; null counts as none."""
    bad = F.coalesce(F.size("parse_errors"), F.lit(0)) > 0
    return files.groupBy("project").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))
