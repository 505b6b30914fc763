"""Converted code as modules, the conversion report, and their files."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


#: What stands for a name or a confidence that a conversion lacks.
NO_NAME, NO_CONFIDENCE = "(unnamed)", "unknown"


def module_texts(conversions: DataFrame) -> DataFrame:
    """(project, module, class_name, text): one Python module per class, functions in the order of ``ord``.

    ``conversions`` has (project, class_name, qualified_name, ord, confidence, confidence_notes, python_code).
    """
    header = F.concat(F.lit('"""\nConverted from the Java class '), "class_name", F.lit('.\n"""\n\n'))
    notes = F.coalesce("confidence_notes", F.lit(""))
    block = F.concat(
        F.lit("# --- "), F.coalesce("qualified_name", F.lit(NO_NAME)), F.lit(" ---\n# Confidence: "),
        F.when(F.col("confidence").isNull(), NO_CONFIDENCE).otherwise(T.percent(F.col("confidence"))), F.lit("\n"),
        F.when(notes != "", F.concat(F.lit("# Notes: "), F.regexp_replace(notes, r"\s*\n\s*", " "), F.lit("\n"))).otherwise(""),
        F.lit("\n"), F.coalesce("python_code", F.lit("")), F.lit("\n\n"))
    blocks = conversions.where("class_name is not null").select("project", "class_name", "ord", block.alias("block"))
    return blocks.groupBy("project", "class_name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x.block), "\n").alias("_body")).select(
        "project", F.concat(T.snake_case(F.col("class_name")), F.lit(".py")).alias("module"), "class_name",
        F.concat(header, "_body").alias("text"))


def report_entries(conversions: DataFrame) -> DataFrame:
    """(project, ord, qualified_name, band, entry): the report's paragraph on each conversion."""
    band = T.confidence_band(F.col("confidence"))
    notes = F.coalesce("confidence_notes", F.lit(""))
    entry = F.concat(
        F.lit("### ["), band, F.lit("] "), F.coalesce("qualified_name", F.lit(NO_NAME)), F.lit("\n- **Confidence**: "),
        F.when(F.col("confidence").isNull(), NO_CONFIDENCE).otherwise(T.percent(F.col("confidence"))),
        F.lit("\n- **Explanation**: "), F.coalesce("explanation", F.lit("")),
        F.when(notes != "", F.concat(F.lit("\n- **Notes**: "), notes)).otherwise(""), F.lit("\n"))
    return conversions.select("project", "ord", "qualified_name", band.alias("band"), entry.alias("entry"))


def report_summary(conversions: DataFrame) -> DataFrame:
    """(project, converted, mean_confidence, high, medium, low)."""
    band = T.confidence_band(F.col("confidence"))
    return conversions.groupBy("project").agg(
        F.count(F.lit(1)).alias("converted"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        *[F.count_if(band == b).alias(b.lower()) for b in ("HIGH", "MEDIUM", "LOW")])


def _file_system(folder: str):
    """File system and path of a folder: a plain path, or the address of a shared file system that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_modules(modules: DataFrame, folder: str) -> DataFrame:
    """Write each module to ``folder/project/module`` from the tasks and return (project, module, bytes).

    On a cluster ``folder`` is an address that all executors reach, such as hdfs:// or s3://.  Names are cut to plain file
    names.  A module that is written again replaces the earlier one.
    """
    if "://" not in folder and modules.sparkSession.sparkContext.master.split("[")[0] != "local":
        raise ValueError("give the address of a shared file system")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _file_system(folder)
        for pdf in batches:
            sizes = []
            for project, module, text in zip(pdf["project"], pdf["module"], pdf["text"]):
                target = f"{base.rstrip('/')}/{re.sub(r'[^\w.-]', '_', project or '_')}"
                files.create_dir(target, recursive=True)
                data = text.encode()
                name = f"{target}/{re.sub(r'[^\w.-]', '_', module)}"
                with files.open_output_stream(f"{name}.part") as f:
                    f.write(data)
                files.move(f"{name}.part", name)
                sizes.append(len(data))
            yield pd.DataFrame({"project": pdf["project"], "module": pdf["module"], "bytes": sizes})

    return modules.select("project", "module", "text").mapInPandas(run, "project string, module string, bytes bigint")


def write_archives(modules: DataFrame, folder: str) -> DataFrame:
    """Write ``folder/<project>.zip`` with each project's modules from the tasks and return (project, members, bytes).

    Modules reach their project's task sorted and go into the archive one by one; none is kept.
    """
    if "://" not in folder and modules.sparkSession.sparkContext.master.split("[")[0] != "local":
        raise ValueError("give the address of a shared file system")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        done, project, archive, out, name, members = [], None, None, None, "", 0

        def close() -> None:
            archive.close()
            size = out.tell()
            out.close()
            files.move(f"{name}.part", name)
            done.append((project, members, size))

        for pdf in batches:
            for p, module, text in zip(pdf["project"], pdf["module"], pdf["text"]):
                if archive is None or p != project:
                    if archive is not None:
                        close()
                    project, members = p, 0
                    name = f"{base.rstrip('/')}/{re.sub(r'[^\w.-]', '_', p or '_')}.zip"
                    out = files.open_output_stream(f"{name}.part")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(re.sub(r"[^\w.-]", "_", module), text)
                members += 1
        if archive is not None:
            close()
        yield pd.DataFrame(done, columns=["project", "members", "bytes"])

    rows = modules.select("project", "module", "text").repartition("project").sortWithinPartitions("project", "module")
    return rows.mapInPandas(run, "project string, members bigint, bytes bigint")
