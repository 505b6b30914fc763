"""Reading the given tables and placing intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local runs where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as parquet and read it again.

    Used where one intermediate result feeds several jobs; it survives the loss of executors.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`written`, and the number of rows (that satisfy ``where``), counted while they are written."""
    seen = Observation()
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    out = written(df.observe(seen, counted.alias("n")), name)
    return out, seen.get["n"]


def checkpoint_dir_set(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(os.path.join(shared_folder(spark), "checkpoints"))
