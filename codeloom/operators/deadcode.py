"""Methods that no call mentions by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T


def called_names(methods: DataFrame) -> DataFrame:
    """(project, called): every call as written and its last segment, once per project."""
    calls = methods.select("project", F.explode("calls").alias("call")).where("call is not null").distinct()
    return calls.select("project", F.explode(F.array("call", T.last_segment(F.col("call")))).alias("called")).distinct()


def dead_methods(methods: DataFrame) -> DataFrame:
    """Methods that are not exempt and whose simple and qualified names no call of their project mentions.

    A call from a dead method or from the method itself counts, as names are compared and not reachability.
    """
    called = called_names(methods)
    rest = methods.where(~T.is_exempt(F.col("name"), F.col("modifiers")))
    rest = rest.join(called.withColumnRenamed("called", "name"), ["project", "name"], "left_anti")
    return rest.join(called.withColumnRenamed("called", "qualified_name"), ["project", "qualified_name"], "left_anti")


def without_dead(methods: DataFrame, dead: DataFrame) -> DataFrame:
    """Methods whose id, the qualified name, is not one of a dead method."""
    return methods.join(dead.select("project", "qualified_name").distinct(), ["project", "qualified_name"], "left_anti")
