"""The dependency graph of each project: classes and methods as nodes, resolved references as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

# Edge types in the order in which they overwrite one another, with their weights.
PHASES = ("contains", "imports", "inherits", "implements", "field_type", "calls")
LABELS = ("calls", "imports", "inherits", "implements", "field_type", "calls")
WEIGHTS = (1.0, 0.5, 1.0, 0.8, 0.3, 1.0)
_STRIPPED = r"^[<>(),;]+|[<>(),;]+$"


def class_registry(classes: DataFrame) -> DataFrame:
    """One class per project and name: the last one by file and position."""
    order = F.struct("file_path", "class_ord", "class_id")
    return classes.where("name is not null").groupBy("project", "name").agg(
        F.max_by(F.struct("class_id", "file_id", "file_path", "class_ord", "extends", "implements", "fields"), order).alias("c")
    ).select("project", F.col("name").alias("class_name"), "c.*")


def method_registry(methods: DataFrame) -> DataFrame:
    """One method per project and qualified name: the last one by file and line."""
    order = F.struct("file_path", "start_line", "method_id")
    keep = [c for c in methods.columns if c not in ("project", "qualified_name")]
    return methods.where("qualified_name is not null").groupBy("project", "qualified_name").agg(
        F.max_by(F.struct(*keep), order).alias("m")).select("project", "qualified_name", "m.*")


def nodes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(project, id, type, label)."""
    c = classes.where("name is not null").select("project", F.col("name").alias("id"), F.lit("class").alias("type")).distinct()
    m = methods.where("qualified_name is not null").select(
        "project", F.col("qualified_name").alias("id"), F.lit("method").alias("type")).distinct()
    return c.unionByName(m).withColumn("label", T.last_segment(F.col("id")))


def classes_named(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """(project, field, class_name): the classes whose name is a part of each field's text.

    A name made of word characters lies within one word of the field, so the parts of the distinct words, up to the longest
    class name of the project, are joined with the names by equality; other names are compared with whole fields.
    """
    names = classes.where("class_name <> ''").select("project", "class_name").distinct()
    plain = F.col("class_name").rlike(r"^[\w$]+$")
    longest = names.where(plain).groupBy("project").agg(F.max(F.length("class_name")).alias("_most"))
    words = fields.select("project", "field", F.explode(F.array_distinct(F.split("field", r"[^\w$]+"))).alias("_w")).where("_w <> ''")
    size = F.length("_w")
    # Every start, and every length from there.
    starts = words.select("project", "_w").distinct().join(longest, "project").select("project", "_w", "_most", F.explode(F.sequence(F.lit(1), size)).alias("_at"))
    parts = starts.select("project", "_w", F.explode(F.transform(
        F.sequence(F.lit(1), F.least("_most", size - F.col("_at") + 1)), lambda n: F.substring("_w", F.col("_at"), n))).alias("class_name")).distinct()
    within = parts.join(names.where(plain), ["project", "class_name"], "left_semi")
    odd = fields.join(names.where(~plain), "project").where(F.col("field").contains(F.col("class_name"))).select("project", "field", "class_name")
    return words.join(within, ["project", "_w"]).select("project", "field", "class_name").unionByName(odd).distinct()


def resolve_calls(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(project, source, target): the method each call means.

    A qualified call means, in this order: the named class's method; the method of the first class that a field of the
    caller's class names together with the qualifier; the method of that very name.  A plain call means a method of
    the same class, else of the first class that has one.  Other calls are dropped.
    """
    registry = class_registry(classes)
    known = methods.where("qualified_name is not null").select("project", "class_name", "name").distinct()
    owners = known.join(registry.select("project", "class_name", "file_path", "class_ord"), ["project", "class_name"])
    first = owners.groupBy("project", "name").agg(
        F.min_by("class_name", F.struct("file_path", "class_ord", "class_name")).alias("_first"))
    calls = methods.select("project", F.col("class_name").alias("parent"), "qualified_name", F.explode("calls").alias("call")).where(
        "call is not null and qualified_name is not null").distinct()
    parts = F.split("call", r"\.")
    calls = calls.withColumns({"s0": F.get(parts, 0), "s1": F.get(parts, 1)})
    plain, dotted = calls.where("s1 is null"), calls.where("s1 is not null")
    same = known.select("project", F.col("class_name").alias("parent"), F.col("name").alias("s0"), F.lit(True).alias("_same"))
    plain = plain.join(same, ["project", "parent", "s0"], "left").join(
        first.withColumnRenamed("name", "s0"), ["project", "s0"], "left")
    plain = plain.select("project", F.col("qualified_name").alias("source"), F.concat_ws(
        ".", F.when(F.col("_same"), F.col("parent")).otherwise(F.col("_first")), "s0").alias("target"),
        (F.col("_same").isNotNull() | F.col("_first").isNotNull()).alias("_ok"))
    direct = known.select("project", F.col("class_name").alias("s0"), F.col("name").alias("s1"), F.lit(True).alias("_direct"))
    dotted = dotted.join(direct, ["project", "s0", "s1"], "left")
    hit = dotted.where("_direct").select("project", F.col("qualified_name").alias("source"), F.concat_ws(".", "s0", "s1").alias("target"))
    # The substring rule: which classes a field names is found once per distinct field, then method names meet by equality.
    fields = registry.select("project", F.col("class_name").alias("parent"), F.explode("fields").alias("field")).where("field is not null").distinct()
    asked = dotted.where("_direct is null").select("project", "parent", "s0", "s1").distinct()
    told = asked.select("project", "parent", "s0").distinct().join(fields, ["project", "parent"]).where(F.col("field").contains(F.col("s0")))
    named = classes_named(told.select("project", "field").distinct(), registry.select("project", "class_name"))
    told = told.join(named, ["project", "field"]).select("project", "parent", "s0", "class_name").distinct()
    fitting = asked.join(told, ["project", "parent", "s0"]).join(owners.withColumnRenamed("name", "s1"), ["project", "class_name", "s1"])
    meant = fitting.groupBy("project", "parent", "s0", "s1").agg(
        F.min_by("class_name", F.struct("file_path", "class_ord", "class_name")).alias("_class"))
    through = dotted.where("_direct is null").join(meant, ["project", "parent", "s0", "s1"]).select(
        "project", F.col("qualified_name").alias("source"), F.concat_ws(".", "_class", "s1").alias("target"))
    return plain.where("_ok").select("project", "source", "target").unionByName(hit).unionByName(through).distinct()


def edges(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(project, source, target, dep_type, weight): one edge per pair; a later phase overwrites an earlier one."""
    names = class_registry(classes).select("project", F.col("class_name").alias("target")).distinct()
    here = classes.where("name is not null").select("project", "file_id", F.col("name").alias("source"), "extends", "implements", "fields")

    def known(df: DataFrame, phase: str) -> DataFrame:
        return df.join(names, ["project", "target"], "left_semi").select(
            "project", "source", "target", F.lit(PHASES.index(phase)).alias("phase"))

    contains = methods.where("qualified_name is not null and class_name is not null").select(
        "project", F.col("class_name").alias("source"), F.col("qualified_name").alias("target"), F.lit(0).alias("phase"))
    imported = files.select("file_id", F.explode("imports").alias("_i")).where("_i is not null").select(
        "file_id", T.last_segment(F.col("_i")).alias("target"))
    parts = [
        contains,
        known(here.join(imported, "file_id"), "imports"),
        known(here.withColumn("target", F.col("extends")).where("target is not null"), "inherits"),
        known(here.withColumn("target", F.explode("implements")), "implements"),
        known(here.withColumn("_f", F.explode("fields")).withColumn("target", F.explode(F.transform(
            F.split("_f", r"\s+"), lambda t: F.regexp_replace(t, _STRIPPED, "")))), "field_type"),
        resolve_calls(methods, classes).withColumn("phase", F.lit(5)),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    last = union.groupBy("project", "source", "target").agg(F.max("phase").alias("phase"))
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), F.col("phase") + 1)
    return last.select("project", "source", "target", pick(LABELS).alias("dep_type"), pick(WEIGHTS).alias("weight"))
