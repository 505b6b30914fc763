"""The two end-to-end plans: analysing projects, and converting them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import context, convert, deadcode, graph, lines, resolve
from codeloom.tables import written


def analyze(files: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """One row per project: files, classes, methods, dead methods, noise and graph statistics.

    The tables are current ones, one row per id.
    """
    g_nodes, g_edges = resolve.nodes(classes, methods), resolve.edges(files, classes, methods)
    counted = files.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"))
    c = classes.groupBy("project").agg(F.count(F.lit(1)).alias("n_classes"))
    m = methods.groupBy("project").agg(F.count(F.lit(1)).alias("n_methods"))
    dead = deadcode.dead_methods(methods).groupBy("project").agg(F.count(F.lit(1)).alias("dead_methods"))
    noise = lines.noise_summary(files, "project", "file_id", "raw_source").select("project", "total_lines", "noise_lines", "noise_ratio")
    n = g_nodes.groupBy("project").agg(F.count(F.lit(1)).alias("graph_nodes"))
    e = g_edges.groupBy("project").agg(F.count(F.lit(1)).alias("graph_edges"))
    out = counted
    for part in (c, m, dead, n, e):
        out = out.join(part, "project", "left")
    return out.na.fill(0).join(noise, "project")


def conversion_requests(classes: DataFrame, methods: DataFrame, files: DataFrame, budget: int = context.BUDGET,
                        skip_dead: bool = True) -> DataFrame:
    """(project, class_name, qualified_name, prompt, included_deps, excluded_deps, compression_ratio) of live methods."""
    registry = resolve.method_registry(methods)
    facts = written(context.method_facts(registry), "facts")
    scored = context.scored_dependencies(written(resolve.edges(files, classes, methods), "edges"), facts)
    packed = context.pack(facts, scored, budget)
    live = deadcode.without_dead(registry, deadcode.dead_methods(methods)) if skip_dead else registry
    joined = live.select("project", "qualified_name", "class_name", "name").join(
        packed.withColumnRenamed("target", "qualified_name"), ["project", "qualified_name"]).join(
        facts.select("project", F.col("id").alias("qualified_name"), "code"), ["project", "qualified_name"])
    return joined.select("project", "class_name", "qualified_name", convert.modernize_prompt(
        F.col("code"), F.col("context_code"), F.col("class_name"), F.col("name"), F.col("excluded_deps")).alias("prompt"),
        "included_deps", "excluded_deps", "compression_ratio")


def modernize(classes: DataFrame, methods: DataFrame, files: DataFrame,
              converter: Callable[[str], str] = convert.stub_converter, budget: int = context.BUDGET) -> DataFrame:
    """Converted methods with their order: requests, one call each, parsed results."""
    requests = conversion_requests(classes, methods, files, budget)
    done = convert.convert(requests, converter)
    nodes = resolve.nodes(classes, methods).where("type = 'method'").select("project", F.col("id").alias("node"))
    calls = written(resolve.resolve_calls(methods, classes), "calls")
    order = graph.conversion_order(nodes, calls).select("project", F.col("node").alias("qualified_name"), F.col("rank").alias("ord"))
    return done.join(order, ["project", "qualified_name"], "left").select(
        "project", "class_name", "qualified_name", "ord", F.col("result.code").alias("python_code"),
        F.col("result.explanation").alias("explanation"), F.col("result.confidence").alias("confidence"),
        F.col("result.confidence_notes").alias("confidence_notes"), "included_deps", "excluded_deps", "compression_ratio")


def project_result(files: DataFrame, converted: DataFrame) -> DataFrame:
    """One row per project: files, conversions, output lines, mean confidence and mean compression; 0 where empty."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("files_parsed"))
    r = converted.groupBy("project").agg(
        F.count(F.lit(1)).alias("methods_converted"), F.sum(F.size(T.lines_of(F.col("python_code")))).alias("total_output_lines"),
        F.avg("confidence").alias("avg_confidence"), F.avg("compression_ratio").alias("avg_compression_ratio"))
    return f.join(r, "project", "left").na.fill(0)
