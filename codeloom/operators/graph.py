"""Queries on directed graphs kept as edge tables (project, source, target): reachability, cycles and orders.

Iterative operators keep a shrinking or growing table in the shared folder; their state is never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.functions import text as T
from codeloom.tables import written, written_and_counted

MAX_DEPTH = 3


def direct_dependencies(edges: DataFrame) -> DataFrame:
    """(project, node, dependency); an edge to itself counts."""
    return edges.select("project", F.col("source").alias("node"), F.col("target").alias("dependency")).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """(project, node, dependent)."""
    return edges.select("project", F.col("target").alias("node"), F.col("source").alias("dependent")).distinct()


def reachable(edges: DataFrame, max_depth: int = MAX_DEPTH, sources: DataFrame | None = None) -> DataFrame:
    """(project, source, target, depth): nodes within ``max_depth`` steps of each node but itself, with their distance.

    With ``sources`` (project, source) the search starts from those nodes only.
    """
    step = edges.select("project", "source", "target").where("source is not null and target is not null").distinct()
    found = (step if sources is None else step.join(sources, ["project", "source"], "left_semi")).withColumn("depth", F.lit(1))
    frontier = found
    for depth in range(2, max_depth + 1):
        # Only what was not reached before goes on.
        frontier = frontier.where("source <> target").select("project", "source", F.col("target").alias("_via")).join(
            step.select("project", F.col("source").alias("_via"), "target"), ["project", "_via"]
        ).select("project", "source", "target").distinct().join(
            found.select("project", "source", "target"), ["project", "source", "target"], "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(frontier)
    return found.where("source <> target")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each chain of nodes of one way in and one way out as one edge, the chains' nodes, and rings of such nodes.

    Returns (project, source, target, steps), (project, node, head, tail, pos) and (project, node, component).  A chain is found
    by pointer doubling: in each round every node jumps twice as far back, so a chain of n nodes takes log n rounds.
    """
    step = written(edges.select("project", "source", "target").where("source is not null and target is not null").distinct(), "steps")
    one_out = step.groupBy("project", F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("_next")).where("_n = 1").drop("_n")
    one_in = step.groupBy("project", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("source").alias("_prev")).where("_n = 1").drop("_n")
    inner = one_out.join(one_in, ["project", "node"]).where("_next <> node")
    inner, size = written_and_counted(inner, "inner")
    # head: the node this one jumps back to; first: the earliest node of its chain so far; low: the least name on the way.
    jump = inner.select("project", "node", F.col("_prev").alias("head"), F.lit(1).cast("bigint").alias("pos"), F.col("node").alias("first"),
                        F.col("node").alias("low"), F.lit(True).alias("_open"))
    reach = 1
    while size:
        ahead = jump.select("project", F.col("node").alias("head"), F.col("head").alias("_head"), F.col("pos").alias("_pos"), F.col("first").alias("_first"),
                            F.col("low").alias("_low"), F.lit(True).alias("_hit"))
        jump, going = written_and_counted(jump.join(ahead, ["project", "head"], "left").select(
            "project", "node", F.coalesce("_head", "head").alias("head"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"),
            F.coalesce("_first", "first").alias("first"), F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_hit").isNotNull().alias("_open")),
            "jumps", F.col("_open"))
        reach *= 2
        if not going or reach > 2 * size:
            break
    rings = jump.where("_open").select("project", "node", F.col("low").alias("component"))
    chained = jump.where("not _open").select("project", "node", "head", "first", "pos")
    nexts = inner.select("project", "node", "_next").join(rings.select("project", "node"), ["project", "node"], "left_anti")
    ends = chained.join(nexts, ["project", "node"]).join(
        inner.select("project", F.col("node").alias("_next"), F.lit(True).alias("_inner")), ["project", "_next"], "left").where("_inner is null")
    ends = ends.select("project", "head", "first", F.col("_next").alias("tail"), (F.col("pos") + 1).alias("steps"))
    inside = inner.select("project", F.col("node"))
    plain = step.join(inside.withColumnRenamed("node", "source"), ["project", "source"], "left_anti").join(
        inside.withColumnRenamed("node", "target"), ["project", "target"], "left_anti").select("project", "source", "target", F.lit(1).cast("bigint").alias("steps"))
    reduced = plain.unionByName(ends.select("project", F.col("head").alias("source"), F.col("tail").alias("target"), "steps"))
    nodes = chained.join(ends.select("project", "first", "tail"), ["project", "first"]).select("project", "node", "head", "tail", "pos")
    return written(reduced, "reduced"), nodes, rings


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both incoming and outgoing edges."""
    sources = edges.select("project", F.col("source").alias("_n")).distinct()
    both = sources.join(edges.select("project", F.col("target").alias("_n")).distinct(), ["project", "_n"])
    return edges.join(both.withColumnRenamed("_n", "source"), ["project", "source"], "left_semi").join(
        both.withColumnRenamed("_n", "target"), ["project", "target"], "left_semi")


def _core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without incoming or outgoing edges are dropped again and again: all cycles lie in them.

    The state of this and the other loops is written once a round and counted on the way.
    """
    columns = edges.columns
    rest, size = written_and_counted(edges.distinct(), "core")
    while size:
        rest, left = written_and_counted(_trimmed(rest).select(*columns), "core")
        if left == size:
            break
        size = left
    return rest


def cyclic_projects(edges: DataFrame) -> DataFrame:
    """(project): projects whose graph has a cycle; an edge from a node to itself is one."""
    reduced, _, rings = contracted(edges)
    return _core(reduced.select("project", "source", "target")).select("project").unionByName(rings.select("project")).distinct()


def _least(value: DataFrame, step: DataFrame) -> DataFrame:
    """(project, node, value): the least value that reaches each node along ``step`` (project, source, target).

    Only nodes whose value changed send it on.
    """
    changed = value
    while True:
        sent = changed.select("project", F.col("node").alias("source"), "value").join(step, ["project", "source"]).select(
            "project", F.col("target").alias("node"), "value", F.lit(None).cast("string").alias("_first"))
        state, moved = written_and_counted(value.withColumn("_first", F.col("value")).unionByName(sent).groupBy("project", "node").agg(
            F.min("value").alias("value"), F.max("_first").alias("_first")), "least", F.col("value") != F.col("_first"))
        value, changed = state.select("project", "node", "value"), state.where("value <> _first")
        if not moved:
            return value


def components(edges: DataFrame) -> DataFrame:
    """(project, node, component): nodes on cycles by their strongly connected component, named by its least node.

    Nodes that lie on no cycle are left out.  Chains are contracted first: their nodes belong to the component of both
    their ends, if that is one.
    """
    reduced, chained, rings = contracted(edges)
    known = written(_reduced_components(reduced.select("project", "source", "target")), "reduced_components")
    inner = chained.join(known.select("project", F.col("node").alias("head"), "component"), ["project", "head"]).join(
        known.select("project", F.col("node").alias("tail"), F.col("component").alias("_c")), ["project", "tail"]).where("component = _c")
    members = written(known.unionByName(inner.select("project", "node", "component")), "members")
    named = members.groupBy("project", "component").agg(F.min("node").alias("_name"))
    return members.join(named, ["project", "component"]).select("project", "node", F.col("_name").alias("component")).unionByName(rings)


def _reduced_components(edges: DataFrame) -> DataFrame:
    """Components of a graph without long chains.

    In each round every node learns the least node that it is reached by and the least node that it reaches.  Where both
    are one node, that is its component; edges between nodes that differ in either lie in no component and are dropped.
    """
    rest = _core(edges)
    done = rest.select("project", F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    while not rest.isEmpty():
        ends = rest.select("project", F.col("source").alias("node")).union(rest.select("project", "target")).distinct()
        # Both directions in one table, told apart by a letter before the project.
        towards = lambda letter, df: df.withColumn("project", F.concat(F.lit(letter), "project"))
        back = rest.select("project", F.col("target").alias("source"), F.col("source").alias("target"))
        start = ends.withColumn("value", F.col("node"))
        value = _least(towards("f", start).unionByName(towards("b", start)), towards("f", rest.select("project", "source", "target")).unionByName(towards("b", back)))
        forth, back = (value.where(F.col("project").startswith(x)).withColumn("project", F.expr("substring(project, 2)")) for x in ("f", "b"))
        known = written(forth.withColumnRenamed("value", "_f").join(back.withColumnRenamed("value", "_b"), ["project", "node"]), "known")
        found = known.where("_f = _b").select("project", "node", F.col("_f").alias("component"))
        # A node alone is a component only if it has an edge to itself.
        inside = rest.join(found.withColumnRenamed("node", "source"), ["project", "source"]).join(
            found.select("project", F.col("node").alias("target"), F.col("component").alias("_c")), ["project", "target"]).where("component = _c")
        cyclic = inside.select("project", "component").distinct()
        done = done.unionByName(found.join(cyclic, ["project", "component"], "left_semi").select("project", "node", "component"))
        open_ = known.where("_f <> _b")
        left = rest.join(open_.select("project", F.col("node").alias("source"), F.col("_f").alias("_sf"), F.col("_b").alias("_sb")),
                         ["project", "source"]).join(
            open_.select("project", F.col("node").alias("target"), F.col("_f").alias("_tf"), F.col("_b").alias("_tb")), ["project", "target"])
        rest = _core(left.where("_sf = _tf and _sb = _tb").select("project", "source", "target"))
        done = written(done, "components")
    return done


def levels(nodes: DataFrame, edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """(project, node, component, level): the longest way from a node without callers, over components.

    ``nodes`` has (project, node).  A node on no cycle is its own component.  ``scc`` are the components if they are known.
    """
    scc = components(edges) if scc is None else scc
    named = nodes.join(scc, ["project", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("project", "node", "component"), "named")
    step = edges.join(named.select("project", F.col("node").alias("source"), F.col("component").alias("_a")), ["project", "source"]).join(
        named.select("project", F.col("node").alias("target"), F.col("component").alias("_b")), ["project", "target"])
    step = written(step.where("_a <> _b").select("project", F.col("_a").alias("source"), F.col("_b").alias("target")).distinct(), "dag")
    reduced, chained, _ = contracted(step)
    # The longest way over the contracted graph; only nodes whose level rose send it on, and one table is kept.
    ends = named.select("project", F.col("component").alias("node")).join(chained.select("project", "node"), ["project", "node"], "left_anti").distinct()
    level = written(ends.withColumns({"level": F.lit(0).cast("bigint"), "_rose": F.lit(True)}), "level")
    while True:
        sent = level.where("_rose").select("project", F.col("node").alias("source"), "level").join(reduced, ["project", "source"]).groupBy(
            "project", F.col("target").alias("node")).agg(F.max(F.col("level") + F.col("steps")).alias("_sent"))
        higher = F.coalesce(F.col("_sent") > F.col("level"), F.lit(False))
        level, rose = written_and_counted(level.drop("_rose").join(sent, ["project", "node"], "left").select(
            "project", "node", F.greatest("level", F.coalesce("_sent", "level")).alias("level"), higher.alias("_rose")), "level", F.col("_rose"))
        if not rose:
            break
    inner = chained.join(level.select("project", F.col("node").alias("head"), "level"), ["project", "head"]).select(
        "project", "node", (F.col("level") + F.col("pos")).alias("level"))
    best = level.select("project", "node", "level").unionByName(inner).withColumn("level", F.col("level").cast("int"))
    return named.join(best.withColumnRenamed("node", "component"), ["project", "component"]).select(
        "project", "node", "component", "level")


def conversion_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, node, component, level, cyclic, rank): the order in which a project's methods are converted.

    Without cycles callers come before what they call; with a cycle anywhere in the project, components come with what
    they call first, their members by name.  Ties go by name.
    """
    scc = written(components(edges), "scc")
    levelled = levels(nodes, edges, scc)
    cyclic = scc.select("project").distinct().withColumn("cyclic", F.lit(True))
    joined = levelled.join(cyclic, "project", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    joined = joined.withColumn("_level", F.when(F.col("cyclic"), -F.col("level")).otherwise(F.col("level")))
    # A rank within a level plus the sizes of the levels before it: no window spans a whole project's methods.
    sizes = joined.groupBy("project", "_level").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("project", "_level", (F.sum("_n").over(W.partitionBy("project").orderBy("_level")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("project", "_level").orderBy("component", "node"))
    return joined.withColumn("_within", within).join(before, ["project", "_level"]).select(
        "project", "node", "component", "level", "cyclic", (F.col("_before") + F.col("_within")).cast("bigint").alias("rank"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, nodes, edges, classes, methods, has_cycles)."""
    n = nodes.groupBy("project").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "class").alias("classes"),
        F.count_if(F.col("type") == "method").alias("methods"))
    e = edges.groupBy("project").agg(F.count(F.lit(1)).alias("edges"))
    c = cyclic_projects(edges).withColumn("has_cycles", F.lit(True))
    return n.join(e, "project", "left").join(c, "project", "left").select(
        "project", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "classes", "methods",
        F.coalesce("has_cycles", F.lit(False)).alias("has_cycles"))


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, kind, item): nodes {id, type, label} and edges {source, target, type} as JSON, one row each."""
    n = nodes.select("project", F.lit("node").alias("kind"), F.to_json(F.struct(
        "id", "type", T.last_segment(F.col("id")).alias("label"))).alias("item"))
    e = edges.select("project", F.lit("edge").alias("kind"), F.to_json(F.struct(
        "source", "target", F.col("dep_type").alias("type"))).alias("item"))
    return n.unionByName(e)
