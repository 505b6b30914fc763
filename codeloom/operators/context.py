"""Context windows: each method's dependencies, ranked and packed under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import lines
from codeloom.operators.graph import reachable

BUDGET = 6000
OVERHEAD = 500
# What an edge of each type is worth, and what is left of it over several steps.
EDGE_WORTH = {"calls": 1.0, "inherits": 0.9, "implements": 0.8, "imports": 0.5, "field_type": 0.3, "param_type": 0.3,
              "return_type": 0.3}
OTHER_WORTH, STEPS_WORTH = 0.2, 0.5


def method_facts(registry: DataFrame) -> DataFrame:
    """(project, id, code, tokens, original_lines, cleaned_lines, signature, signature_tokens), once per method.

    ``registry`` has one row per project and qualified name.  Sources are cleaned of noise; methods without source are
    left out.
    """
    keyed = registry.where("source_code is not null and source_code <> ''").withColumn(
        "_key", F.concat_ws("\x1f", "project", "qualified_name"))
    cleaned = lines.clean_source(keyed, "_key", "source_code")
    signature = T.method_signature(F.col("modifiers"), F.col("return_type"), F.col("name"), F.col("parameters"))
    return keyed.join(cleaned, "_key").select(
        "project", F.col("qualified_name").alias("id"), F.col("cleaned_source").alias("code"),
        T.token_estimate(F.col("cleaned_source")).alias("tokens"), "original_lines", "cleaned_lines",
        signature.alias("signature"), T.token_estimate(signature).alias("signature_tokens"))


def scored_dependencies(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(project, target, dep_id, score, label): direct dependencies by edge type, those within three steps at a tenth.

    ``methods`` has (project, id) of the targets.
    """
    worth = F.coalesce(F.element_at(F.create_map(*[x for k, v in EDGE_WORTH.items() for x in (F.lit(k), F.lit(v))]), F.col("dep_type")),
                       F.lit(OTHER_WORTH))
    own = methods.select("project", F.col("id").alias("source")).distinct()
    mine = edges.join(own, ["project", "source"], "left_semi")
    direct = mine.select("project", F.col("source").alias("target"), F.col("target").alias("dep_id"), worth.alias("score"),
                         F.lit("direct").alias("label"))
    far = reachable(edges, sources=own).where("depth > 1").select(
        "project", F.col("source").alias("target"), F.col("target").alias("dep_id"),
        F.lit(OTHER_WORTH * STEPS_WORTH).alias("score"), F.lit("transitive").alias("label"))
    return direct.unionByName(far).groupBy("project", "target", "dep_id").agg(
        F.max(F.struct("score", "label")).alias("s")).select("project", "target", "dep_id", "s.score", "s.label")


def pack(facts: DataFrame, scored: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(project, target, context_code, included_deps, excluded_deps, original_total_lines, optimized_total_lines,
    estimated_tokens, compression_ratio) of every method.

    Dependencies are tried by score, ties by name: whole if they fit what is left of the budget, else as a signature,
    else not at all; smaller ones after them are still tried.  The fold sees sizes only; source text is joined for what
    was included, which the budget bounds.
    """
    sizes = facts.select("project", F.col("id").alias("dep_id"), F.col("tokens").alias("_t"), F.col("signature_tokens").alias("_s"),
                         F.col("original_lines").alias("_l"))
    deps = scored.join(sizes, ["project", "dep_id"]).groupBy("project", "target").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("dep_id").alias("id"), "label",
                                             F.col("_t").alias("t"), F.col("_s").alias("s")))).alias("_deps"),
        F.sum("_l").alias("_dep_lines"))
    targets = facts.select("project", F.col("id").alias("target"), F.col("tokens").alias("_target_tokens"),
                           F.col("original_lines").alias("_ol"), F.col("cleaned_lines").alias("_cl"))
    joined = targets.join(deps, ["project", "target"], "left")
    start = F.struct((F.lit(budget) - F.col("_target_tokens") - F.lit(OVERHEAD)).alias("left"),
                     F.array().cast("array<struct<id:string,label:string,how:string>>").alias("picked"))

    def step(acc, d):
        how = F.when(d.t <= acc.left, "full").when(d.s <= acc.left, "signature").otherwise("excluded")
        cost = F.when(d.t <= acc.left, d.t).when(d.s <= acc.left, d.s).otherwise(0)
        return F.struct((acc.left - cost).alias("left"), F.concat(acc.picked, F.array(F.struct(
            d.id.alias("id"), d.label.alias("label"), how.alias("how")))).alias("picked"))

    picked = joined.withColumn("_picked", F.coalesce(F.aggregate("_deps", start, step).picked, F.array().cast(
        "array<struct<id:string,label:string,how:string>>"))).drop("_deps")
    used = picked.select("project", "target", F.posexplode("_picked").alias("pos", "p")).where("p.how <> 'excluded'").select(
        "project", "target", "pos", F.col("p.id").alias("id"), F.col("p.label").alias("label"), F.col("p.how").alias("how"))
    texts = used.join(facts.select("project", "id", "code", "signature"), ["project", "id"]).withColumn("part", F.when(
        F.col("how") == "full", F.concat(F.lit("// --- Dependency: "), "id", F.lit(" ("), "label", F.lit(") ---\n"), "code")
    ).otherwise(F.concat(F.lit("// --- Dependency (signature only): "), "id", F.lit(" ---\n"), "signature")))
    code = texts.groupBy("project", "target").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x.part), "\n\n").alias("context_code"))
    out = picked.join(code, ["project", "target"], "left").withColumn("context_code", F.coalesce("context_code", F.lit("")))
    named = lambda p: F.when(p.how == "signature", F.concat(p.id, F.lit(" [sig-only]"))).otherwise(p.id)
    original = (F.col("_ol") + F.coalesce("_dep_lines", F.lit(0))).cast("int")
    optimized = F.size(T.lines_of(F.col("context_code"))) + F.col("_cl")
    return out.select(
        "project", "target", "context_code",
        F.transform(F.filter("_picked", lambda p: p.how != "excluded"), named).alias("included_deps"),
        F.transform(F.filter("_picked", lambda p: p.how == "excluded"), lambda p: p.id).alias("excluded_deps"),
        original.alias("original_total_lines"), optimized.alias("optimized_total_lines"),
        (T.token_estimate(F.col("context_code")) + F.col("_target_tokens")).alias("estimated_tokens"),
        T.safe_ratio(optimized, original).alias("compression_ratio"))
