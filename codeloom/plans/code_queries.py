"""Queries of the code-analysis operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import context, convert, deadcode, graph, lines, resolve
from codeloom.operators.current import current
from codeloom.plans import pipeline
from codeloom.sinks import modules
from codeloom.sources import java, scan
from codeloom.tables import table, written


def _files(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current(table(s, d, "files", "file_id", *columns, "scanned_at"), "file_id")


def _classes(s: SparkSession, d: str) -> DataFrame:
    return current(table(s, d, "classes", "class_id", "file_id", "project", "file_path", "class_ord", "name", "package", "extends",
                         "implements", "fields", "is_interface", "scanned_at", "deleted_at"), "class_id")


def _methods(s: SparkSession, d: str, *columns: str) -> DataFrame:
    columns = columns or ("project", "file_path", "class_name", "name", "qualified_name", "start_line", "source_code", "return_type",
                          "parameters", "modifiers", "calls")
    return current(table(s, d, "methods", "method_id", *columns, "scanned_at", "deleted_at"), "method_id")


def _links(s: SparkSession, d: str) -> DataFrame:
    return _methods(s, d, "project", "file_path", "class_name", "name", "qualified_name", "start_line", "modifiers", "calls")


def _conversions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversions").where("conversion_id is not null")
    return rows.groupBy("conversion_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "conversion_id"]), "converted_at").alias(
        "_r")).select("conversion_id", "_r.*")


def _edge_table(s: SparkSession, d: str) -> DataFrame:
    """The given edges: once per id, with trimmed targets."""
    rows = current(table(s, d, "edges", "edge_id", "project", "source", "target", "dep_type", "weight", "scanned_at"), "edge_id")
    return rows.where("source is not null and target is not null").select(
        "project", "source", T.strip(F.col("target")).alias("target"), "dep_type", "weight")


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    files, classes, methods = _files(s, d, "project", "imports"), _classes(s, d), _links(s, d)
    return files, classes, methods, resolve.nodes(classes, methods), resolve.edges(files, classes, methods)


def noise_regions(s, d):
    return lines.noise_regions(_files(s, d, "raw_source"), "file_id", "raw_source")


def commented_code_regions(s, d):
    return lines.noise_regions(_files(s, d, "raw_source"), "file_id", "raw_source", commented_code=True).where(
        "noise_type = 'commented_out_code'")


def noise_summary(s, d):
    return lines.noise_summary(_files(s, d, "project", "raw_source"), "project", "file_id", "raw_source")


def clean_source(s, d):
    out = lines.clean_source(_files(s, d, "raw_source"), "file_id", "raw_source")
    return out.select("file_id", F.md5("cleaned_source").alias("cleaned_md5"), "original_lines", "cleaned_lines", "noise_ratio")


def line_predicates(s, d):
    rows = lines.line_table(_files(s, d, "project", "raw_source").where("project is not null"), "project", "raw_source")
    line = F.col("line")
    return rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_comment_line(line)).alias("comment_lines"),
        F.count_if(T.is_commented_code(line)).alias("commented_code_lines"), F.count_if(T.is_code_line(line)).alias("code_lines"),
        F.count_if(T.has_tag(line)).alias("tagged_lines"))


def token_estimates(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def project_listing(s, d):
    return scan.project_listing(_files(s, d, "project", "file_path", "raw_source", "parse_errors"))


def parse_status(s, d):
    return scan.parse_status(_files(s, d, "project", "parse_errors"))


def class_counts(s, d):
    c = _classes(s, d).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_classes"), F.count_if("is_interface").alias("n_interfaces"))
    return _files(s, d, "project").select("file_id", "project").join(c, "file_id", "left").na.fill(0, ["n_classes", "n_interfaces"])


def called_names(s, d):
    return deadcode.called_names(_methods(s, d, "project", "calls"))


def dead_methods(s, d):
    return deadcode.dead_methods(_methods(s, d, "project", "name", "qualified_name", "modifiers", "calls")).select(
        "project", "method_id", "qualified_name")


def live_methods(s, d):
    m = _methods(s, d, "project", "name", "qualified_name", "modifiers", "calls")
    return deadcode.without_dead(m, deadcode.dead_methods(m)).select("project", "method_id", "qualified_name")


def entry_points(s, d):
    m = _methods(s, d, "project", "qualified_name", "name", "modifiers")
    return m.where(T.is_entry_point(F.col("name"), F.col("modifiers"))).select("project", "method_id", "qualified_name")


def method_signatures(s, d):
    m = resolve.method_registry(_methods(s, d))
    return m.select("project", "qualified_name", T.method_signature(F.col("modifiers"), F.col("return_type"), F.col("name"),
                                                                     F.col("parameters")).alias("signature"))


def class_signatures(s, d):
    r = resolve.class_registry(_classes(s, d))
    none = F.array().cast("array<string>")
    return r.select("project", "class_name", T.class_signature(
        F.col("class_name"), F.col("extends"), F.coalesce("implements", none), F.coalesce("fields", none), none).alias("signature"))


def graph_nodes(s, d):
    return resolve.nodes(_classes(s, d), _links(s, d))


def resolved_calls(s, d):
    return resolve.resolve_calls(_links(s, d), _classes(s, d))


def graph_edges(s, d):
    return _graph(s, d)[4]


def graph_stats(s, d):
    *_, n, e = _graph(s, d)
    return graph.stats(n, written(e, "edges"))


def graph_export(s, d):
    *_, n, e = _graph(s, d)
    return graph.export(n, e)


def edge_dependents(s, d):
    return graph.dependents(_edge_table(s, d))


def edge_dependencies(s, d):
    return graph.direct_dependencies(_edge_table(s, d))


def edge_reachable(s, d):
    return graph.reachable(_edge_table(s, d))


def edge_worth(s, d):
    worth = F.create_map(*[x for k, v in context.EDGE_WORTH.items() for x in (F.lit(k), F.lit(v))])
    e = _edge_table(s, d).withColumn("worth", F.coalesce(F.element_at(worth, F.col("dep_type")), F.lit(context.OTHER_WORTH)))
    return e.groupBy("project", "dep_type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum("worth").alias("worth"))


def cyclic_projects(s, d):
    return graph.cyclic_projects(resolve.resolve_calls(_links(s, d), _classes(s, d)))


def call_components(s, d):
    return graph.components(resolve.resolve_calls(_links(s, d), _classes(s, d)))


def conversion_order(s, d):
    m, c = _links(s, d), _classes(s, d)
    nodes = resolve.nodes(c, m).where("type = 'method'").select("project", F.col("id").alias("node"))
    return graph.conversion_order(nodes, written(resolve.resolve_calls(m, c), "calls"))


def _packed(s, d, budget):
    files, classes, methods = _files(s, d, "project", "imports"), _classes(s, d), _methods(s, d)
    facts = written(context.method_facts(resolve.method_registry(methods)), "facts")
    scored = context.scored_dependencies(written(resolve.edges(files, classes, methods), "edges"), facts)
    return context.pack(facts, scored, budget)


def _sizes(df):
    return df.select("project", "target", F.md5("context_code").alias("context_md5"), "included_deps", "excluded_deps",
                     "original_total_lines", "optimized_total_lines", "estimated_tokens", "compression_ratio")


def context_windows(s, d):
    return _sizes(_packed(s, d, context.BUDGET))


def context_windows_tight(s, d):
    return _sizes(_packed(s, d, 700))


def scored_dependencies(s, d):
    *_, m, n, e = _graph(s, d)
    return context.scored_dependencies(written(e, "edges"), n.where("type = 'method'"))


def prompts(s, d):
    return pipeline.conversion_requests(_classes(s, d), _methods(s, d), _files(s, d, "project", "imports")).select(
        "project", "qualified_name", F.md5("prompt").alias("prompt_md5"), "included_deps", "excluded_deps")


def converted(s, d):
    return pipeline.modernize(_classes(s, d), _methods(s, d), _files(s, d, "project", "imports"))


def parsed_responses(s, d):
    """Responses in the agreed form, made of the conversions' own fields, and parsed again."""
    raw = F.concat(
        F.lit(convert.CODE[0] + "\n"), F.coalesce("python_code", F.lit("")), F.lit("\n" + convert.CODE[1] + "\n" + convert.EXPLANATION[0] + "\n"),
        F.coalesce("explanation", F.lit("")), F.lit("\n" + convert.EXPLANATION[1] + "\n" + convert.CONFIDENCE + "\n"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.lit("\n" + convert.NOTES + "\n"), F.coalesce("confidence_notes", F.lit("")))
    return _conversions(s, d).select("conversion_id", convert.parse_response(raw).alias("r")).select(
        "conversion_id", F.md5("r.code").alias("code_md5"), "r.explanation", "r.confidence", "r.confidence_notes")


def _outcomes(s, d):
    rows = _conversions(s, d)
    return rows.select("project", F.substring_index("qualified_name", ".", 1).alias("class_name"), "qualified_name",
                       F.col("conversion_id").alias("ord"), "confidence", "explanation", "confidence_notes", "python_code")


def module_texts(s, d):
    return modules.module_texts(_outcomes(s, d).where("confidence is not null")).select("project", "module", F.md5("text").alias("text_md5"))


def report_summary(s, d):
    return modules.report_summary(_outcomes(s, d))


def report_entries(s, d):
    return modules.report_entries(_outcomes(s, d).where("confidence is not null")).select(
        "project", "ord", "band", F.md5("entry").alias("entry_md5"))


def conversion_averages(s, d):
    return convert.averages(_conversions(s, d))


def confidence_bands(s, d):
    return _conversions(s, d).groupBy(T.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def analysis(s, d):
    files = _files(s, d, "project", "imports", "raw_source")
    return pipeline.analyze(files, _classes(s, d), _links(s, d))


def parsed_java(s, d):
    files = _files(s, d, "project", "file_path", "raw_source").where(F.col("file_path").endswith(".java") & F.col("raw_source").isNotNull())
    p = java.parsed_files(files, "file_id", "project")
    return p.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.size("parse_errors") > 0).alias("failed"),
        F.sum(F.size("classes")).alias("n_classes"), F.sum(F.size(F.flatten(F.transform("classes", lambda c: c.methods)))).alias("n_methods"))


def parsed_methods(s, d):
    files = _files(s, d, "project", "file_path", "raw_source").where(F.col("file_path").endswith(".java") & F.col("raw_source").isNotNull())
    return java.all_methods(java.parsed_files(files, "file_id"), "file_id").select(
        "file_id", "qualified_name", "start_line", "end_line", "return_type", "parameters", "modifiers", "calls", "is_entry_point")


def method_ends(s, d):
    files = _files(s, d, "project", "file_path", "raw_source")
    m = _methods(s, d, "class_id", "start_line").join(_classes(s, d).select("class_id", "file_id"), "class_id")
    return java.method_end_lines(files.where("raw_source is not null"), m)


def repo_names(s, d):
    """Repository names from addresses made of the projects' names."""
    url = F.concat(F.lit("https://git.example.org/team/"), "project", F.lit(".git/"))
    return _files(s, d, "project").where("project <> ''").select("project", T.repo_name(url).alias("repo")).distinct()


NAMES = (
    "noise_regions commented_code_regions noise_summary clean_source line_predicates token_estimates project_listing parse_status"
    " class_counts called_names dead_methods live_methods entry_points method_signatures class_signatures graph_nodes resolved_calls"
    " graph_edges graph_stats graph_export edge_dependents edge_dependencies edge_reachable edge_worth cyclic_projects call_components"
    " conversion_order context_windows context_windows_tight scored_dependencies prompts converted parsed_responses module_texts"
    " report_summary report_entries conversion_averages confidence_bands analysis parsed_java parsed_methods method_ends repo_names").split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from codeloom.plans.code_sql import SQL

    return SQL
