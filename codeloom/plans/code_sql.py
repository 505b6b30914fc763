"""SQL of the code-analysis queries."""

from __future__ import annotations

_BASE = r"""
cf AS (SELECT DISTINCT ON (file_id) * FROM files WHERE file_id IS NOT NULL ORDER BY file_id, scanned_at),
cc AS (SELECT * FROM (SELECT DISTINCT ON (class_id) * FROM classes WHERE class_id IS NOT NULL ORDER BY class_id, scanned_at) WHERE deleted_at IS NULL),
cm AS (SELECT * FROM (SELECT DISTINCT ON (method_id) * FROM methods WHERE method_id IS NOT NULL ORDER BY method_id, scanned_at) WHERE deleted_at IS NULL),
cv AS (SELECT DISTINCT ON (conversion_id) * FROM conversions WHERE conversion_id IS NOT NULL ORDER BY conversion_id, converted_at),
ce AS (SELECT project, source, regexp_replace(target, '^\s+|\s+$', '', 'g') AS target, dep_type, weight FROM
       (SELECT DISTINCT ON (edge_id) * FROM edges WHERE edge_id IS NOT NULL ORDER BY edge_id, scanned_at)
       WHERE source IS NOT NULL AND target IS NOT NULL)
"""


def _lines(name: str, rows: str) -> str:
    """CTE ``name`` (k, project, ln, line, s): lines of rows (k, project, t)."""
    return rf"""
{name}_l AS (SELECT k, project, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '\n\z', ''), chr(10)) END AS ls
             FROM (SELECT k, project, regexp_replace(t, '\r\n?', chr(10), 'g') AS t FROM ({rows}) WHERE t IS NOT NULL)),
{name} AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM
           (SELECT k, project, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM {name}_l))"""


_COMMENT = "(s = '' OR starts_with(s, '//') OR starts_with(s, '/*') OR starts_with(s, '*'))"
_CODE_REST = r"regexp_matches(regexp_replace(regexp_replace(s, '^/+', ''), '^\s+|\s+$', '', 'g'), '^(public|private|protected)\s|^(return|if|else|for|while|switch)\s|^\w+\s*\(.*\)\s*[;{]|^\w+\s+\w+\s*=|^this\.\w+|^\w+\.\w+\(|^\}')"
_COMMENTED = f"(starts_with(s, '//') AND {_CODE_REST})"
_TAG = "regexp_matches(upper(line), 'TODO|FIXME|HACK|NOTE|XXX')"


def _regions(name: str, of: str) -> str:
    return f"""
{name} AS (SELECT k, min(ln) AS start_line, max(ln) AS end_line, count(*) AS n, bool_or(tagged) AS tagged FROM
           (SELECT k, ln, {_TAG} AS tagged, ln - row_number() OVER (PARTITION BY k ORDER BY ln) AS g FROM {of} WHERE {_COMMENT})
           GROUP BY k, g HAVING count(*) >= 3)"""


def _cleaned(name: str, of: str, regions: str) -> str:
    """CTE ``name`` (k, cleaned, ol, cl): cleaned text and line counts."""
    return f"""
{name}_k AS (SELECT l.*, EXISTS (SELECT 1 FROM {regions} r WHERE r.k = l.k) AS has FROM {of} l
             WHERE NOT EXISTS (SELECT 1 FROM {regions} r WHERE r.k = l.k AND l.ln BETWEEN r.start_line AND r.end_line)),
{name}_o AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY ln) AS p FROM {name}_k) WHERE NOT (has AND s = '' AND p IS NOT NULL AND p = '')),
{name} AS (SELECT l.k, len(l.ls) AS ol, coalesce(o.n, 0) AS cl, coalesce(o.t, '') AS joined,
                  EXISTS (SELECT 1 FROM {regions} r WHERE r.k = l.k) AS has FROM {of}_l l
           LEFT JOIN (SELECT k, count(*) AS n, string_agg(line, chr(10) ORDER BY ln) AS t FROM {name}_o GROUP BY k) o ON o.k = l.k)"""


_FILE_LINES = _lines("fl", "SELECT file_id AS k, project, raw_source AS t FROM cf")
_ENTRY = "((name = 'main' AND coalesce(list_contains(modifiers, 'static'), false)) OR name IN ('init', 'run', 'start', 'execute'))"
_CALLED = """
raw_calls AS (SELECT DISTINCT project, call FROM (SELECT project, unnest(calls) AS call FROM cm) WHERE call IS NOT NULL),
called AS (SELECT project, call AS called FROM raw_calls UNION SELECT project, string_split(call, '.')[-1] FROM raw_calls)"""
_DEAD = f"""
dead AS (SELECT project, method_id, qualified_name FROM cm m
         WHERE NOT coalesce({_ENTRY} OR name = '__init__' OR regexp_matches(name, '^(get|set|is)') OR name IN ('toString', 'hashCode', 'equals', 'compareTo'), true)
           AND NOT EXISTS (SELECT 1 FROM called c WHERE c.project = m.project AND c.called = m.name)
           AND NOT EXISTS (SELECT 1 FROM called c WHERE c.project = m.project AND c.called = m.qualified_name))"""
_REGISTRIES = """
creg AS (SELECT DISTINCT ON (project, name) project, name AS class_name, file_id, file_path, class_ord, extends, implements, fields
         FROM cc WHERE name IS NOT NULL ORDER BY project, name, file_path DESC, class_ord DESC, class_id DESC),
mreg AS (SELECT DISTINCT ON (project, qualified_name) * FROM cm WHERE qualified_name IS NOT NULL
         ORDER BY project, qualified_name, file_path DESC, start_line DESC, method_id DESC)"""
_RESOLVED = """
known AS (SELECT DISTINCT project, class_name, name FROM cm WHERE qualified_name IS NOT NULL),
owners AS (SELECT k.*, r.file_path, r.class_ord FROM known k JOIN creg r USING (project, class_name)),
firsts AS (SELECT DISTINCT ON (project, name) project, name, class_name FROM owners ORDER BY project, name, file_path, class_ord, class_name),
asked AS (SELECT DISTINCT project, class_name AS parent, qualified_name AS source, call, string_split(call, '.')[1] AS s0,
                 CASE WHEN contains(call, '.') THEN string_split(call, '.')[2] END AS s1
          FROM (SELECT project, class_name, qualified_name, unnest(calls) AS call FROM cm) WHERE call IS NOT NULL AND qualified_name IS NOT NULL),
plain AS (SELECT a.project, a.source, coalesce(k.class_name, f.class_name) || '.' || a.s0 AS target FROM asked a
          LEFT JOIN known k ON k.project = a.project AND k.class_name = a.parent AND k.name = a.s0
          LEFT JOIN firsts f ON f.project = a.project AND f.name = a.s0 WHERE a.s1 IS NULL AND coalesce(k.class_name, f.class_name) IS NOT NULL),
dotted AS (SELECT a.*, EXISTS (SELECT 1 FROM known k WHERE k.project = a.project AND k.class_name = a.s0 AND k.name = a.s1) AS direct
           FROM asked a WHERE a.s1 IS NOT NULL),
through AS (SELECT DISTINCT ON (d.project, d.source, d.call) d.project, d.source, o.class_name || '.' || d.s1 AS target
            FROM dotted d JOIN creg p ON p.project = d.project AND p.class_name = d.parent
            JOIN owners o ON o.project = d.project AND o.name = d.s1
            WHERE NOT d.direct AND EXISTS (SELECT 1 FROM (SELECT unnest(p.fields) AS f) WHERE contains(f, o.class_name) AND contains(f, d.s0))
            ORDER BY d.project, d.source, d.call, o.file_path, o.class_ord, o.class_name),
resolved AS (SELECT project, source, target FROM plain UNION SELECT project, source, s0 || '.' || s1 FROM dotted WHERE direct
             UNION SELECT project, source, target FROM through)"""
_NODES = """
gnodes AS (SELECT DISTINCT project, name AS id, 'class' AS type FROM cc WHERE name IS NOT NULL
           UNION SELECT DISTINCT project, qualified_name, 'method' FROM cm WHERE qualified_name IS NOT NULL)"""
_EDGES = r"""
cnames AS (SELECT DISTINCT project, class_name FROM creg),
here AS (SELECT project, file_id, name AS source, extends, implements, fields FROM cc WHERE name IS NOT NULL),
phased AS (
  SELECT project, class_name AS source, qualified_name AS target, 0 AS phase FROM cm WHERE qualified_name IS NOT NULL AND class_name IS NOT NULL
  UNION ALL SELECT h.project, h.source, i.target, 1 FROM here h JOIN
    (SELECT file_id, string_split(i, '.')[-1] AS target FROM (SELECT file_id, unnest(imports) AS i FROM cf) WHERE i IS NOT NULL) i USING (file_id)
    JOIN cnames c ON c.project = h.project AND c.class_name = i.target
  UNION ALL SELECT h.project, h.source, h.extends, 2 FROM here h JOIN cnames c ON c.project = h.project AND c.class_name = h.extends
  UNION ALL SELECT h.project, h.source, h.i, 3 FROM (SELECT *, unnest(implements) AS i FROM here) h JOIN cnames c ON c.project = h.project AND c.class_name = h.i
  UNION ALL SELECT h.project, h.source, h.tok, 4 FROM (SELECT project, source, regexp_replace(unnest(regexp_split_to_array(f, '\s+')), '^[<>(),;]+|[<>(),;]+$', '', 'g') AS tok
       FROM (SELECT project, source, unnest(fields) AS f FROM here)) h JOIN cnames c ON c.project = h.project AND c.class_name = h.tok
  UNION ALL SELECT project, source, target, 5 FROM resolved),
gedges AS (SELECT project, source, target, ['calls', 'imports', 'inherits', 'implements', 'field_type', 'calls'][max(phase) + 1] AS dep_type,
                  [1.0, 0.5, 1.0, 0.8, 0.3, 1.0][max(phase) + 1]::DOUBLE AS weight FROM phased GROUP BY project, source, target)"""
_CLOSURE = """
hop(project, source, target) AS (SELECT DISTINCT project, source, target FROM resolved),
walk AS (SELECT project, source, target FROM hop UNION SELECT w.project, w.source, h.target FROM walk w JOIN hop h ON h.project = w.project AND h.source = w.target)"""


def _sql(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([_BASE, *ctes])}\n{select}"


_MODS = "list_transform(list_sort(list_transform(coalesce(modifiers, []), lambda m: coalesce(nullif(list_position(['public', 'protected', 'private', 'abstract', 'static', 'final', 'transient', 'volatile', 'synchronized', 'native', 'strictfp', 'default'], m), 0), 99)::VARCHAR.lpad(3, '0') || m)), lambda x: x[4:])"
_SIGNATURE = f"regexp_replace(array_to_string({_MODS}, ' ') || ' ' || coalesce(return_type, 'void') || ' ' || name || '(' || array_to_string(coalesce(parameters, []), ', ') || ') {{ /* ... */ }}', '^\\s+|\\s+$', '', 'g')"
_TOKENS = r"floor(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT"
_BAND = "CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
_PERCENT = "round_even(confidence * 100, 0)::INT || '%'"
_OUTCOMES = "SELECT project, string_split(qualified_name, '.')[1] AS class_name, qualified_name, conversion_id AS ord, confidence, explanation, confidence_notes, python_code FROM cv"
_METHOD_LINES = _lines("ml", "SELECT method_id AS k, project, source_code AS t FROM mreg WHERE source_code <> ''")
_FACTS = f"""
facts AS (SELECT m.project, m.qualified_name AS id, c.ol, c.cl, CASE WHEN c.has THEN c.joined ELSE m.source_code END AS code,
                 {_SIGNATURE} AS signature FROM mreg m JOIN mcl c ON c.k = m.method_id),
sized AS (SELECT *, {_TOKENS.format('code')} AS tokens, {_TOKENS.format('signature')} AS sig_tokens FROM facts)"""
_SCORED = """
near AS (SELECT DISTINCT project, source, target FROM gedges),
far2 AS (SELECT DISTINCT a.project, a.source, b.target FROM near a JOIN near b ON b.project = a.project AND b.source = a.target),
far3 AS (SELECT DISTINCT a.project, a.source, b.target FROM far2 a JOIN near b ON b.project = a.project AND b.source = a.target),
deps AS (SELECT project, source AS target, target AS dep_id, CASE dep_type WHEN 'calls' THEN 1.0 WHEN 'inherits' THEN 0.9 WHEN 'implements' THEN 0.8
                WHEN 'imports' THEN 0.5 WHEN 'field_type' THEN 0.3 ELSE 0.2 END::DOUBLE AS score, 'direct' AS label FROM gedges
         UNION ALL SELECT project, source, target, 0.1::DOUBLE, 'transitive' FROM (SELECT * FROM far2 UNION SELECT * FROM far3) f
         WHERE source <> target AND NOT EXISTS (SELECT 1 FROM near n WHERE n.project = f.project AND n.source = f.source AND n.target = f.target)),
scored AS (SELECT d.* FROM deps d JOIN gnodes g ON g.project = d.project AND g.id = d.target AND g.type = 'method')"""


def _packed(budget: int, select: str = "") -> str:
    ctes = (_REGISTRIES, _RESOLVED, _NODES, _EDGES, _METHOD_LINES, _regions("mr", "ml"), _cleaned("mcl", "ml", "mr"), _FACTS, _SCORED, f"""
tries AS (SELECT s.project, s.target, s.dep_id, s.label, f.tokens, f.sig_tokens, f.ol, f.code, f.signature,
                 row_number() OVER (PARTITION BY s.project, s.target ORDER BY s.score DESC, s.dep_id) AS pos
          FROM scored s JOIN sized f ON f.project = s.project AND f.id = s.dep_id),
walk AS (SELECT project, id AS target, 0::BIGINT AS pos, ({budget} - tokens - 500)::BIGINT AS room, ''::VARCHAR AS how FROM sized
         UNION ALL
         SELECT w.project, w.target, t.pos, w.room - CASE WHEN t.tokens <= w.room THEN t.tokens WHEN t.sig_tokens <= w.room THEN t.sig_tokens ELSE 0 END,
                CASE WHEN t.tokens <= w.room THEN 'full' WHEN t.sig_tokens <= w.room THEN 'signature' ELSE 'excluded' END
         FROM walk w JOIN tries t ON t.project = w.project AND t.target = w.target AND t.pos = w.pos + 1),
parts AS (SELECT t.project, t.target, t.pos, t.dep_id, w.how, t.ol, CASE WHEN w.how = 'full' THEN '// --- Dependency: ' || t.dep_id || ' (' || t.label || ') ---' || chr(10) || t.code
                 WHEN w.how = 'signature' THEN '// --- Dependency (signature only): ' || t.dep_id || ' ---' || chr(10) || t.signature END AS part
          FROM tries t JOIN walk w ON w.project = t.project AND w.target = t.target AND w.pos = t.pos),
grouped AS (SELECT project, target, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY pos) FILTER (how <> 'excluded'), '') AS context_code,
                   coalesce(list(CASE WHEN how = 'signature' THEN dep_id || ' [sig-only]' ELSE dep_id END ORDER BY pos) FILTER (how <> 'excluded'), []) AS included_deps,
                   coalesce(list(dep_id ORDER BY pos) FILTER (how = 'excluded'), []) AS excluded_deps, sum(ol) AS dep_lines FROM parts GROUP BY project, target),
whole AS (SELECT f.project, f.id AS target, coalesce(g.context_code, '') AS context_code, coalesce(g.included_deps, []) AS included_deps,
                 coalesce(g.excluded_deps, []) AS excluded_deps, (f.ol + coalesce(g.dep_lines, 0))::INT AS original_total_lines, f.cl, f.tokens
          FROM sized f LEFT JOIN grouped g ON g.project = f.project AND g.target = f.id),
counted AS (SELECT *, (CASE WHEN context_code = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(context_code, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), chr(10))) END + cl)::INT
                      AS optimized_total_lines FROM whole)""")
    return _sql(*ctes, *([_CALLED, _DEAD] if select else []), recursive=True, select=select or f"""
SELECT project, target, md5(context_code) AS context_md5, included_deps, excluded_deps, original_total_lines, optimized_total_lines,
       ({_TOKENS.format('context_code')} + tokens)::INT AS estimated_tokens,
       CASE WHEN original_total_lines = 0 THEN 0.0 ELSE 1.0::DOUBLE - optimized_total_lines / original_total_lines END AS compression_ratio FROM counted""")


_COMPONENTS = """
sccs AS (SELECT a.project, a.source AS node, min(b.source) AS component FROM walk a JOIN walk b ON b.project = a.project AND b.source = a.target AND b.target = a.source GROUP BY ALL),
named AS (SELECT g.project, g.id AS node, coalesce(c.component, g.id) AS component FROM gnodes g LEFT JOIN sccs c ON c.project = g.project AND c.node = g.id WHERE g.type = 'method'),
dag AS (SELECT DISTINCT a.project, a.component AS source, b.component AS target FROM resolved r JOIN named a ON a.project = r.project AND a.node = r.source
        JOIN named b ON b.project = r.project AND b.node = r.target WHERE a.component <> b.component),
ways(project, node, level) AS (SELECT DISTINCT project, component, 0 FROM named
        UNION SELECT w.project, d.target, w.level + 1 FROM ways w JOIN dag d ON d.project = w.project AND d.source = w.node),
levelled AS (SELECT n.project, n.node, n.component, l.level, n.project IN (SELECT project FROM walk WHERE source = target) AS cyclic
        FROM named n JOIN (SELECT project, node, max(level) AS level FROM ways GROUP BY ALL) l ON l.project = n.project AND l.node = n.component)"""
_RAW = r"""
raw AS (SELECT conversion_id, confidence, confidence_notes, explanation, '===PYTHON_CODE_START===' || chr(10) || coalesce(python_code, '') || chr(10) || '===PYTHON_CODE_END===' || chr(10)
        || '===EXPLANATION_START===' || chr(10) || coalesce(explanation, '') || chr(10) || '===EXPLANATION_END===' || chr(10) || '===CONFIDENCE===' || chr(10)
        || coalesce(CAST(confidence AS VARCHAR), '') || chr(10) || '===CONFIDENCE_NOTES===' || chr(10) || coalesce(confidence_notes, '') AS whole,
        regexp_replace(coalesce(python_code, ''), '^\s+|\s+$', '', 'g') AS marked FROM cv),
coded AS (SELECT *, regexp_extract(whole, '(?s)```python\n(.*?)```', 1) AS fenced, regexp_matches(whole, '(?s)```python\n.*?```') AS has_fence FROM raw)"""


SQL: dict[str, str] = {
    "noise_regions": _sql(_FILE_LINES, _regions("r", "fl"), select="""
SELECT k AS file_id, CASE WHEN tagged THEN 'todo_block' ELSE 'excessive_comments' END AS noise_type, start_line::INT AS start_line, end_line::INT AS end_line,
       n::INT AS n_lines, CASE WHEN tagged THEN 'TODO/FIXME block (' || n || ' lines) — irrelevant to LLM' ELSE 'Excessive comment block (' || n || ' lines)' END AS reason FROM r"""),
    "commented_code_regions": _sql(_FILE_LINES, select=f"""
SELECT k AS file_id, 'commented_out_code' AS noise_type, min(ln)::INT AS start_line, max(ln)::INT AS end_line, count(*)::INT AS n_lines,
       'Commented-out code (' || count(*) || ' lines)' AS reason FROM
  (SELECT k, ln, ln - row_number() OVER (PARTITION BY k ORDER BY ln) AS g FROM fl WHERE {_COMMENTED}) GROUP BY k, g HAVING count(*) >= 2"""),
    "noise_summary": _sql(_FILE_LINES, _regions("r", "fl"), """
per AS (SELECT k, sum(n) AS noise, sum(n) FILTER (NOT tagged) AS c, sum(n) FILTER (tagged) AS t FROM r GROUP BY k)""", select="""
SELECT f.project, sum(coalesce(len(l.ls), 0))::BIGINT AS total_lines, coalesce(sum(noise), 0)::BIGINT AS noise_lines,
       CASE WHEN sum(coalesce(len(l.ls), 0)) > 0 THEN coalesce(sum(noise), 0) / sum(coalesce(len(l.ls), 0)) ELSE 0.0 END::DOUBLE AS noise_ratio,
       coalesce(sum(c), 0)::BIGINT AS excessive_comments, coalesce(sum(t), 0)::BIGINT AS todo_block
FROM cf f LEFT JOIN fl_l l ON l.k = f.file_id LEFT JOIN per ON per.k = f.file_id GROUP BY f.project"""),
    "clean_source": _sql(_FILE_LINES, _regions("r", "fl"), _cleaned("cl", "fl", "r"), select="""
SELECT f.file_id, md5(CASE WHEN c.has THEN c.joined ELSE f.raw_source END) AS cleaned_md5, c.ol::INT AS original_lines, c.cl::INT AS cleaned_lines,
       CASE WHEN c.ol = 0 THEN 0.0 ELSE 1.0::DOUBLE - c.cl / c.ol END AS noise_ratio FROM cl c JOIN cf f ON f.file_id = c.k"""),
    "line_predicates": _sql(_FILE_LINES, select=f"""
SELECT project, count(*) AS n_lines, count(*) FILTER ({_COMMENT}) AS comment_lines, count(*) FILTER ({_COMMENTED}) AS commented_code_lines,
       count(*) FILTER (regexp_matches(s, '^(public|private|protected|static|final|abstract|class|interface|enum|import|package|return|if|else|for|while|switch|try|catch|throw|new|void|@)')) AS code_lines,
       count(*) FILTER ({_TAG}) AS tagged_lines FROM fl WHERE project IS NOT NULL GROUP BY project"""),
    "token_estimates": f"SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS tokens FROM documents",
    "project_listing": _sql(_FILE_LINES, select="""
SELECT project, count(*) AS files, count(*) FILTER (ends_with(file_path, '.java')) AS suffix_files, coalesce(sum(coalesce(len(l.ls), 0)), 0)::BIGINT AS lines,
       count(*) FILTER (len(parse_errors) > 0) AS failed FROM cf LEFT JOIN (SELECT k, ls FROM fl_l) l ON l.k = file_id GROUP BY project"""),
    "parse_status": _sql(select="SELECT project, count(*) FILTER (coalesce(len(parse_errors), 0) = 0) AS ok, count(*) FILTER (len(parse_errors) > 0) AS failed FROM cf GROUP BY project"),
    "class_counts": _sql(select="""
SELECT f.file_id, f.project, coalesce(n, 0) AS n_classes, coalesce(i, 0) AS n_interfaces FROM cf f LEFT JOIN
  (SELECT file_id, count(*) AS n, count(*) FILTER (is_interface) AS i FROM cc GROUP BY file_id) c USING (file_id)"""),
    "called_names": _sql(_CALLED, select="SELECT * FROM called"),
    "dead_methods": _sql(_CALLED, _DEAD, select="SELECT * FROM dead"),
    "live_methods": _sql(_CALLED, _DEAD, select="""
SELECT project, method_id, qualified_name FROM cm m WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.project = m.project AND d.qualified_name = m.qualified_name)"""),
    "entry_points": _sql(select=f"SELECT project, method_id, qualified_name FROM cm WHERE {_ENTRY}"),
    "method_signatures": _sql(_REGISTRIES, select=f"SELECT project, qualified_name, {_SIGNATURE} AS signature FROM mreg"),
    "class_signatures": _sql(_REGISTRIES, select="""
SELECT project, class_name, 'class ' || class_name || coalesce(' extends ' || extends, '') || CASE WHEN len(implements) > 0 THEN ' implements ' || array_to_string(implements, ', ') ELSE '' END
       || ' {' || chr(10) || coalesce(array_to_string(list_transform(fields, lambda f: '    ' || f || ';' || chr(10)), ''), '') || '}' AS signature FROM creg"""),
    "graph_nodes": _sql(_NODES, select="SELECT project, id, type, string_split(id, '.')[-1] AS label FROM gnodes"),
    "resolved_calls": _sql(_REGISTRIES, _RESOLVED, select="SELECT * FROM resolved"),
    "graph_edges": _sql(_REGISTRIES, _RESOLVED, _EDGES, select="SELECT * FROM gedges"),
    "graph_export": _sql(_REGISTRIES, _RESOLVED, _NODES, _EDGES, select="""
SELECT project, 'node' AS kind, '{"id":"' || id || '","type":"' || type || '","label":"' || string_split(id, '.')[-1] || '"}' AS item FROM gnodes
UNION ALL SELECT project, 'edge', '{"source":"' || source || '","target":"' || target || '","type":"' || dep_type || '"}' FROM gedges"""),
    "graph_stats": _sql(_REGISTRIES, _RESOLVED, _NODES, _EDGES, """
hop(project, source, target) AS (SELECT DISTINCT project, source, target FROM gedges),
walk AS (SELECT project, source, target FROM hop UNION SELECT w.project, w.source, h.target FROM walk w JOIN hop h ON h.project = w.project AND h.source = w.target)""",
        recursive=True, select="""
SELECT n.project, count(*) AS nodes, coalesce((SELECT count(*) FROM gedges e WHERE e.project = n.project), 0) AS edges,
       count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'method') AS methods,
       coalesce(bool_or(n.project IN (SELECT project FROM walk WHERE source = target)), false) AS has_cycles FROM gnodes n GROUP BY n.project"""),
    "edge_dependents": _sql(select="SELECT DISTINCT project, target AS node, source AS dependent FROM ce"),
    "edge_dependencies": _sql(select="SELECT DISTINCT project, source AS node, target AS dependency FROM ce"),
    "edge_reachable": _sql("""
near AS (SELECT DISTINCT project, source, target FROM ce),
walk AS (SELECT project, source, target, 1 AS depth FROM near UNION SELECT w.project, w.source, n.target, w.depth + 1 FROM walk w
         JOIN near n ON n.project = w.project AND n.source = w.target WHERE w.depth < 3)""", recursive=True, select="""
SELECT project, source, target, min(depth)::INT AS depth FROM walk WHERE source <> target GROUP BY ALL"""),
    "edge_worth": _sql(select="""
SELECT project, dep_type, count(*) AS n, sum(weight) AS weight, sum(CASE dep_type WHEN 'calls' THEN 1.0 WHEN 'inherits' THEN 0.9 WHEN 'implements' THEN 0.8 WHEN 'imports' THEN 0.5
       WHEN 'field_type' THEN 0.3 WHEN 'param_type' THEN 0.3 WHEN 'return_type' THEN 0.3 ELSE 0.2 END::DOUBLE) AS worth FROM ce GROUP BY ALL"""),
    "cyclic_projects": _sql(_REGISTRIES, _RESOLVED, _CLOSURE, recursive=True, select="SELECT DISTINCT project FROM walk WHERE source = target"),
    "call_components": _sql(_REGISTRIES, _RESOLVED, _CLOSURE, recursive=True, select="""
SELECT a.project, a.source AS node, min(b.source) AS component FROM walk a JOIN walk b ON b.project = a.project AND b.source = a.target AND b.target = a.source
GROUP BY ALL"""),
    "context_windows": _packed(6000),
    "prompts": _packed(6000, """
SELECT w.project, m.qualified_name, md5('## Java method ' || m.class_name || '#' || m.name || chr(10) || chr(10) || f.code
       || CASE WHEN w.context_code <> '' THEN chr(10) || chr(10) || '## Code that it uses' || chr(10) || chr(10) || w.context_code ELSE '' END
       || CASE WHEN len(w.excluded_deps) > 0 THEN chr(10) || chr(10) || '## Used too, but not shown' || chr(10) || array_to_string(w.excluded_deps, chr(10)) ELSE '' END
       || chr(10) || chr(10) || '## Task' || chr(10) || 'Write this method in Python.'
       || CASE WHEN len(w.excluded_deps) > 0 THEN chr(10) || chr(10) || 'Leave a comment `unseen: <name>` where code that is not shown decides the result.' ELSE '' END) AS prompt_md5,
       w.included_deps, w.excluded_deps
FROM counted w JOIN mreg m ON m.project = w.project AND m.qualified_name = w.target JOIN facts f ON f.project = w.project AND f.id = w.target
WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.project = m.project AND d.qualified_name = m.qualified_name)"""),
    "context_windows_tight": _packed(700),
    "scored_dependencies": _sql(_REGISTRIES, _RESOLVED, _NODES, _EDGES, _SCORED, select="SELECT * FROM scored"),
    "conversion_order": _sql(_REGISTRIES, _RESOLVED, _NODES, _CLOSURE, _COMPONENTS, recursive=True, select="""
SELECT project, node, component, level, cyclic, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN cyclic THEN -level ELSE level END, component, node) AS rank FROM levelled"""),
    "method_ends": _sql(_lines("ml", "SELECT file_id AS k, project, raw_source AS t FROM cf"), """
depth AS (SELECT k, ln, len(line) - len(replace(line, '{', '')) AS o, len(line) - len(replace(line, '}', '')) AS c FROM ml),
run AS (SELECT k, ln, sum(o - c) OVER w AS after, sum(o) OVER w AS seen, sum(o - c) OVER w - o + c AS before, sum(o) OVER w - o AS seen_before FROM depth WINDOW w AS (PARTITION BY k ORDER BY ln)),
begun AS (SELECT m.method_id, c.file_id, r.ln, r.before, r.seen_before FROM cm m JOIN cc c USING (class_id) JOIN run r ON r.k = c.file_id AND r.ln = m.start_line)""", select="""
SELECT a.method_id, CAST(coalesce(min(r.ln) FILTER (r.ln >= a.ln AND r.seen > a.seen_before AND r.after <= a.before), max(r.ln)) AS INT) AS end_line
FROM begun a JOIN run r ON r.k = a.file_id GROUP BY a.method_id"""),
    "repo_names": _sql(select="SELECT DISTINCT project, project AS repo FROM cf WHERE project <> ''"),
    "parsed_responses": _sql(_RAW, select=r"""
SELECT conversion_id, md5(CASE WHEN marked <> '' THEN marked WHEN has_fence THEN regexp_replace(fenced, '^\s+|\s+$', '', 'g') ELSE regexp_replace(whole, '^\s+|\s+$', '', 'g') END) AS code_md5, CASE WHEN e = '' THEN 'Conversion completed.' ELSE e END AS explanation, coalesce(confidence, 0.5) AS confidence,
       regexp_replace(coalesce(confidence_notes, ''), '^\s+|\s+$', '', 'g') AS confidence_notes
FROM (SELECT *, regexp_replace(coalesce(explanation, ''), '^\s+|\s+$', '', 'g') AS e FROM coded)"""),
    "module_texts": _sql(f"out AS ({_OUTCOMES})", select=rf"""
SELECT project, lower(regexp_replace(regexp_replace(class_name, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) || '.py' AS module,
       md5('""{chr(34)}' || chr(10) || 'Converted from the Java class ' || class_name || '.' || chr(10) || '""{chr(34)}' || chr(10) || chr(10) || string_agg('# --- ' || qualified_name || ' ---' || chr(10) || '# Confidence: ' || {_PERCENT} || chr(10)
         || CASE WHEN coalesce(confidence_notes, '') <> '' THEN '# Notes: ' || regexp_replace(confidence_notes, '\s*\n\s*', ' ', 'g') || chr(10) ELSE '' END
         || chr(10) || coalesce(python_code, '') || chr(10) || chr(10), chr(10) ORDER BY ord)) AS text_md5
FROM out WHERE confidence IS NOT NULL AND class_name IS NOT NULL GROUP BY project, class_name"""),
    "report_summary": _sql(select=f"""
SELECT project, count(*) AS converted, coalesce(avg(confidence), 0.0) AS mean_confidence, count(*) FILTER ({_BAND} = 'HIGH') AS high,
       count(*) FILTER ({_BAND} = 'MEDIUM') AS medium, count(*) FILTER ({_BAND} = 'LOW') AS low FROM cv GROUP BY project"""),
    "report_entries": _sql(select=f"""
SELECT project, conversion_id AS ord, {_BAND} AS band, md5('### [' || {_BAND} || '] ' || qualified_name || chr(10) || '- **Confidence**: ' || {_PERCENT} || chr(10)
       || '- **Explanation**: ' || coalesce(explanation, '') || CASE WHEN coalesce(confidence_notes, '') <> '' THEN chr(10) || '- **Notes**: ' || confidence_notes ELSE '' END || chr(10)) AS entry_md5
FROM cv WHERE confidence IS NOT NULL"""),
    "conversion_averages": _sql(_lines("pl", "SELECT conversion_id AS k, project, python_code AS t FROM cv"), select="""
SELECT cv.project, count(*) AS methods_converted, coalesce(avg(confidence), 0.0) AS avg_confidence, coalesce(sum(len(l.ls)), 0)::BIGINT AS total_output_lines
FROM cv LEFT JOIN (SELECT k, ls FROM pl_l) l ON l.k = conversion_id GROUP BY cv.project"""),
    "confidence_bands": _sql(select=f"SELECT {_BAND} AS band, count(*) AS n FROM cv GROUP BY ALL"),
    "analysis": _sql(_FILE_LINES, _regions("r", "fl"), _CALLED, _DEAD, _REGISTRIES, _RESOLVED, _NODES, _EDGES, """
per AS (SELECT k, sum(n) AS noise FROM r GROUP BY k)""", select="""
SELECT f.project, count(*) AS n_files, coalesce((SELECT count(*) FROM cc WHERE cc.project = f.project), 0) AS n_classes,
       coalesce((SELECT count(*) FROM cm WHERE cm.project = f.project), 0) AS n_methods, coalesce((SELECT count(*) FROM dead d WHERE d.project = f.project), 0) AS dead_methods,
       coalesce((SELECT count(*) FROM gnodes g WHERE g.project = f.project), 0) AS graph_nodes, coalesce((SELECT count(*) FROM gedges g WHERE g.project = f.project), 0) AS graph_edges,
       sum(coalesce(len(l.ls), 0))::BIGINT AS total_lines, coalesce(sum(noise), 0)::BIGINT AS noise_lines,
       CASE WHEN sum(coalesce(len(l.ls), 0)) > 0 THEN coalesce(sum(noise), 0) / sum(coalesce(len(l.ls), 0)) ELSE 0.0 END::DOUBLE AS noise_ratio
FROM cf f LEFT JOIN fl_l l ON l.k = f.file_id LEFT JOIN per ON per.k = f.file_id GROUP BY f.project"""),
}
