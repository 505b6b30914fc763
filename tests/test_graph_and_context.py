import itertools
import random

from codeloom.operators import context, deadcode, graph, resolve


def edges(spark, pairs, project="p"):
    return spark.createDataFrame([(project, a, b) for a, b in pairs], "project string, source string, target string")


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def test_components(spark):
    r = random.Random(3)
    for size in (6, 12):
        pairs = list({(f"n{r.randrange(size)}", f"n{r.randrange(size)}") for _ in range(size + 3)})
        got = {x.node: x.component for x in graph.components(edges(spark, pairs)).collect()}
        assert got == brute_scc(pairs)
    assert graph.components(edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_order(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")]
    nodes = spark.createDataFrame([("p", n) for n in "abcde"], "project string, node string")
    got = [x.node for x in graph.conversion_order(nodes, edges(spark, pairs)).orderBy("rank").collect()]
    assert got == ["a", "d", "e", "b", "c"]
    loop = graph.conversion_order(nodes, edges(spark, [*pairs, ("c", "b")])).orderBy("rank").collect()
    assert [x.node for x in loop] == ["b", "c", "a", "d", "e"] and all(x.cyclic for x in loop)


def test_reachable(spark):
    got = {(x.source, x.target): x.depth for x in graph.reachable(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a"), ("b", "a")])).collect()}
    assert got[("a", "d")] == 3 and ("a", "e") not in got and ("a", "a") not in got


METHOD = "method_id long, project string, file_path string, class_name string, name string, qualified_name string, start_line int, source_code string, return_type string, parameters array<string>, modifiers array<string>, calls array<string>"
CLASS = "class_id long, file_id long, project string, file_path string, class_ord int, name string, extends string, implements array<string>, fields array<string>"


def small(spark):
    m = spark.createDataFrame([
        (1, "p", "A.java", "A", "run", "A.run", 1, "void run() { help(); t.go(); }", "void", [], ["public"], ["help", "t.go", "B.idle"]),
        (2, "p", "A.java", "A", "help", "A.help", 9, "void help() { }", "void", ["int x"], [], []),
        (3, "p", "B.java", "Task", "go", "Task.go", 1, "void go() { " + "work " * 50 + "}", "void", [], ["static", "public"], ["go"]),
        (4, "p", "B.java", "Task", "unused", "Task.unused", 5, "void unused() { }", "void", None, None, None)], METHOD)
    c = spark.createDataFrame([
        (1, 1, "p", "A.java", 0, "A", "Base", ["Runnable"], ["private Task t", "private Map<String, Task> all"]),
        (2, 2, "p", "B.java", 0, "Task", "A", None, None)], CLASS)
    f = spark.createDataFrame([(1, "p", ["x.y.Task", None]), (2, "p", None)], "file_id long, project string, imports array<string>")
    return f, c, m


def test_resolution(spark):
    f, c, m = small(spark)
    calls = {(x.source, x.target) for x in resolve.resolve_calls(m, c).collect()}
    assert calls == {("A.run", "A.help"), ("A.run", "Task.go"), ("Task.go", "Task.go")}
    got = {(x.source, x.target): x.dep_type for x in resolve.edges(f, c, m).collect()}
    assert got[("A", "Task")] == "field_type" and got[("Task", "A")] == "inherits" and got[("A", "A.run")] == "calls"
    assert {x.qualified_name for x in deadcode.dead_methods(m).collect()} == {"Task.unused"}
    assert "Task.unused" not in {x.qualified_name for x in deadcode.without_dead(m, deadcode.dead_methods(m)).collect()}


def test_packing(spark):
    f, c, m = small(spark)
    facts = context.method_facts(resolve.method_registry(m))
    scored = context.scored_dependencies(resolve.edges(f, c, m), facts)
    wide = {x.target: x for x in context.pack(facts, scored).collect()}
    assert wide["A.run"].included_deps == ["A.help", "Task.go"] and not wide["A.run"].excluded_deps
    tight = {x.target: x for x in context.pack(facts, scored, budget=530).collect()}["A.run"]
    assert tight.included_deps == ["A.help", "Task.go [sig-only]"]
    assert "// --- Dependency (signature only): Task.go ---\npublic static void go() { /* ... */ }" in tight.context_code
    none = {x.target: x for x in context.pack(facts, scored, budget=500).collect()}["A.run"]
    assert none.included_deps == [] and none.excluded_deps == ["A.help", "Task.go"] and none.context_code == ""


def test_long_chains_take_few_rounds(spark):
    """A chain and a ring of thousands of nodes are contracted by pointer doubling."""
    n = 2500
    chain = [(f"n{i:05}", f"n{i + 1:05}") for i in range(n)]
    ring = [(f"r{i:05}", f"r{(i + 1) % n:05}") for i in range(n)]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = graph.components(edges(spark, chain + ring + [("r00000", "x"), ("x", "n00000")])).collect()
    assert {x.component for x in found} == {"r00000"} and len(found) == n
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 200
    nodes = spark.createDataFrame([("p", f"n{i:05}") for i in range(n + 1)], "project string, node string")
    assert all(int(x.node[1:]) == x.level and x.rank == x.level + 1 for x in graph.conversion_order(nodes, edges(spark, chain)).collect())
