import random
import time

from codeloom.llm import defects, docpairs, islands, lexing, grammars, origin, packing, secrets, spans, tokens

LONG = "word another 12345 thing; " * 20_000


def test_long_texts_take_time_in_proportion():
    began = time.time()
    defects.votes("def f():\n" + "    x = 1\n" * 20_000, LONG, LONG, "void f() { " + "x = 1;\n" * 20_000 + "}")
    docpairs.is_description("/** " + LONG + "*/", "A.f")
    list(islands.functions("a.java", "class A { " + "void f() { x(\"}\"); }\n" * 20_000 + "}"))
    list(islands.functions("a.py", "def f(a):\n    return a\n" * 2_000))
    secrets.candidates("password = '" + "a1" * 100_000 + "';\n" + LONG)
    assert secrets.residual("Zq1" * 50_000, {"zq": 3.0}, 2) == 50_000
    assert grammars.valid("java", "class A { void f() { " + "x(1, \"a\");\n" * 20_000 + "} }")
    assert grammars.valid("js", "f(function() { return [1, {a: 2}]; });\n" * 10_000)
    lexing.state_map("js", "x = `a`;\n" * 20_000, False)
    assert time.time() - began < 90


def test_one_long_text_among_short_ones(spark):
    r = random.Random(1)
    long = "".join(r.choices("abcdefgh \n", k=400_000)) + "-=" * 100_000
    df = spark.createDataFrame([(1, long), (2, "x" + long[300_000:300_300]), (4, "-=" * 150), (3, "short")], "doc_id long, text string")
    found = spans.shared_spans(df)
    assert sorted(tuple(r) for r in spans.shared_pairs(found).collect()) == [(1, 2), (1, 4)]
    sizes = tokens.token_sizes(df.where("doc_id < 3"))
    budgets = spark.createDataFrame([("b", 1000, 0)], "budget_name string, capacity_tokens int, reserved_tokens int")
    boxes = packing.containers(packing.placed(packing.pieces(sizes, budgets))).collect()
    assert sum(b.used_tokens for b in boxes) == sum(r.tokens for r in sizes.collect()) and max(b.used_tokens for b in boxes) <= 1000


def test_long_file_grammar(spark):
    body = "class A { " + "".join(f"int f{i} = {i}; void g{i}() {{ h{i}(f{i}); }}\n" for i in range(30_000)) + "}"
    df = spark.createDataFrame([(1, "p", "A.java", body), (2, "q", "B.java", "class B { }")], "file_id long, project string, file_path string, raw_source string")
    assert {r.file_id: r.kind for r in origin.judged(df).collect()} == {1: "generated", 2: None}
