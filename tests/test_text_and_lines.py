import random

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import lines


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, T.snake_case(F.col("a")), a="AccountHTTPServer") == "account_http_server"
    assert one(spark, T.token_estimate(F.col("a")), a=" one two\tthree\nfour five ") == 6
    assert one(spark, T.token_estimate(F.col("a")), a=None) == 0
    assert one(spark, T.repo_name(F.col("a")), a="https://host/x/repo.git/") == "repo"
    assert one(spark, T.repo_name(F.col("a")), a=" / ") is None
    assert one(spark, T.between(F.col("a"), "<<", ">>"), a="x << y >> z") == "y"
    assert one(spark, T.between(F.col("a"), "<<", ">>"), a="x << y") == "y"
    assert one(spark, T.between(F.col("a"), "<<", ">>"), a="x y") == ""
    assert one(spark, T.percent(F.lit(0.125), 0), a="") == "12%"
    assert one(spark, T.confidence_band(F.lit(0.8)), a="") == "HIGH"
    sig = T.method_signature(F.array(F.lit("static"), F.lit("public")), F.lit("int"), F.col("a"), F.array(F.lit("int x")))
    assert one(spark, sig, a="f") == "public static int f(int x) { /* ... */ }"


def brute_regions(text, threshold=3):
    out, start = [], None
    rows = text.splitlines()
    for i, line in enumerate([*rows, "code"]):
        s = line.strip()
        comment = i < len(rows) and (s == "" or s.startswith(("//", "/*", "*")))
        if comment and start is None:
            start = i
        if not comment and start is not None:
            if i - start >= threshold:
                block = "\n".join(rows[start:i]).upper()
                tagged = any(t in block for t in ("TODO", "FIXME", "HACK", "NOTE", "XXX"))
                out.append((start + 1, i, "todo_block" if tagged else "excessive_comments"))
            start = None
    return out


def brute_clean(text):
    regions = brute_regions(text)
    if not regions:
        return text
    kept = [x for i, x in enumerate(text.splitlines(), 1) if not any(a <= i <= b for a, b, _ in regions)]
    out = []
    for x in kept:
        if not (x.strip() == "" and out and out[-1].strip() == ""):
            out.append(x)
    return "\n".join(out)


def test_noise_against_brute_force(spark):
    r = random.Random(5)
    pool = ["int a = 1;", "// note it", "/* x", " * y", "*/", "", "  ", "// TODO fix", "return x;", "// plain"]
    texts = ["", None, "\n", "\n\n\n", "//a\r\n//b\r\n//c\r\ncode"] + ["\n".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, src string, ln int")
    got = {}
    for x in lines.noise_regions(df, "id", "src").collect():
        got.setdefault(x.id, []).append((x.start_line, x.end_line, x.noise_type))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == (brute_regions(t) if t is not None else [])
    cleaned = {x.id: x.cleaned_source for x in lines.clean_source(df, "id", "src").collect()}
    assert cleaned == {i: brute_clean(t) for i, t in enumerate(texts) if t is not None}


def test_noise_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, project string, src string")
    assert lines.noise_regions(empty, "id", "src").count() == 0
    assert lines.noise_summary(empty, "project", "id", "src").count() == 0
    two = spark.createDataFrame([(1, "p", "// a\n// b"), (2, "p", "// a\nif (x) {}\n// return x;\n// int y = 2;")], "id int, project string, src string")
    code = lines.noise_regions(two, "id", "src", commented_code=True).where("noise_type = 'commented_out_code'").collect()
    assert [(x.id, x.start_line, x.end_line) for x in code] == [(2, 3, 4)]
