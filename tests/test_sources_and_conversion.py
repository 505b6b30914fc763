import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import convert
from codeloom.sinks import modules
from codeloom.sources import java, scan
from codeloom.streaming import arrivals

SOURCE = """package a.b;
import java.util.List;
import static x.Y.z;
import q.*;
/** doc */
@Ann(x = {1})
public final class Box<T> extends Base<T> implements One, Two<T> {
    private final List<String> names = List.of("}", "{");
    int a, b;
    @Override
    public <R> List<R> map(final Fn<T, R> f, int... n) throws Err {
        names.forEach(x -> use(x)); this.go(1).stop(); Help.me(); return new Box<>(f);
    }
    Box(int size) { super(size); init(); }
    abstract void later();
}
"""


def test_java():
    p = java.parse(SOURCE)
    assert (p["package"], p["imports"], p["parse_errors"]) == ("a.b", ["java.util.List", "x.Y.z", "q"], [])
    c = p["classes"][0]
    assert (c["name"], c["extends"], c["implements"], c["modifiers"]) == ("Box", "Base", ["One", "Two"], ["final", "public"])
    assert c["fields"][0] == "private final List<String> names"
    by = {m["name"]: m for m in c["methods"]}
    assert list(by) == ["map", "later", "__init__"]
    assert by["map"]["return_type"] == "List<R>" and by["map"]["parameters"] == ["Fn<T, R> f", "int n"]
    assert by["map"]["calls"] == ["Help.me", "go", "names.forEach", "stop", "use"] and by["__init__"]["calls"] == ["init"]
    assert java.parse("class A { void f() {")["parse_errors"] and not java.parse("class A { void f() {")["classes"]


def test_parsed_files(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "class X {")], "file_id long, raw_source string")
    got = {r.file_id: r for r in java.parsed_files(df, "file_id").collect()}
    assert len(got[1].classes) == 1 and got[2].parse_errors and got[4].parse_errors and not got[3].parse_errors
    m = java.all_methods(java.parsed_files(df, "file_id"), "file_id")
    assert m.where("qualified_name = 'Box.map'").count() == 1


def test_method_ends(spark):
    f = spark.createDataFrame([(1, "class A {\n void f() {\n  if (x) {\n  }\n }\n int g();\n void h() { }\n}")], "file_id long, raw_source string")
    m = spark.createDataFrame([(1, 10, 2), (1, 11, 7), (1, 12, 6)], "file_id long, method_id long, start_line int")
    assert {r.method_id: r.end_line for r in java.method_end_lines(f, m).collect()} == {10: 5, 11: 7, 12: 7}


def test_scan_and_archives(spark, tmp_path):
    os.makedirs(tmp_path / "src/x")
    (tmp_path / "src/x/A.java").write_bytes(b"class A { } // \xff")
    (tmp_path / "src/x/b.txt").write_text("no")
    got = scan.scan(spark, f"{tmp_path}/src").collect()
    assert [r.file_path for r in got] == ["x/A.java"] and got[0].raw_source.endswith("�")
    with zipfile.ZipFile(tmp_path / "proj.zip", "w") as z:
        z.writestr("top/x/B.java", "class B { }")
        z.writestr("top/readme", "r")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert [tuple(r) for r in scan.scan_archives(spark, str(tmp_path)).collect()] == [("proj", "x/B.java", "class B { }")]
    assert scan.Settings.from_env({"MAX_CONTEXT_TOKENS": "9", "TEMPERATURE": "hot"}) == scan.Settings(max_context_tokens=9)


def test_responses(spark):
    raws = [
        "===PYTHON_CODE_START===\nx = 1\n===PYTHON_CODE_END===\n===EXPLANATION_START===\nwhy\n===EXPLANATION_END===\n===CONFIDENCE===\n7.5\n===CONFIDENCE_NOTES===\nn\n===END",
        "text ```python\ny = 2\n``` more ===CONFIDENCE=== 1.2.3", "z", "", None]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(
        convert.parse_response(F.col("raw")).alias("r")).collect()]
    assert tuple(got[0]) == ("x = 1", "why", 1.0, "n")
    assert tuple(got[1]) == ("y = 2", "Conversion completed.", 0.5, "") and got[2].code == "z" and got[3].code == got[4].code == ""


def test_conversion_never_fails(spark):
    def broken(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return convert.stub_converter(prompt)

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    got = {r.id: r.result for r in convert.convert(df, broken).collect()}
    assert got[2].code == "# ERROR: RuntimeError: down" and got[2].confidence == 0.0 and got[1].confidence == 0.5
    with pytest.raises(ValueError):
        convert.checked_key(" your-key ")
    prompt = df.select(convert.modernize_prompt(F.lit("src"), F.lit(""), F.lit("A"), F.lit("f"), F.array(F.lit("B.g"))).alias("p")).first().p
    assert "not shown\nB.g" in prompt and "Code that it uses" not in prompt
    assert convert.service(lambda system, prompt, key: f"{key}:{prompt}:{len(system) > 100}", "k1")("x") == "k1:x:True"


def test_modules(spark, tmp_path):
    df = spark.createDataFrame([("p", "BigBox", "BigBox.b", 2, 0.345, "", "b()"), ("p", "BigBox", "BigBox.a", 1, 0.9, "check", None)],
                               "project string, class_name string, qualified_name string, ord long, confidence double, confidence_notes string, python_code string")
    m = modules.module_texts(df)
    r = m.first()
    assert r.module == "big_box.py" and r.text.index("BigBox.a") < r.text.index("BigBox.b") and "# Notes: check" in r.text and "34%" in r.text
    assert [tuple(x)[:2] for x in modules.write_modules(m, str(tmp_path)).collect()] == [("p", "big_box.py")]
    assert (tmp_path / "p/big_box.py").read_text() == r.text
    both = m.unionByName(m.withColumn("module", F.lit("a.py"))).unionByName(m.withColumn("project", F.lit("q/1")))
    assert {tuple(x)[:2] for x in modules.write_archives(both, str(tmp_path / "zips")).collect()} == {("p", 2), ("q/1", 1)}
    with zipfile.ZipFile(tmp_path / "zips/p.zip") as z:
        assert z.namelist() == ["a.py", "big_box.py"] and z.read("big_box.py").decode() == r.text


def test_stream(spark, tmp_path):
    df = spark.sql("select 1L as file_id, 'p' as project, 'A.java' as file_path, 'class A { }' as raw_source, timestamp'2024-01-01 10:00:00' as scanned_at")
    df.union(df).write.parquet(str(tmp_path / "in"))
    stream = arrivals.file_stream(spark, str(tmp_path / "in"), df.schema)
    q = arrivals.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.project, r.files, r.lines) for r in spark.table("daily").collect()] == [("p", 1, 1)]


def test_conversions_without_confidence_stay(spark):
    df = spark.createDataFrame([("p", "A", "A.f", 1, None, None, "x = 1", None), ("p", "A", None, 2, 0.5, None, "y = 2", None)],
                               "project string, class_name string, qualified_name string, ord long, confidence double,"
                               " confidence_notes string, python_code string, explanation string")
    text = modules.module_texts(df).first().text
    assert "# --- A.f ---\n# Confidence: unknown\n\nx = 1" in text and "# --- (unnamed) ---\n# Confidence: 50%\n\ny = 2" in text
    entries = {r.ord: r.entry for r in modules.report_entries(df).collect()}
    assert entries[1].startswith("### [LOW] A.f\n- **Confidence**: unknown") and entries[2].startswith("### [MEDIUM] (unnamed)")
