import datetime as dt

from codeloom.operators import orphans as O


def day(n):
    return dt.datetime(2024, 1, n, 12)


def tables(spark, methods, edges, classes, external=("String",)):
    m = spark.createDataFrame(methods, "method_id long, project string, name string, qualified_name string, calls array<string>, scanned_at timestamp_ntz, deleted_at timestamp_ntz, runs int, kind string")
    e = spark.createDataFrame(edges, "edge_id long, project string, target string, scanned_at timestamp_ntz, at_us string")
    c = spark.createDataFrame(classes, "class_id long, project string, name string, extends string, scanned_at timestamp_ntz, deleted_at timestamp_ntz")
    x = spark.createDataFrame([(n,) for n in external], "name string")
    return m, e, c, x


def test_reasons(spark):
    m, e, c, x = tables(
        spark,
        [(1, "p", "go", "A.go", ["go", None, "B.stop", " com.x.A.go ", "a.b.c", "String.of", "", "gone"], day(2), None, 1, "k"),
         (1, "p", "go", "A.go", ["nowhere"], day(9), None, 1, "k"),  # delivered again: the earliest row counts
         (2, "p", "stop", "B.stop", None, day(5), None, 1, "k"),
         (3, "p", "gone", "A.gone", [], day(1), day(2), 1, "k"),
         (4, None, "lost", None, ["lost"], day(1), None, 1, "k"),
         (None, "p", "x", "X.x", ["x"], day(1), None, 1, "k")],
        [(1, "p", "A.go.deep", day(3), "z"), (2, "p", None, day(3), "z"), (3, "q", "A.go", day(3), "z"), (4, "p", "C", day(3), "z"), (4, "p", "C", day(3), "z")],
        [(1, "p", "A", "C", day(2), None), (2, "p", "C", "\tx.C ", day(1), day(3)), (2, "p", "C", None, day(8), None)])
    got = {(r.ref_table, r.ref_id, r.target, r.reason) for r in O.orphan_names(m, e, c, x).collect()}
    assert got == {
        ("methods", 1, "B.stop", "late"), ("methods", 1, "gone", "deleted"),
        ("edges", 3, "A.go", "missing"), ("edges", 4, "C", "deleted"),
    }
    report = O.orphan_name_report(O.orphan_names(m, e, c, x)).collect()
    assert sum(r.orphans for r in report) == 4 and {r.month for r in report} == {"2024-01"}


def test_runs_merge(spark):
    rows = [("A", 0, 9), ("A", 10, 20), ("A", 30, 40), ("A", 35, 36), ("A", 50, 10), ("B", 5, O.FOREVER), ("B", 9, 12), (None, 1, 2), ("C", None, 2), ("A", 0, 3)]
    df = spark.createDataFrame(rows, "target string, low long, high long")
    got = {(r.target, r.run_start): (r.run_end, r.last_start) for r in O.key_runs(df, ["target"], "low", "high").collect()}
    assert got == {("A", 0): (20, 10), ("A", 30): (40, 35), ("A", 50): (10, 50), ("B", 5): (O.FOREVER, 9)}


def test_ids_at_a_time(spark):
    parents = spark.createDataFrame([(1, day(1), day(3)), (1, day(6), None), (2, day(5), None), (None, day(1), None)], "id long, scanned_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([(1, day(2)), (1, day(4)), (1, day(4)), (1, day(7)), (2, day(1)), (3, day(1)), (None, day(1)), (3, None)], "fk long, seen timestamp_ntz")
    got = {(r.key, r.reason): r.ref_rows for r in O.orphan_ids(refs, "fk", "seen", parents, "id").collect()}
    assert got == {(1, "late"): 2, (2, "late"): 1, (3, "missing"): 1}
    gone = O.orphan_ids(refs, "fk", "seen", parents.where("id = 1 and deleted_at is not null"), "id").collect()
    assert ("deleted", 2) in {(r.reason, r.ref_rows) for r in gone}


def test_empty_tables(spark):
    m, e, c, x = tables(spark, [], [(1, "p", "A", day(1), "z")], [], external=())
    assert [tuple(r)[:4] for r in O.orphan_names(m, e, c, x).collect()] == [("edges", 1, "A", "missing")]
    m, e, c, x = tables(spark, [], [], [])
    assert O.orphan_names(m, e, c, x).count() == 0


def test_integer_keys(spark):
    parents = spark.createDataFrame([(i,) for i in [*range(1, 50), *range(60, 99), 99, 99, None]], "id long")
    refs = spark.createDataFrame([(i,) for i in [1, 49, 50, 55, 55, 60, 99, 100, None, -3]], "fk long")
    for block in (7, 1 << 20):
        got = {r.key: r.ref_rows for r in O.orphan_keys(refs, "fk", parents, "id", block).collect()}
        assert got == {50: 1, 55: 2, 100: 1, -3: 1}
    whole = parents.selectExpr("id", "0 as block")
    assert {(r.run_start, r.run_end) for r in O.key_runs(whole, ["block"], "id", "id").collect()} == {(1, 49), (60, 99)}
