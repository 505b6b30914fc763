import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = {k: f for m in [__import__("importlib").import_module(x) for x in entry.MODULES] for k, f in m.queries().items()}
SQL = {k: s for m in [__import__("importlib").import_module(x) for x in entry.MODULES] for k, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view \"{f[:-8]}\" as select * from '{DATA}/{f}'")
    return c


def rows(frame):
    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return "~" if v is None else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    names = sorted(frame[0])
    order = [frame[0].index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in order) for r in frame[1])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    got = rows((df.columns, [tuple(r) for r in df.collect()]))
    rel = duck.execute(SQL[name])
    assert got == rows(([d[0] for d in rel.description], rel.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
