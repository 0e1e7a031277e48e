import math

import duckdb
import pytest

import __spark_entry__
from lorespark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 40 and all(0 <= r.confidence <= 1 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
