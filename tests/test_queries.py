"""Every registered query against its SQL, on the smallest driver scale."""

import math
import os

import pytest

import __spark_entry__ as entrypoint

SF = os.environ.get("NEWSLOOM_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return None if x is None else str(x)

    return sorted((tuple(text(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entrypoint.queries()))
def test_query(spark, duck, name):
    df = entrypoint.queries()[name](spark, SF)
    rows = df.collect()
    sql = entrypoint.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_entry(spark):
    assert entrypoint.entry(spark).count() == 20
