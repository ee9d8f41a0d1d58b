"""Each query against its DuckDB SQL on the small tables."""

import math
import os

import duckdb
import pytest

from millrace.operators import suite

SF = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in suite.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(normal(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_against_oracle(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in suite.ORACLE:
        cursor = duck.execute(suite.ORACLE[name])
        want = rows([c[0] for c in cursor.description], cursor.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
