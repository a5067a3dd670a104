"""Every query of the library against its oracle SQL in DuckDB, over the smallest tables."""

import decimal
import math

import duckdb
import pytest

from glossa.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    wanted = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows == sorted(repr(tuple(map(plain, r))) for r in wanted)
