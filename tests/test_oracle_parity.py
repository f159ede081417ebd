"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as se
from ledgerlake.sources.tables import SOURCE_TABLES

from conftest import SF_SMALL

SQL = se.oracle_sql()
QUERIES = se.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _canon(names, recs):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in recs]
    return [names[i] for i in order], sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_entry(spark):
    assert set(SQL) <= set(QUERIES)
    df = se.entry(spark)
    assert df.count() > 0 and df.columns[0] == "hour"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cur = duck.execute(SQL[key])
    dcols, drows = _canon([d[0] for d in cur.description], cur.fetchall())
    scols, srows = _canon(sdf.columns, sdf.collect())
    assert scols == dcols
    assert srows == drows
