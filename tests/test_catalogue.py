"""The catalogue against its SQL on the smallest tables, and the rules that SQL doesn't state."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from palimpsest import queries, queries_entries, queries_flow, queries_glue, queries_plans, queries_report, queries_standing, queries_store, queries_streams  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(int(v)) if v == v.to_integral_value() else repr(float(v))
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in queries.ORACLE_SQL:
        assert df.columns
        return
    r = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted("|".join(plain(row[columns.index(c)]) for c in order) for row in r.fetchall())
    assert sorted("|".join(plain(row[c]) for c in order) for row in got) == want
