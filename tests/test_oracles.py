"""Every registered indicator against its SQL, on the smallest test tables if they are there."""

import math
import os

import pytest

from folioscope.plans import oracles
from folioscope.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, SQL = plans.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 9) + 0.0


def rows(found, columns, order):
    at = [order.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tables, name):
    frame = QUERIES[name](spark, DATA)
    cursor = tables.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(frame.columns)
    assert rows(frame.collect(), frame.columns, frame.columns) == rows(cursor.fetchall(), frame.columns, order)


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()
