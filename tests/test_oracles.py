"""Every query with a DuckDB equivalent gives the same columns, types and rows."""

import math

import pytest
from conftest import DATA

import __spark_entry__ as entry
from spanspark.plans.catalog import ORACLES, QUERIES

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    ours = ordered(tuple(plain(r[n]) for n in names) for r in df.collect())
    theirs = duck.sql(sql)
    assert sorted(theirs.columns) == names
    types = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == types
    at = [theirs.columns.index(n) for n in names]
    assert ours == ordered(tuple(plain(r[k]) for k in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


def test_entry(spark, duck):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
