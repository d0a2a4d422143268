"""Every registered query against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from shiftboard.bindings import load

SF = "/root/testdata/sf0.001"
REGISTRY = load()
QUERIES, ORACLES = REGISTRY.QUERIES, REGISTRY.ORACLES
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    return repr(x + 0.0) if isinstance(x, float) else None if x is None else str(x)


def bag(rows, names):
    order = [names.index(n) for n in sorted(names)]
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_point.queries().items() and ORACLES.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, duck, key):
    mine = QUERIES[key](spark, SF)
    relation = duck.sql(ORACLES[key])
    assert {f.name: TYPES[f.dataType.simpleString()] for f in mine.schema.fields} == dict(
        zip(relation.columns, map(str, relation.types))
    )
    assert bag(mine.collect(), mine.columns) == bag(relation.fetchall(), relation.columns)


def test_flagship(spark):
    d = entry_point.entry(spark)
    assert d.count() > 0 and "execution_bps_wow_change_pct" in d.columns
