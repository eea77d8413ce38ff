"""Every named query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_point
from tidemark.catalogue.registry import QUERIES
from tests.conftest import SF

CHECKS = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def cell(value):
    if value is None or isinstance(value, (bool, int, str)):
        return repr(value)
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in CHECKS:
        result = con.execute(CHECKS[name])
        assert got == table([d[0] for d in result.description], result.fetchall())


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
