"""Every query with SQL gives what DuckDB gives; the others give rows. Both run over whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomstrata.plans import queries as plans


def _rows(frame):
    columns = sorted(frame.columns)
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ in ("int64", "int32", "float64", "Decimal") else str(x)

    return columns, sorted((tuple(cell(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, data, db, name):
    assert _rows(entry.queries()[name](spark, data).toPandas()) == _rows(db.sql(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLE_SQL.keys()))
def test_gives_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
