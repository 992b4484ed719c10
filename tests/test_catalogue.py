"""Every catalogue query with an SQL twin gives the rows that DuckDB gives."""

import os
from decimal import Decimal

import duckdb
import pytest

from strataspark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    cell = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else str(v)
    return sorted((tuple(cell(r[c]) for c in sorted(columns)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = [r.asDict() for r in found.collect()]
    assert rows, "a query without rows shows nothing"
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert normal(rows, columns) == normal([dict(zip(columns, r)) for r in cursor.fetchall()], columns)


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
