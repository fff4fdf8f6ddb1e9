"""Registered queries against their SQL counterparts on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from promptward.plans import oracle as plan_oracle
from promptward.plans import queries as plan_queries

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = "documents events conversations labels benchmark pages".split()

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")
QUERIES, ORACLE = plan_queries.QUERIES, plan_oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, str(SF_DIR))
    sql = duck.execute(ORACLE[name])
    columns = [d[0] for d in sql.description]
    assert canonical(result.collect(), result.columns) == canonical(sql.fetchall(), columns)


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
