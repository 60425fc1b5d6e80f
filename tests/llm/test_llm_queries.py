"""Registered queries of the subpackage against their SQL on the smallest driver tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import SF, TABLES, canon

from corpusloom.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_over_all_rows(spark, name):
    rows = QUERIES[name](spark, SF)
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    assert rows.filter(f"{key} is not null").select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
