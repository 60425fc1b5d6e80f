"""Every registered query against its SQL on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    text = lambda v: ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)
    return [cols[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    if name in registry.SQL:
        cur = duck.execute(registry.SQL[name])
        assert got == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "windows", "grams"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["attention_pairs", "attention_entropy", "best_heads", "head_intervals", "matched_controls"])
def test_odd_events_match_sql(spark, tmp_path, name):
    """Attention rows without any weight, and a layer with too few heads for its controls."""
    con, path = duckdb.connect(), tmp_path / "events.parquet"
    kind, value = "CASE WHEN range % 16 < 12 THEN 'purchase' ELSE 'view' END", "CASE WHEN range = 64 OR range // 8 = 59 THEN 0.0 ELSE 1.0 + range % 7 END"
    con.execute(f"COPY (SELECT range AS event_id, {kind} AS event_type, {value} AS value FROM range(1536)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got, cur = canon([tuple(r) for r in df.collect()], df.columns), con.execute(registry.SQL[name])
    assert got == canon(cur.fetchall(), [d[0] for d in cur.description]) and got[1]
