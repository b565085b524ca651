"""Every registered query against DuckDB on the smallest tables, where they are there."""

import os

import duckdb
import pytest

from tollgate import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@pytest.fixture(scope="module")
def duck():
    return _views(SF)


def _cell(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


#: Fits, streams and generators that take the small tables beyond what they hold.
SLOW = {"model_lr_scores", "model_gbt_scores"}
SPARSE = {"drift_instances", "drift_instances_mix", "drift_instance_txns", "drift_splice_checks"}


def _views(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SPARSE))
def test_query_of_many_rings(spark, name):
    _same(spark, _views(LARGER), name, LARGER)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW - SPARSE))
def test_query(spark, duck, name):
    _same(spark, duck, name, SF)


def _same(spark, duck, name, sf):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert columns == sorted(names)
    assert got == sorted((tuple(_cell(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=repr)
