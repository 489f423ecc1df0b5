"""Every core query against its DuckDB twin, and those without one for rows and stable columns."""

import math

import duckdb
import pytest

from webloom.plans.oracle import ORACLES
from webloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def tidy(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_twin(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert out.columns and len(out.collect()) > 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id > 5").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint>" in plan
