import os

import duckdb
import pytest

import __spark_entry__ as entry
from findloom.plans import catalog_queries, library_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    twin = con.execute(catalog_queries.ORACLE[name])
    columns = [d[0] for d in twin.description]
    found = catalog_queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert cells(found.columns, found.collect()) == cells(columns, twin.fetchall())


def test_contract(spark):
    assert catalog_queries.QUERIES["written_index"] is library_queries.written_index
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["p_name", "owners"]


def test_pushdown(spark):
    plan = catalog_queries.search_path(spark, SF)._jdf.queryExecution().toString()
    assert "StringContains(url,/es/)" in plan and "ReadSchema: struct<page_id:bigint,url:string>" in plan
