"""Every query with SQL gives the same rows as DuckDB over sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import registry

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.ORACLES.get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert got == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "variant_count", "changed_verse_count", "total_verse_count"]
