"""Every query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest
from catalogs import DATA

from tessera.plans.queries import ORACLE_SQL, QUERIES


def rows(table) -> list[str]:
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    names = sorted(table.column_names)
    return sorted(repr([clean(r[n]) for n in names]) for r in table.to_pylist())


def check(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = query(spark, str(DATA)).toArrow(), con.sql(sql).fetch_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])
