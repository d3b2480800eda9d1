"""Every registered query against its SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from workload import ORACLE, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check import TABLES, canonical  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    want = duck.sql(ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canonical(got.to_pylist()) == canonical(want.to_pylist())


def test_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_first_line_per_key_in_file_order(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey"])
    want = {}
    for row in table.to_pylist():
        want.setdefault(row["l_orderkey"], row)
    got = {r.l_orderkey: r.asDict() for r in QUERIES["keep_first_in_file"](spark, SF).collect()}
    assert got == want


def test_entry_returns_rows(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert {"date", "region", "new_cases", "mean_7d", "rate_7d"} <= set(df.columns)
