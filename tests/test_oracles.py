"""A cross-section of the registered queries against their SQL twins at the smallest scale."""

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_sql import rows_of  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")

PICKED = [
    "profile_numeric_nulls", "cramers_v", "class_freq", "infer_dtype", "scan_cells", "pii_columns", "scan_lines", "anonymize_customer",
    "exact_copy_rate_nulls", "js_numeric", "nearest_record", "metric_gate", "repair_ranges", "gen_conditional", "compare_runs", "stream_windows",
]


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_same_rows(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 150


def test_entry(spark):
    assert entry.entry(spark).count() == 5
