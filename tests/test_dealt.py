"""Operators on tables that were dealt to all cores: their plans hold the places of rows, which no aggregate may meet."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilwork.functions.sizing import spread_small
from veilwork.operators import audit as R
from veilwork.operators import compare as C
from veilwork.operators import conditional as D
from veilwork.operators import synth as S
from veilwork.session import cut_lineage


def dealt(df):
    out = spread_small(cut_lineage(df))
    assert "monotonically_increasing_id" in out._jdf.queryExecution().analyzed().toString()
    return out


@pytest.fixture(scope="module")
def sides(spark):
    schema = "k long, x double, t string"
    o = [(i, float(i), "ab"[i % 4 == 0]) for i in range(40)]
    s = [(i, i + 0.25, "a" if i < 30 else "b") for i in range(40)]
    return dealt(spark.createDataFrame(o, schema)), dealt(spark.createDataFrame(s, schema))


def test_attribute_inference(sides):
    row = R.attribute_inference(*sides, "t", ["x"], "k", "k").first()
    right = sum(("ab"[i % 4 == 0]) == ("a" if i < 30 else "b") for i in range(40))
    assert (row["probes"], row["correct"], row["baseline"]) == (40, right, 0.5)
    empty = sides[0].where("k < 0")
    assert R.attribute_inference(empty, sides[1], "t", ["x"], "k", "k").first()["baseline"] is None


def test_category_max_gap(sides):
    found = {r["column"]: r["gap"] for r in C.category_max_gap(*sides).collect()}
    # "a" is 30 of 40 on one side, and on the other
    assert found == {"t": pytest.approx(0.0)}
    other = sides[1].withColumn("t", F.lit("a"))
    assert C.category_max_gap(sides[0], other).first()["gap"] == pytest.approx(0.25)


def test_fidelity(sides):
    other = sides[1].withColumn("t", F.lit("a"))
    found = {r["column"]: (r["kind"], round(r["gap"], 6), r["label"]) for r in C.fidelity(sides[0], other).collect()}
    assert found == {"k": ("numeric", 0.0, "PASS"), "x": ("numeric", 0.025, "PASS"), "t": ("categorical", 0.25, "FAIL")}


def test_fidelity_pct(sides):
    row = C.fidelity_pct(C.fidelity(sides[0], sides[1].withColumn("t", F.lit("a")))).first()
    assert (row["columns"], round(row["avg_gap"], 6), row["fidelity_pct"]) == (3, 0.091667, 82.0)


def test_sample_by_target(spark):
    rows = [(float(i), ["lo", "mid", "hi"][i // 100], float(i % 7)) for i in range(300)]
    df = dealt(spark.createDataFrame(rows, "y double, band string, z double"))
    made = S.sample_by_target(df, "y", ["band"], ["z"], 200, 7).collect()
    assert len(made) == 200 and {r["band"] for r in made} == {"lo", "mid", "hi"}
    assert all(0 <= r["y"] <= 299 and 0 <= r["z"] <= 6 for r in made)


def test_variance_driver(sides):
    df = sides[0].withColumn("half", F.when(F.col("x") < 20, "lo").otherwise("hi"))
    row = D.variance_driver(df, "x", ["t", "half"]).first()
    # both halves lie 10 from the middle
    assert row["column"] == "half" and row["share"] == pytest.approx(100 / np.var(np.arange(40), ddof=1))


def test_privacy_audit(spark, tmp_path):
    rows = [(i, i % 17, "FOP"[i % 3], 1000.0 + 37.5 * (i * i % 101) + i / 64, f"{1 + i % 5}-P") for i in range(400)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = entry.queries()["privacy_audit"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["privacy_audit"])
    assert found.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, found.collect())) == sorted(cur.fetchall())
