"""Generation and the comparison of large tables: what is shuffled, drawn and written."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES
from veilwork.operators import compare as C
from veilwork.operators import frames
from veilwork.operators import synth as S
from veilwork.operators import validate as V
from veilwork.session import cut_lineage


@pytest.fixture
def written(spark, monkeypatch, tmp_path):
    """The rows of each table that is written while a test runs."""
    monkeypatch.setattr("veilwork.session.shared_folder", lambda _spark: str(tmp_path))

    def rows():
        out = {}
        for folder in tmp_path.iterdir():
            out[folder.name] = sum(pq.read_metadata(f).num_rows for f in folder.glob("*.parquet"))
        return out

    return rows


def table(spark, n=2000):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), "ab"[i % 2]) for i, (x, y) in enumerate(zip(rng.normal(50, 9, n), rng.gamma(2.0, 3.0, n)))]
    return cut_lineage(spark.createDataFrame(rows, "k long, x double, y double, t string"))


def test_copies_are_dropped_without_a_shuffle_of_rows(spark):
    """Only hashes are shuffled where few rows have an equal one on the other side."""
    df = table(spark)
    made = cut_lineage(df.withColumn("x", F.when(F.col("k") % 50 == 0, F.col("x")).otherwise(F.col("x") + 1000)))
    kept = C.drop_copies(df, made, ["x", "y", "t"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert sorted(r["k"] for r in kept.collect()) == [i for i in range(2000) if i % 50]
    row = C.exact_copy_rate(df.drop("k"), made.union(made).drop("k")).first()
    assert (row["copies"], row["rows"], row["rate"]) == (80, 4000, 0.02)
    assert tuple(C.exact_copy_rate(df, made.where("k < 0")).first()) == (0, 0, 0.0)


def test_equal_hashes_are_no_copies(spark, monkeypatch):
    """Rows are compared in full: one hash for all of them drops and counts no other rows."""
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    o = spark.createDataFrame([(1, "a"), (None, None), (2, "b"), (2, "b")], "x int, t string")
    s = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (None, "a"), (2, "b"), (2, "b")], "x int, t string")
    assert sorted(map(tuple, C.drop_copies(o, s).collect()), key=str) == [(1, "b"), (None, "a")]
    assert tuple(C.exact_copy_rate(o, s).first())[:2] == (4, 6)


def test_generation_draws_as_many_rows_as_it_needs(spark, written):
    """Nearly all rows are accepted, so the first round does not draw half as many again."""
    df = table(spark)
    made = S.generate(df, 1000, 7, key="k")
    drawn = [n for n in written().values() if 1000 <= n < 1600]
    assert made.count() == 1000 and drawn and max(drawn) <= 1100


def test_a_step_may_not_be_enough(spark, monkeypatch):
    """Half of the drawn rows are refused: the steps of a round go on, and the rows are the first ones accepted."""
    df, seen = table(spark), []
    real, draw = V.validate, S.draw_rows
    monkeypatch.setattr(V, "validate", lambda *a, **k: real(*a, **k).where("row_id % 2 = 1"))
    monkeypatch.setattr(S, "draw_rows", lambda s, m, n, seed, start, *a: seen.append((start, n)) or draw(s, m, n, seed, start, *a))
    ids = [r["row_id"] for r in S.generate(df, 400, 7, key="k").orderBy("row_id").collect()]
    assert ids == list(range(1, 800, 2))
    assert [a + n for a, n in seen[:-1]] == [a for a, _ in seen[1:]] and sum(n for _, n in seen) <= 608 + 2 * 104 + 8


def test_ranges_are_redrawn_by_small_methods(spark):
    """The formulas of many columns stay below the 8,000 bytes of a method that the JVM compiles."""
    names = [f"c{i}" for i in range(8)]
    df = cut_lineage(spark.range(1000).select(F.col("id").alias("k"), *[(F.col("id") * 1.5).alias(c) for c in names]))
    marks = [float(i) for i in range(1, 16)]
    limits = spark.createDataFrame([(c, "range", 0.0, 300.0) for c in names], "column string, kind string, lo double, hi double")
    profile = spark.createDataFrame([(c, 0.0, 300.0, *marks) for c in names], ["column", "min", "max", *PROB_NAMES])
    out = V.repair_ranges(df, limits, profile, "k", 3)
    plain = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out.select("*")._jdf.queryExecution().executedPlan()
        debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        sizes, found = [], debug.codegenStringSeq(plan).iterator()
        while found.hasNext():
            sizes.append(found.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", plain)
    assert all(n < 8000 for n in sizes)
    got = {r["k"]: r for r in out.collect()}
    assert got[100]["c0"] == 150.0 and all(0 <= got[k][c] <= 300 for k in (201, 999) for c in names)
    assert len({got[k]["c0"] for k in range(201, 1000)}) > 700


def test_ks_streams_the_sorted_values(spark, written, monkeypatch):
    """The gap of scipy's formula, over values that come in many chunks; no sorted values are written."""
    monkeypatch.setattr(frames, "TASK_ROWS", 150)
    monkeypatch.setattr(frames, "CHUNK_BYTES", 400)
    rng = np.random.default_rng(3)
    sides = [np.round(rng.normal(0, 1, 900), 1), np.round(rng.normal(0.2, 1.2, 1100), 1)]
    tables = [
        spark.createDataFrame([(float(v), None if i % 3 else 5.0, None) for i, v in enumerate(a)], "v double, c double, e double").repartition(3)
        for a in sides
    ]
    got = {r["column"]: r["ks"] for r in C.ks_statistic(*tables).collect()}
    at = np.unique(np.concatenate(sides))
    share = [np.searchsorted(np.sort(a), at, "right") / len(a) for a in sides]
    assert got == {"v": pytest.approx(np.abs(share[0] - share[1]).max(), abs=1e-15), "c": 0.0}
    assert len(written()) == 1


def test_copula_draws_as_many_rows_as_it_needs(spark, written):
    """Both tables of ``generate_class_means`` are drawn in steps, and the classes keep their shares."""
    df = table(spark).withColumn("band", F.when(F.col("x") < 45, "low").when(F.col("x") < 55, "mid").otherwise("high"))
    df = df.withColumn("u", F.when(F.col("k") % 3 == 0, "p").otherwise("q"))
    made = S.generate(df, 1000, 7, key="k", method="copula")
    share = lambda t: {r["band"]: r["count"] / t.count() for r in t.groupBy("band").count().collect()}
    was, got = share(df), share(made)
    assert was.keys() == got.keys() and all(abs(was[b] - got[b]) < 0.05 for b in was)
    drawn = [n for n in written().values() if 1000 <= n < 1600]
    assert drawn and max(drawn) <= 1100
