"""Ordering, quantiles, skewed joins and draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions.draws import normal, uniform
from veilwork.functions.numeric import entropy_bits, normal_cdf, probit
from veilwork.functions.sizing import estimated_bytes, spread_small
from veilwork.operators import frames as R
from veilwork.operators.profile import number_counts, profile_numeric


def test_uniform_is_even_and_partition_free(spark):
    a = spark.range(0, 40000, 1, 2).select("id", uniform(F.col("id"), 3, "a").alias("u"), uniform(F.col("id"), 3, "b").alias("v"))
    b = spark.range(0, 40000, 1, 7).select("id", uniform(F.col("id"), 3, "a").alias("u"))
    x = a.orderBy("id").toPandas()
    assert np.array_equal(x["u"].to_numpy(), b.orderBy("id").toPandas()["u"].to_numpy())
    assert 0 < x["u"].min() and x["u"].max() < 1
    counts, _ = np.histogram(x["u"], bins=20, range=(0, 1))
    assert ((counts - 2000) ** 2 / 2000).sum() < 50
    assert abs(np.corrcoef(x["u"], x["v"])[0, 1]) < 0.02
    assert abs(np.corrcoef(x["u"][:-1], x["u"][1:])[0, 1]) < 0.02


def test_uniform_tells_far_ids_apart(spark):
    p = 2147483647
    ids = spark.createDataFrame([(5,), (5 + p,), (5 + 2 * p,)], "id long")
    rows = ids.select(*[uniform(F.col("id"), 1, s).alias(s) for s in "abcd"]).collect()
    assert len({tuple(r) for r in rows}) == 3


def test_normal_and_its_functions(spark):
    z = spark.range(20000).select(normal(F.col("id"), 1, "z").alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    p = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p")).select("p", normal_cdf(probit(F.col("p"))).alias("q")).toPandas()
    assert np.abs(p["p"] - p["q"]).max() < 1e-6


def test_entropy_bits(spark):
    row = spark.createDataFrame([("abcd", "aaaa", "aab")], "a string, b string, c string").select(
        *[entropy_bits(F.col(c)).alias(c) for c in "abc"]
    ).first()
    assert row["a"] == pytest.approx(2.0) and row["b"] == 0.0
    assert row["c"] == pytest.approx(-(2 / 3) * np.log2(2 / 3) - (1 / 3) * np.log2(1 / 3))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=700), np.full(400, 0.25), rng.exponential(size=301)])
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(x)], "x double, g string")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    counts = df.groupBy("g", F.col("x").alias("value")).agg(F.count("*").alias("n"))
    got = {r["g"]: r for r in R.exact_quantiles(counts, ["g"], probs).collect()}
    for g, keep in (("a", lambda i: i % 3), ("b", lambda i: not i % 3)):
        part = np.array([v for i, v in enumerate(x) if keep(i)])
        assert np.allclose(got[g]["q"], np.quantile(part, probs))
        assert got[g]["total"] == len(part) and got[g]["distinct"] == len(set(part))


def test_profile_equals_numpy(spark, folder):
    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    names = ["l_quantity", "l_extendedprice"]
    values = li.select(*names).toPandas()
    for r in profile_numeric(li, names).collect():
        assert np.allclose([r["q35"], r["q99"]], np.quantile(values[r["column"]], [0.35, 0.99]))


def test_running_totals(spark):
    rows = [(f"g{i % 3}", i * 7 % 101, i % 5 + 1) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, v long, w long").repartition(5)
    got = R.running_totals(df, ["g"], ["v"], ["w"]).collect()
    for r in got:
        assert r["before_w"] == sum(w for g, v, w in rows if g == r["g"] and v < r["v"])


def test_spread_join_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(R, "fits", lambda df, limit: False)
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = sorted(map(tuple, R.spread_join(left, right, ["k"], how).collect()), key=str)
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
        assert got == want


def test_rising_columns(spark):
    df = spark.range(0, 1000, 1, 6).select(
        "id", (F.col("id") * 2).alias("up"), (F.col("id") % 10).alias("saw"), F.floor(F.col("id") / 10).alias("steps")
    ).repartition(4)
    got = {r["column"]: r["rising"] for r in R.rising_columns(df, "id", ["up", "saw", "steps"]).collect()}
    assert got == {"up": True, "saw": False, "steps": True}


def test_number_counts_ignore_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (1.0,)], "x double")
    assert [tuple(r) for r in number_counts(df).collect()] == [("x", 1.0, 2)]


def test_estimates_need_no_job(spark, folder):
    assert estimated_bytes(spark.read.parquet(f"{folder}/lineitem.parquet")) > 10_000


def test_small_tables_are_dealt_without_a_sort(spark, tmp_path):
    # one file that one task reads; equal rows are spread too, and no column is lost
    made = spark.range(4_000).select((F.col("id") % 3).alias("id"), F.lit("x").alias("_Place"), F.when(F.col("id") % 2 == 0, 1.5).alias("v"))
    made.coalesce(1).write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    dealt = spread_small(read)
    # dealing in turn sorts all rows of a task before its shuffle
    assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.schema == read.schema and dealt.exceptAll(read).isEmpty() and dealt.count() == 4_000
    cores = spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) < 2 * 4_000 / cores
    assert spread_small(read, 0) is read


def test_running_totals_of_uneven_groups(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    rows = [("big" if i % 10 else f"g{i % 70}", float(v), int(n), float(n) / 3) for i, (v, n) in enumerate(zip(rng.normal(size=6000), rng.integers(1, 9, 6000)))]
    df = spark.createDataFrame([*rows, (None, 1.0, 5, 1.0)], "g string, value double, n long, p double").repartition(5)
    out = R.running_totals(df, ["g"], ["value"], ["n", "p"], totals=True)
    got = out.toPandas().sort_values(["g", "value"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["g", "value", "n", "p"]).sort_values(["g", "value"]).reset_index(drop=True)
    by = want.groupby("g")
    assert len(got) == len(want)  # a null group is left out
    assert (got["before_n"] == by["n"].cumsum() - want["n"]).all() and (got["total_n"] == by["n"].transform("sum")).all()
    assert np.allclose(got["before_p"], by["p"].cumsum() - want["p"])
    # the rows are neither sorted a second time nor gathered by their group
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_quantiles_hold_at_most_a_task_s_rows(spark, monkeypatch):
    # values that lie in several chunks and partitions, both zeros, null and NaN; the sort is dealt by the number of rows
    monkeypatch.setattr(R, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(R, "TASK_ROWS", 400)
    cells = [float(i * 7919 % 1000) / 8 for i in range(3_000)] + [0.0, -0.0] * 600 + [None, float("nan")]
    df = spark.createDataFrame([(x, "a" if i % 3 else None, 1.0) for i, x in enumerate(cells)], "v double, g string, flat double").repartition(5)
    pieces = R.piece_counts(df, ["v", "flat"])
    assert pieces.groupBy("column").agg(F.sum("n").alias("n")).where("column = 'v'").first()["n"] == 4_200
    got = {r["column"]: r for r in R.exact_quantiles(pieces, ["column"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    known = np.array([x for x in cells if x is not None and not np.isnan(x)])
    assert got["v"]["total"] == 4_200 and got["v"]["distinct"] == 1_000
    assert np.allclose(got["v"]["q"], np.quantile(known, [0.0, 0.1, 0.5, 0.99, 1.0]))
    assert (got["flat"]["total"], got["flat"]["distinct"], list(got["flat"]["q"])) == (4_202, 1, [1.0] * 5)
    placed = R.running_totals(pieces, ["column"], ["value"], ["n"], totals=True, merge=True)
    rows = placed.where("column = 'v'").orderBy("value").collect()
    assert [r["before_n"] for r in rows] == [int((known < r["value"]).sum()) for r in rows] and {r["total_rows"] for r in rows} == {1_000}
    stored = R.cut_lineage(pieces)
    most = stored.repartitionByRange(R.task_count(stored), "column", "value").groupBy(F.spark_partition_id()).count().agg(F.max("count")).scalar()
    assert spark.range(1).select(most).first()[0] < 1_200 and R.task_count(stored) >= 7
    by_group = {r["g"]: r for r in R.exact_quantiles(R.piece_counts(df, ["v"], ["g"], tag=None), ["g"], [0.5]).collect()}
    assert list(by_group) == ["a"] and by_group["a"]["total"] == sum(1 for i, x in enumerate(cells) if i % 3 and x is not None and not np.isnan(x))


def test_text_counts_come_once_per_value(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 500)
    df = spark.createDataFrame([("x" * 200 if i % 2 else f"t{i % 5}", i % 4) for i in range(900)], "t string, k int").repartition(6)
    counts = {(r["column"], r["value"]): r["n"] for r in R.whole_counts(R.cut_lineage(R.piece_counts(df, ["t", "k"], text=True))).collect()}
    assert sum(n for (c, _), n in counts.items() if c == "t") == 900 and len(counts) == 6 + 4
    assert max(len(v) for _, v in counts) == 64 and counts[("k", "3")] == 225


def test_copies_are_compared_in_full(spark):
    from veilwork.operators.compare import drop_copies

    known = spark.createDataFrame([(1, None, 2.00001), (2, "b", None), (2, "b", None)], "a int, b string, c double")
    made = spark.createDataFrame([(1, None, 2.0), (1, "x", 2.0), (2, "b", None), (None, None, None), (None, None, None)], "a int, b string, c double")
    assert sorted(map(tuple, drop_copies(known, made).collect()), key=str) == [(1, "x", 2.0), (None, None, None), (None, None, None)]


def test_far_leaves_are_not_looked_at():
    # the same leaves as all boxes would give, at a cost that grows with the depth of the tree
    from veilwork.operators.nearest import Tree

    draw = np.random.default_rng(3)
    tree = Tree(draw.normal(size=(8_000, 3)), 3, 500)
    x, d2 = draw.normal(size=(3_000, 3)), draw.uniform(0, 0.3, 3_000)
    d2[:20] = np.inf
    row, leaf = tree.within(x, d2)
    ends = np.flatnonzero(tree.column < 0)
    low, high = tree.low[ends], tree.high[ends]
    gap = sum(np.maximum(0, np.maximum(low[:, c] - x[:, c, None], x[:, c, None] - high[:, c])) ** 2 for c in range(3))
    at, box = np.nonzero(gap <= d2[:, None] * (1 + 1e-12))
    assert set(zip(row.tolist(), leaf.tolist())) == set(zip(at.tolist(), tree.left[ends][box].astype(int).tolist())) and len(row) == len(at)
    assert (tree.leaf(x)[:, None] == np.arange(500)).any() and len(ends) == 500
    assert len(tree.within(np.zeros((0, 3)), np.zeros(0))[0]) == 0
