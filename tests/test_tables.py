"""Comparison, audit, gates, validation, generation, sources, history and streams on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions.draws import uniform
from veilwork.operators import association as A
from veilwork.operators import audit as R
from veilwork.operators import compare as C
from veilwork.operators import conditional as K
from veilwork.operators import edit as E
from veilwork.operators import frames as FR
from veilwork.operators import graph as G
from veilwork.operators import history as H
from veilwork.operators import metrics as M
from veilwork.operators import profile as P
from veilwork.operators import synth as S
from veilwork.operators import typing as Y
from veilwork.operators import validate as V
from veilwork.sources import runs as U
from veilwork.sources import tables as B


@pytest.fixture(scope="module")
def mixed(spark):
    """500 rows: whole ages and scores, clipped normals, exponentials and three categories."""
    u = lambda s: uniform(F.col("id"), 2026, s)
    df = spark.range(500).select(
        (18 + F.floor(u("age") * 67)).cast("double").alias("age"),
        F.greatest(F.lit(10000.0), 65000 + 18000 * F.sqrt(-2 * F.log(u("i1"))) * F.cos(2 * np.pi * u("i2"))).alias("income"),
        (300 + F.floor(u("credit") * 550)).cast("double").alias("credit_score"),
        F.least(F.lit(100000.0), F.greatest(F.lit(1000.0), -15000 * F.log(u("loan")))).alias("loan_amount"),
        F.when(u("g") < 0.48, "M").when(u("g") < 0.96, "F").otherwise("Other").alias("gender"),
        F.when(u("r") < 0.25, "North").when(u("r") < 0.5, "South").when(u("r") < 0.75, "East").otherwise("West").alias("region"),
        F.when(u("s") < 0.6, "approved").when(u("s") < 0.85, "rejected").otherwise("pending").alias("status"),
    )
    return df.persist()


def test_end_to_end_scores_stay_in_range(spark, mixed):
    made = S.generate(mixed, 400, 11)
    plain = made.select(*mixed.columns)
    assert made.count() == 400 and made.select("row_id").distinct().count() == 400
    drift = C.column_drift(mixed, plain)
    assert all(0 <= r["drift"] <= 0.7 for r in drift.collect())
    limits = P.constraints(mixed)
    assert all(r["passed"] for r in C.range_adherence(limits, plain).collect())
    assert all(r["passed"] for r in C.category_adherence(limits, plain).collect())
    assert C.exact_copy_rate(mixed, plain).first()["copies"] == 0
    assert V.check_invariants(plain, mixed.columns, limits, 400).where(~F.col("passed")).count() == 0
    with pytest.raises(ValueError):
        S.fit(made)


@pytest.mark.parametrize("method", ["marginal", "copula"])
def test_other_methods(spark, mixed, method):
    made = S.generate(mixed, 120, 5, method=method)
    assert made.count() == 120
    assert V.count_out_of_range(made.select(*mixed.columns), P.constraints(mixed)).agg(F.sum("repaired")).first()[0] == 0


def test_generation_keeps_categories_tied_and_whole(spark):
    u = lambda name: uniform(F.col("id"), 3, name)
    x = 100 + 15 * F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * np.pi * u("b"))
    df = spark.range(3000).select((x + u("e")).alias("x"), (u("c") * 50).alias("y"), F.when(x > 100, "high").otherwise("low").alias("side"))
    was = A.cat_num_association(df, ["side"], ["x"]).first()["value"]
    got = A.cat_num_association(S.generate(df, 3000, 4, method="copula"), ["side"], ["x"]).first()["value"]
    assert abs(was) > 0.7 and abs(got) == pytest.approx(abs(was), abs=0.1)
    cities = spark.range(6000).select((F.col("id") * 1.5).alias("x"), F.concat(F.lit("city"), F.col("id") % 300).alias("city"))
    model = S.fit(cities, method="marginal", overrides={"city": "LOW_CARD_CATEGORICAL"})
    assert S.draw_rows(spark, model, 6000, 3).select("city").distinct().count() == 300
    assert S.bootstrap_independent(cities, 6000, 3).select("city").distinct().count() == 300
    assert S.sample_by_label(cities, "city", [], ["x"], 6000, 3).where("city IS NOT NULL AND x IS NOT NULL").select("city").distinct().count() == 300


def test_draws_do_not_depend_on_partitions(spark):
    rows = lambda parts: spark.range(0, 1000, 1, parts).withColumnRenamed("id", "row_id")
    model = S.fit(spark.range(300).select((F.col("id") % 7 * 1.5).alias("x"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y")), method="marginal")
    assert S.draw_rows(spark, model, 500, 3).exceptAll(S.draw_rows(spark, model, 900, 3).where("row_id < 500")).count() == 0
    a = S.sample_weighted(rows(2), {"c": (["x", "y", "z"], [0.2, 0.3, 0.5])}, 9)
    b = S.sample_weighted(rows(7), {"c": (["x", "y", "z"], [0.2, 0.3, 0.5])}, 9)
    assert a.exceptAll(b).count() == 0
    assert abs(a.where("c = 'z'").count() / 1000 - 0.5) < 0.06


def test_copula_keeps_a_correlation(spark):
    rows = S.copula_sample(S.new_rows(spark, 5000), {"a": [float(i) for i in range(17)], "b": [float(i * i) for i in range(17)]}, [0, 0], np.array([[1, 0.8], [0.8, 1]]), 3)
    pdf = rows.toPandas()
    assert 0.6 < np.corrcoef(pdf["a"].rank(), pdf["b"].rank())[0, 1] < 0.9
    assert pdf["a"].between(0, 16).all() and pdf["b"].between(0, 256).all()


def test_normal_scores_equal_ranks(spark):
    from statistics import NormalDist

    u = lambda s: uniform(F.col("id"), 8, s)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), F.round(u("x"), 2).alias("x"), (u("x") + 0.5 * u("y")).alias("y")
    )
    names = ["x", "y"]
    fitted = S.copula_matrices(S.copula_fit(df, names, "c"), names)
    pdf = df.toPandas()
    assert set(fitted) == {"a", "b"}
    for k, part in pdf.groupby("c"):
        z = (part[names].rank() / len(part)).clip(1e-6, 1 - 1e-6).map(NormalDist().inv_cdf)
        want = np.cov(z.T)
        want[0, 1] *= 1 - 2 / (len(part) - 3)
        assert np.allclose(fitted[k][1], [[want[0, 0], want[0, 1]], [want[0, 1], want[1, 1]]], atol=1e-4)


def test_null_patterns(spark):
    rows = S.new_rows(spark, 4000).withColumn("a", F.lit(1.0)).withColumn("b", F.lit("x"))
    out = S.inject_nulls(rows, {"a": 0.3, "b": 0.3}, 4, np.array([[1, 0.9], [0.9, 1]]), ["a", "b"]).toPandas()
    assert abs(out["a"].isna().mean() - 0.3) < 0.04
    assert (out["a"].isna() == out["b"].isna()).mean() > 0.85


def test_dependency_order_cuts_the_weakest_link():
    order, cut = S.dependency_order({"a": "b", "b": "a", "c": "a"}, {"a": 0.5, "b": 0.4, "c": 0.9})
    assert cut == ["b"] and order == ["a", "c"]


def test_first_rows(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "row_id")
    got = S.first_rows(df, 700, width=50)
    assert got.count() == 700 and got.agg(F.max("row_id")).first()[0] == 699 * 3
    assert S.first_rows(df, 10**6, width=50).count() == df.count()


def test_unique_identifier_ranks_first(spark):
    rows = [(f"U{i:04d}", 22 + i % 43, 30000 + i * 1800, ["A", "B", "C"][i % 3]) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id string, age long, income long, city string")
    risk = {r["column"]: r["risk"] for r in R.reidentification_risk(df).collect()}
    assert risk["user_id"] > 0.8 and risk["user_id"] == max(risk.values())


def test_one_outlier(spark):
    rows = [(25 + i, 10_000_000 if i == 15 else 50000 + 500 * i, 75.0) for i in range(30)]
    got = R.outlier_exposure(spark.createDataFrame(rows, "age long, income long, score double")).collect()
    assert [(r["column"], r["direction"], r["value"], r["severity"]) for r in got] == [("income", "high", 1e7, "critical")]


def test_constant_columns_do_not_break_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 5.0)], "a double, b double, c double")
    assert [(r["col_a"], r["col_b"]) for r in A.pearson_pairs(df).collect()] == [("b", "c")]


def test_js_properties(spark, mixed):
    other = mixed.withColumn("income", F.col("income") * 1.3).withColumn("region", F.when(F.col("region") == "West", "East").otherwise(F.col("region")))
    same = C.column_drift(mixed, mixed).collect()
    assert all(abs(r["drift"]) < 1e-6 for r in same)
    ab = {r["column"]: r["js"] for r in C.js_numeric(mixed, other).collect()}
    ba = {r["column"]: r["js"] for r in C.js_numeric(other, mixed).collect()}
    assert ab["income"] > 0.01 and all(ab[c] == pytest.approx(ba[c]) for c in ab)
    ks = {r["column"]: r["ks"] for r in C.ks_statistic(mixed, other).collect()}
    a, b = (np.sort(d.select("income").toPandas()["income"]) for d in (mixed, other))
    grid = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, grid, "right") / 500 - np.searchsorted(b, grid, "right") / 500).max()
    assert ks["income"] == pytest.approx(want)


def test_copies_with_nulls_and_repeats(spark):
    o = spark.createDataFrame([(1.00001, None), (2.0, "b")], "x double, y string")
    s = spark.createDataFrame([(1.00002, None)] * 50 + [(2.0, None), (2.0, "b")], "x double, y string")
    assert C.exact_copy_rate(o, s).first()["copies"] == 51
    assert [tuple(r) for r in C.drop_copies(o, s).collect()] == [(2.0, None)]


def test_draws_from_counts_far_above_the_rows(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 100_000_000), ("c", 1), ("d", 300_000_000)], "t string, n long")
    rows = spark.range(20_000).withColumnRenamed("id", "row_id").withColumn("t2", F.lit("x"))
    got = {r["t"]: r["n"] for r in S.draw_counted(rows, counts, "t", 400_000_006, 3).groupBy("t").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 20_000 and abs(got["b"] / 20_000 - 0.25) < 0.02 and got.get("a", 0) < 5


def test_range_lookup_against_brute_force(spark):
    import bisect

    starts = [0, 3, 4, 10, 11, 50, 51]
    ranges = spark.createDataFrame([(s, f"v{s}") for s in starts], "at long, v string").repartition(3)
    asked = [(i, (i * 37) % 60 if i % 3 else 50) for i in range(400)]
    rows = spark.createDataFrame(asked, "k long, s long").repartition(7)
    got = {r["k"]: r["v"] for r in FR.range_lookup(rows, "s", ranges, "at", "v").collect()}
    assert got == {k: f"v{starts[bisect.bisect_right(starts, s) - 1]}" for k, s in asked}


def test_nearest_rows_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 3)), rng.normal(size=(400, 3))
    A_ = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "k long, x double, y double, z double")
    B_ = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "k long, x double, y double, z double").repartition(5)
    got = {r["probe"]: r["dist"] for r in R.nearest_rows(A_, B_, ["x", "y", "z"], [1.0] * 3, "k", "k").collect()}
    d = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(-1))
    assert np.allclose([got[i] for i in range(60)], d.min(1))
    self_free = R.nearest_rows(A_, A_, ["x", "y", "z"], [1.0] * 3, "k", "k", exclude_self=True).collect()
    assert min(r["dist"] for r in self_free) > 0
    assert R.sample_rows(B_, "k", None, 1).count() == 400 and R.sample_rows(B_, "k", 7, 1).count() == 7


@pytest.mark.parametrize("leaf_rows, probes", [(4000, 50_000), (20, 30)])
def test_nearest_rows_of_whole_tables(spark, monkeypatch, leaf_rows, probes):
    from veilwork.operators import nearest

    monkeypatch.setattr(nearest, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(nearest, "PROBES", probes)
    rng = np.random.default_rng(4)
    # few places, dense and empty regions, a third of all rows at one place, ties in distance
    pool = np.round(np.concatenate([rng.normal(size=(500, 2)), rng.normal(size=(150, 2)) * 0.01 + 5, np.zeros((350, 2))]), 1)
    ask = np.round(np.concatenate([rng.normal(size=(150, 2)) * 2, np.full((100, 2), 5.0), np.full((20, 2), 50.0)]), 1)
    P = spark.createDataFrame([(i, *map(float, r), f"l{i % 3}") for i, r in enumerate(pool)], "k long, x double, y double, t string")
    Q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(ask)], "k long, x double, y double")

    def best(a, own):
        d = ((a[:, None, 0] - pool[None, :, 0]) ** 2) + ((a[:, None, 1] - pool[None, :, 1]) ** 2)
        if own:
            d[np.arange(len(a)), np.arange(len(a))] = np.inf
        at = d.argmin(1)
        return {i: (round(float(np.sqrt(d[i, j])), 9), int(j), f"l{j % 3}") for i, j in enumerate(at)}

    for df, a, own in ((Q, ask, False), (P, pool, True)):
        rows = R.nearest_rows(df, P, ["x", "y"], [1.0, 1.0], "k", "k", exclude_self=own, label=F.col("t")).collect()
        assert {r["probe"]: (round(r["dist"], 9), r["key"], r["label"]) for r in rows} == best(a, own)
    assert R.nearest_rows(Q, P.limit(0), ["x", "y"], [1.0, 1.0], "k", "k").count() == 0
    assert R.nearest_rows(Q.limit(0), P, ["x", "y"], [1.0, 1.0], "k", "k").count() == 0


def test_whole_table_audits_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    o = np.round(np.concatenate([rng.normal(size=(300, 2)), np.ones((100, 2))]), 2)
    s = np.round(np.concatenate([rng.normal(size=(150, 2)) + 0.3, o[:50]]), 2)
    tag = lambda a: ["hi" if r[0] > 0.2 else "lo" if r[1] > 0 else None for r in a]
    schema = "k long, x double, y double, t string"
    O = spark.createDataFrame([(i, *map(float, r), t) for i, (r, t) in enumerate(zip(o, tag(o)))], schema)
    S = spark.createDataFrame([(i, *map(float, r), t) for i, (r, t) in enumerate(zip(s, tag(s)))], schema)
    scale = o.std(axis=0)
    d = lambda a, b, c: np.sqrt((((a[:, None] - b[None]) / c) ** 2).sum(-1))
    own = d(o, o, scale)
    np.fill_diagonal(own, np.inf)
    members, others = own.min(1), d(s, o, scale).min(1)
    limit = np.median(members)
    row = R.membership_accuracy(O, S, ["x", "y"], "k", "k").first()
    assert row["threshold"] == pytest.approx(limit) and row["accuracy"] == pytest.approx(((members <= limit).mean() + (others > limit).mean()) / 2)
    row = R.membership_proximity(O, S, ["x", "y"], "k", "k").first()
    assert row["above"] == pytest.approx((others > limit).mean())
    near = d(o, s, s.std(axis=0)).argmin(1)
    right = sum((tag(s)[j] or "__NA__") == (t or "__NA__") for j, t in zip(near, tag(o)))
    row = R.attribute_inference(O, S, "t", ["x", "y"], "k", "k").first()
    assert (row["probes"], row["correct"]) == (400, right) and row["baseline"] == pytest.approx(1 / 3)
    assert R.attribute_inference(O, S, "t", ["x", "y"], "k", "k", n=40).first()["probes"] == 40
    assert R.membership_accuracy(O.limit(0), S, ["x", "y"], "k", "k").first()["vulnerable"] is not True


def test_linear_fit_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] - x[:, 1] + 0.5 + 0.01 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    w, b = C.linear_fit(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.column_stack([x, np.ones(300)]), y, rcond=None)[0]
    assert np.allclose([*w, b], want, atol=1e-8)
    assert C.tstr_r2(df, df, "y").first()["r2"] > 0.99
    picked = C.tstr_r2(df, df).first()  # no name suggests a target: the last number
    assert picked["target"] == "y" and picked["r2"] > 0.99


def test_gate_fixtures(spark):
    run = spark.createDataFrame([("bad", 0.50, 0.80, 0.55, 0.9, 0.1, 0.3), ("good", 0.01, 0.80, 0.55, 0.9, 0.1, 0.3)], "run_id string, duplicates_rate double, privacy_score double, membership_inference_auc double, acceptance_rate double, rejection_rate double, statistical_drift_score double")
    gate = {r["run_id"]: r["passed"] for r in M.leakage_gate(run).collect()}
    assert gate == {"bad": False, "good": True}
    failed = {(r["run_id"], r["check"]) for r in M.metric_gate(run).where(~F.col("passed")).collect()}
    assert failed == {("bad", "duplicates_rate")}
    decision = spark.createDataFrame([("a", True, True, True, 10, 5, 1, "h", True, "FAIL"), ("b", True, True, True, 10, 5, 1, "h", True, "WARN"), ("c", False, True, True, 1, 5, None, "", True, "PASS")],
        "run_id string, invariants_passed boolean, metrics_valid boolean, no_contradictions boolean, rows int, min_rows int, seed int, config_hash string, leakage_passed boolean, verdict string")
    got = {r["run_id"]: (r["released"], r["clauses_met"]) for r in M.release_decision(decision).collect()}
    assert got == {"a": (False, 6), "b": (True, 6), "c": (False, 2)}


def test_invariants_refuse_nan_and_missing_columns(spark):
    good = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, "b")], "a double, b double, label string")
    limits = P.constraints(good)
    nan = spark.createDataFrame([(float("nan"), 2.0, "a")], "a double, b double, label string")
    bad = {(r["check"], r["column"]) for r in V.check_invariants(nan, good.columns, limits).where(~F.col("passed")).collect()}
    assert bad == {("NO_NAN", "a")}
    bad = {(r["check"], r["column"]) for r in V.check_invariants(good.drop("b"), good.columns, limits).where(~F.col("passed")).collect()}
    assert bad == {("SCHEMA_MATCH", "b")}


def test_collapse_is_found(spark):
    same = spark.range(500).select(F.lit(1.0).alias("age"), F.lit(2.0).alias("income"), F.lit(3.0).alias("score"))
    assert C.unique_row_ratio(same).first()["ratio"] == pytest.approx(0.002)
    one = spark.range(500).select(F.when(F.col("id") == 0, "other").otherwise("active").alias("status"))
    assert C.entropy_diversity(one).first()["collapsed"]


def test_rules(spark):
    df = spark.createDataFrame([(5, 3, "x", 50.0), (1, 3, "y", 50.0), (None, 3, "x", None)], "a int, b int, c string, d double")
    rules = [{"type": "comparison", "left": "a", "op": "<", "right": "b"}, {"type": "conditional", "when": {"column": "c", "equals": "x"}, "then": {"column": "d", "max": 10}}]
    assert [r["violations"] for r in V.count_violations(df, rules).orderBy("rule").collect()] == [1, 1]
    assert [tuple(r) for r in V.enforce_rules(df, rules).collect()] == [(2, 3, "x", 10.0), (1, 3, "y", 50.0), (None, 3, "x", None)]
    clash = [{"type": "comparison", "left": "a", "op": "<", "right": "b"}, {"type": "comparison", "left": "a", "op": ">", "right": "b"}]
    with pytest.raises(ValueError):
        V.enforce_rules(df, clash)


def test_two_failures_reject(spark):
    flags = spark.createDataFrame([(True, False, False), (True, True, False), (False, False, False)], "iqr_outlier boolean, joint_outlier boolean, class_outlier boolean")
    assert [r["accepted"] for r in V.accept_rows(flags).collect()] == [True, False, True]
    assert [r["accepted"] for r in V.accept_rows(flags, 0).collect()] == [False, False, True]


def test_types(spark):
    rows = [(f"{i:032x}", f"a{i}@x.org", float(i), i % 3, "some words in a row " + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "token string, mail string, n double, d int, note string")
    got = {r["column"]: r for r in Y.classify_columns(Y.column_facts(df)).collect()}
    assert got["mail"]["type"] == "HIGH_CARD_CATEGORICAL" and got["mail"]["pattern"] == "email"
    assert got["d"]["type"] == "DISCRETE_NUMERIC" and got["note"]["type"] == "FREE_TEXT" and got["n"]["type"] == "CONTINUOUS_NUMERIC"
    chosen = lambda t: [r["column"] for r in C.target_columns(t).orderBy("choice").collect()]
    assert chosen(df.withColumnRenamed("n", "price")) == ["price", "d"] and chosen(df) == ["d", "n"] and chosen(df.select("mail")) == []


def test_text_shapes_are_searched_once_a_value(spark):
    """Facts come from distinct short texts; odd doubles count as their texts do."""
    rows = [("1.5", 0.0), ("1.5", -0.0), ("a b c", 0.001), ("", 0.0009999999999), ("x y " * 40, 1e-12), ("x y " * 40, 2e-12), (None, 1e7), ("12", 5.5), ("12", float("nan")), ("12", None)]
    facts = Y.column_facts(spark.createDataFrame(rows, "t string, d double"))
    got = {r["column"]: r for r in facts.collect()}
    assert (got["t"]["n_valid"], got["t"]["distinct"], got["d"]["distinct"]) == (9, 5, 6)
    assert got["t"]["number_share"] == pytest.approx(5 / 9) and got["t"]["mean_tokens"] == pytest.approx((2 + 3 + 0 + 160 + 3) / 9)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    shapes = [line for line in plan.split("\n") if "RLIKE" in line]
    # of all rows only cells too long to group by are searched; the rest is searched in the result of the grouping
    assert shapes and all("Aggregate [column" in line or "Project [column" in line for line in shapes)


def test_shrinkage_sums_to_one(spark, mixed):
    f = K.class_freq(mixed, "status", ["region", "gender"]).groupBy("label", "column").agg(F.sum("p").alias("p")).collect()
    assert len(f) == 6 and all(r["p"] == pytest.approx(1.0) for r in f)


def test_k_anonymity(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 9.0)], "c string, x double")
    r = R.k_anonymity(df).first()
    assert (r["min_k"], r["total_groups"], r["severity"]) == (1, 2, "critical")


def test_sources(spark, tmp_path):
    assert B.dedupe_header(["a", "", "a", "a", ""]) == ["a", "unnamed", "a_2", "a_3", "unnamed_2"]
    with pytest.raises(ValueError):
        B.read_table(spark, "x.xlsx")
    doc = tmp_path / "d.json"
    doc.write_text(json.dumps({"meta": 1, "data": {"rows": [{"a": 1}, {"a": 2}]}, "list": [1, 2, 3]}))
    rows, _ = B.read_json_records(spark, str(doc), ["data", "rows"], lines=False)
    assert [r["a"] for r in rows.collect()] == [1, 2]
    rows, _ = B.read_json_records(spark, str(doc), lines=False)
    assert [r["value"] for r in rows.collect()] == [1, 2, 3]
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"a": 1}\n{"a": oops\n{"a": 3}\n')
    good, bad = B.read_json_records(spark, str(lines))
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert [r[0] for r in bad.collect()] == ['{"a": oops']
    lines = tmp_path / "s.jsonl"
    lines.write_text("5\nnope\n7\n")
    good, bad = B.read_json_records(spark, str(lines))
    assert (sorted(r["value"] for r in good.collect()), bad.count()) == ([5, 7], 1)
    doc.write_text("[[1, 2],\n [3]]")
    rows, _ = B.read_json_records(spark, str(doc), [0], lines=False)
    assert [r["value"] for r in rows.collect()] == [1, 2]
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, "two\nlines"), (3, None), (4, "")], "id int, t string")
    B.write_table(df, str(tmp_path / "o.csv"), "csv")
    back = B.read_table(spark, str(tmp_path / "o.csv"), schema=df.schema, multiline=True)
    # csv writes null and empty text alike, so both come back as null
    assert sorted(map(tuple, back.collect())) == [(1, 'say "hi", you'), (2, "two\nlines"), (3, None), (4, None)]
    a, b = B.content_fingerprint(df).first(), B.content_fingerprint(df.repartition(3).orderBy(F.desc("id"))).first()
    assert a == b and a != B.content_fingerprint(df.withColumn("t", F.coalesce("t", F.lit("")))).first()
    assert len(B.schema_hash(df).first()[0]) == 64


def test_repeated_commit_does_not_double(spark, tmp_path):
    part = spark.range(10).withColumn("run_id", F.lit("r")).withColumn("round", F.lit(1))
    for _ in range(2):
        U.commit_rows(part, str(tmp_path / "c"))
    U.commit_rows(part.withColumn("round", F.lit(2)), str(tmp_path / "c"))
    want = spark.createDataFrame([("r", 40)], "run_id string, requested long")
    r = U.run_status(spark, str(tmp_path / "c"), want).first()
    assert (r["rows"], r["rounds"], r["progress"], r["complete"]) == (20, 2, 50.0, False)


def test_edits(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "k int, v double")
    assert [r["k"] for r in E.delete_where(df, "v > 20").collect()] == [1, 2]
    ids = spark.createDataFrame([(2,), (2,)], "k int")
    assert [r["k"] for r in E.delete_rows(df, ids, "k").orderBy("k").collect()] == [1, 3]
    assert [r["k"] for r in E.keep_rows(df, ids, "k").collect()] == [2]


def test_graph_and_entities(spark):
    found = {r["column"]: r["entity"] for r in G.column_entities(spark, ["event_id", "event_type", "user_id", "value"]).collect()}
    assert found == {"event_id": "event", "event_type": "event", "user_id": "customer", "value": None}


def test_drift_between_runs(spark):
    a = spark.range(300).select(F.lit("r1").alias("run"), (F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    b = spark.range(300).select(F.lit("r2").alias("run"), (1000 + F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    got = {r["column"]: r for r in H.compare_runs(H.snapshot(a.unionByName(b), "run")).collect()}
    assert got["x"]["critical"] and not got["c"]["drifted"] and got["c"]["js"] == 0.0


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    from veilwork.streaming import alerts as Z

    src = tmp_path / "in"
    t = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    first = spark.createDataFrame([(1, 0), (1, 60), (2, 7200)], "k int, s int").select("k", t(F.col("s")).alias("ts"))
    late = spark.createDataFrame([(3, 30), (2, 7260)], "k int, s int").select("k", t(F.col("s")).alias("ts"))
    first.coalesce(1).write.parquet(str(src / "a"))
    stream = lambda: spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = Z.run_available(Z.dedupe_alerts(stream(), ["k"]), "t1")
    assert sorted(r["k"] for r in out.collect()) == [1, 2]
    late.coalesce(1).write.parquet(str(src / "b"))
    windows = Z.run_available(Z.alert_rate(stream(), [], width="1 hour"), "t2").collect()
    assert sum(r["n"] for r in windows) <= 3 and all(r["n"] >= 1 for r in windows)


def test_close_records_against_all_pairs(spark):
    r = random.Random(5)
    names = ["a", "b", "c", "d"]
    kind = ", ".join(f"{n} double" for n in names)
    known = [tuple(r.choice([None, 0.0, r.gauss(0, 1), r.randint(0, 3) * 100.0]) for _ in names) for _ in range(300)] + [(1.0, 2.0, 3.0, 4.0)] * 200
    made = [tuple(None if v is None else v + r.gauss(0, 0.3) for v in r.choice(known)) for _ in range(200)] + [(9e6, 0.0, None, 1.0), (1.0, 2.0, 3.0, 4.0)] * 50
    original, synthetic = spark.createDataFrame(known, kind), spark.createDataFrame(made, kind)
    a, b = (np.array([[v or 0.0 for v in row] for row in rows]) for rows in (made, known))
    scale = b.std(axis=0)
    near = np.sqrt((((a[:, None] - b[None]) / scale) ** 2).sum(axis=2)).min(axis=1)
    for threshold in (0.002, 0.02, 0.5):
        got = R.close_record_rate(original, synthetic, names, threshold).first()
        assert (got["probes"], got["close"]) == (len(made), int((near < threshold).sum()))
    assert 50 < (near < 0.002).sum() < (near < 0.02).sum() < len(made)
    assert R.close_record_rate(original.limit(0), synthetic, names).first()["close"] == 0
    assert R.close_record_rate(original, synthetic.limit(0), names).first()["rate"] == 0


def test_every_sensitive_column_gets_its_actions(spark):
    ranking = spark.createDataFrame([(f"c{i}", 1.0 - i / 100, 0.8, 0.9) for i in range(9)], "column string, score double, pii_score double, reid double")
    rows = R.governance_actions(ranking).collect()
    assert len(rows) == 18 and {r["column"] for r in rows} == {f"c{i}" for i in range(9)}
    assert {r["column"] for r in R.governance_actions(ranking, top=2).collect()} == {"c0", "c1"}
    profile = spark.createDataFrame([], "column string, distinct long, mean double, missing_ratio double")
    pairs = spark.createDataFrame([(f"a{i:02d}", "b", 0.6 + i / 100) for i in range(15)], "col_a string, col_b string, value double")
    card = lambda **more: G.dataset_card(spark.range(3), profile, pairs, **more).where("section = 'correlations'").collect()
    assert len(card()) == 15 and [r["item"] for r in card(correlations=1)] == ["a14 ~ b"]


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    from veilwork.plans import QUERIES
    from veilwork.streaming import alerts as Z

    rows = [(i, f"mail john.doe{i}@example.org\nname,email,ssn", "en", "web", 40) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    opened = QUERIES["stream_dataset_monitor"](spark, str(tmp_path)).where("type = 'Dataset file opened'")
    assert sorted(r["file"] for r in opened.collect()) == ["0", "1", "2", "3"]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "none"))
    assert Z.stream_dataset_monitor(empty, "doc_id", "text").count() == 0
