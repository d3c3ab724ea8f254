"""Target-driven generation: class means, shares, ties inside classes, and numeric targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.functions.draws import normal, normal_values, uniform
from veilwork.functions.numeric import normal_cdf, normal_cdf_values
from veilwork.operators import association as A
from veilwork.operators import frames as R
from veilwork.operators import synth as S
from veilwork.operators import targeted as G

METHODS = ["conditional", "copula"]


@pytest.fixture(scope="module")
def classes(spark):
    """Two classes with other means, other signs of the tie between x and y, other shares and whole numbers."""
    n = lambda name: normal(F.col("id"), 5, name)
    u = lambda name: uniform(F.col("id"), 5, name)
    up = u("side") < 0.4
    x = F.when(up, 10.0).otherwise(30.0) + n("x") * 3
    y = F.when(up, 0.8 * (x - 10.0)).otherwise(-0.8 * (x - 30.0)) + n("y") * 1.8
    shop = F.when(u("shop") < F.when(up, 0.8).otherwise(0.2), "north").otherwise("south")
    count = F.floor(u("count") * F.when(up, 4).otherwise(9)).cast("int")
    side = F.when(u("hole") < 0.05, None).when(up, "up").otherwise("down")
    return spark.range(4000).select(x.alias("x"), y.alias("y"), count.alias("items"), shop.alias("shop"), side.alias("side")).cache()


def facts(df):
    rows = df.where("side IS NOT NULL").groupBy("side").agg(
        F.avg("x").alias("x"), F.corr("x", "y").alias("tie"), F.avg(F.when(F.col("shop") == "north", 1.0).otherwise(0.0)).alias("north"), F.max("items").alias("items"), F.count("*").alias("n")
    )
    return {r["side"]: r for r in rows.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_classes_keep_means_ties_and_shares(classes, method):
    made = S.generate(classes, 4000, 3, method=method)
    was, got = facts(classes), facts(made)
    assert set(got) == {"up", "down"}
    for side in was:
        assert got[side]["x"] == pytest.approx(was[side]["x"], abs=0.6)
        assert got[side]["tie"] == pytest.approx(was[side]["tie"], abs=0.15)
        assert got[side]["north"] == pytest.approx(was[side]["north"], abs=0.08)
        assert got[side]["n"] == pytest.approx(was[side]["n"], rel=0.1)
        assert got[side]["items"] <= was[side]["items"]
    assert made.where("side IS NULL").count() == pytest.approx(classes.where("side IS NULL").count(), rel=0.35)
    links = lambda df: {r["col_b"]: abs(r["value"]) for r in A.cat_num_association(df, ["side"], ["x", "y"]).collect()}
    before, after = links(classes), links(made)
    assert after["x"] == pytest.approx(before["x"], abs=0.06)


def test_a_numeric_target_is_drawn_by_bin_and_driver(spark):
    n = lambda name: normal(F.col("id"), 9, name)
    kind = F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))
    price = 100.0 + (F.col("id") % 3) * 40 + n("p") * 10
    df = spark.range(3000).select(price.alias("price"), (price * 0.5 + n("t") * 3).alias("tax"), (price * 2 + n("w") * 20).alias("weight"), kind.alias("kind"))
    model = S.fit(df, method="marginal")
    from veilwork.operators.targeted import BIN, draw_given, draw_group, fit_target

    for joint in (False, True):
        if joint:
            S.code_categories(df, ["kind"], ["price", "tax", "weight"], model)
        t = fit_target(df, model, "price", True, ["kind"], ["price", "tax", "weight"], {}, [], joint)
        assert t.group == BIN and t.driver == "kind" and len(t.edges) > 3
        rows, _ = draw_given(draw_group(S.new_rows(spark, 3000), model, t, 4), model, t, 4)
        means = lambda d: {r["kind"]: r["m"] for r in d.groupBy("kind").agg(F.avg("price").alias("m")).collect()}
        was, got = means(df), means(rows)
        assert {k: round(v) for k, v in got.items()} == pytest.approx({k: round(v) for k, v in was.items()}, abs=5)
        ends = df.agg(F.min("price"), F.max("price")).first()
        assert rows.where((F.col("price") < ends[0]) | (F.col("price") > ends[1])).count() == 0
        for c in ("tax", "weight"):
            a, b = (d.agg(F.corr("price", c)).first()[0] for d in (df, rows))
            assert b == pytest.approx(a, abs=0.08)


def test_odd_targets(spark):
    flat = spark.range(300).select(F.lit(1.0).alias("x"), (F.col("id") % 7 * 1.5).alias("y"))
    model = S.fit(flat, method="marginal")
    from veilwork.operators.targeted import class_uniforms, class_factors, fit_target

    assert fit_target(flat, model, "x", True, [], ["x", "y"], {}, [], False) is None
    assert model.target is None
    # a class without a matrix, and a null one, get independent uniforms
    rows = S.new_rows(spark, 4000).withColumn("g", F.when(F.col("row_id") % 3 == 0, "a").when(F.col("row_id") % 3 == 1, "b"))
    factors = class_factors(rows, {"a": np.array([[1.0, 0.9], [0.9, 1.0]])}, 2)
    made = class_uniforms(rows, "g", ["x", "y"], ["ux", "uy"], factors, 3)
    got = {r["g"]: r["c"] for r in made.groupBy("g").agg(F.corr("ux", "uy").alias("c")).collect()}
    assert got["a"] > 0.8 and abs(got["b"]) < 0.1 and abs(got[None]) < 0.1
    assert made.where("ux <= 0 OR ux >= 1 OR ux IS NULL").count() == 0


def test_batch_draws_equal_the_expressions(spark):
    ids = [0, 1, 7, 2147483646, 2147483647, 2147483648, 9 * 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", normal(F.col("id"), 7, "target/1").alias("z"))
    rows = df.select("id", "z", normal_cdf(F.col("z")).alias("u")).collect()
    at = np.array([r["id"] for r in rows])
    z = normal_values(7, "target/1")(at)
    assert np.allclose(z, [r["z"] for r in rows], atol=1e-12) and np.allclose(normal_cdf_values()(z), [r["u"] for r in rows], atol=1e-12)


def test_class_uniforms_are_no_spark_expressions(spark):
    """Tied as the class's matrix says, independent in other classes; the normals' formulas are not in the plan."""
    rows = spark.range(20000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("side"))
    factors = G.class_factors(rows, {"c1": np.array([[1.0, 0.9], [0.9, 1.0]])}, 2)
    made = G.class_uniforms(rows, "side", ["a", "b"], ["u", "v"], factors, 3)
    assert "cos" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    ties = {r["side"]: r["tie"] for r in made.groupBy("side").agg(F.corr("u", "v").alias("tie")).collect()}
    assert ties["c1"] > 0.85 and abs(ties["c2"]) < 0.05 and abs(ties[None]) < 0.05
    assert made.count() == 20000 and made.where("u <= 0 or u >= 1 or u is null").isEmpty()


def test_scores_of_few_values_move_no_rows(spark, monkeypatch):
    """Also where the stored running totals of all columns look too large, columns of few values need no split join."""
    monkeypatch.setattr(R, "fits", lambda *_: False)
    monkeypatch.setattr(R, "maybe_broadcast", lambda df, *_: df)
    df = spark.range(3000).select((F.col("id") % 7).alias("few"), (F.col("id") % 2).alias("two"), F.when(F.col("id") % 5 > 3, "x").otherwise("y").alias("label"))
    scores = S.normal_scores(df, ["few", "two"], "label")
    assert "_salt" not in scores._jdf.queryExecution().optimizedPlan().toString()
    assert scores.dropna().count() == 3000
