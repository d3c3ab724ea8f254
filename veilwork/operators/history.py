"""Run snapshots and drift between successive runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.numeric import clamp, normal_cdf
from veilwork.operators.frames import exact_quantiles, melt_numbers, melt_text, numeric_columns, other_columns, piece_counts, value_counts

TINY = 1e-10
WARN, CRITICAL = 0.25, 0.55
BINS = 20


def snapshot(
    df: DataFrame, run_id: str, numbers: Sequence[str] | None = None, others: Sequence[str] | None = None,
    max_values: int | None = 100, kept: int | None = 20,
) -> DataFrame:
    """(run_id, column, kind, n, mean, std, q25, q50, q75, min, max, freqs) for all runs in ``df`` at once.

    ``run_id`` is the run column. Numbers need two values; categories at most ``max_values`` values, at most 80 % unique,
    and keep their ``kept`` most frequent shares; None lifts a bound. Columns starting with an underscore are skipped.
    """
    nums = [c for c in (numbers if numbers is not None else numeric_columns(df)) if c != run_id and not c.startswith("_")]
    cats = [c for c in (others if others is not None else other_columns(df)) if c != run_id and not c.startswith("_")]
    base = df.withColumnRenamed(run_id, "run_id")
    parts = []
    empty = F.lit(None).cast("array<struct<value:string,ratio:double>>")
    if nums:
        long = melt_numbers(base, nums, ["run_id"])
        counts = piece_counts(base, nums, ["run_id"])
        q = exact_quantiles(counts, ["run_id", "column"], [0.25, 0.5, 0.75]).select("run_id", "column", "q")
        m = long.groupBy("run_id", "column").agg(
            F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
        )
        parts.append(
            m.where("n >= 2").join(q, ["run_id", "column"]).select(
                "run_id", "column", F.lit("numeric").alias("kind"), "n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"),
                "min", "max", empty.alias("freqs"),
            )
        )
    if cats:
        counts = value_counts(melt_text(base, cats, ["run_id"]), ["run_id"])
        totals = counts.groupBy("run_id", "column").agg(F.sum("n").alias("t"), F.count("*").alias("k")).where(F.col("k") / F.col("t") <= 0.8)
        totals = totals if max_values is None else totals.where(F.col("k") <= max_values)
        w = Window.partitionBy("run_id", "column").orderBy(F.desc("n"), "value")
        top = counts if kept is None else counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept)
        top = top.join(totals, ["run_id", "column"])
        none = F.lit(None).cast("double")
        entry = F.struct("value", (F.col("n") / F.col("t")).alias("ratio"))
        parts.append(
            top.groupBy("run_id", "column").agg(F.first("t").alias("n"), F.sort_array(F.collect_list(entry)).alias("freqs")).select(
                "run_id", "column", F.lit("categorical").alias("kind"), "n", *[none.alias(c) for c in ("mean", "std", "q25", "q50", "q75", "min", "max")], "freqs"
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two equally long arrays of positive shares."""
    m = F.zip_with(p, q, lambda a, b: 0.5 * (a + b))
    half = lambda x: F.aggregate(F.zip_with(x, m, lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda s, v: s + v)
    return clamp(0.5 * half(p) + 0.5 * half(q), 0.0, 1.0)


def _shares(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.transform(values, lambda v: v / total)


def compare_runs(snapshots: DataFrame, order: str = "run_id") -> DataFrame:
    """(run_id, previous, column, kind, js, drifted, critical) of each run against the one before it.

    Numbers are compared as binned normal masses over 20 bins of the joint mean +- 3 deviations, categories by their
    stored shares.
    """
    w = Window.partitionBy("column", "kind").orderBy(order)
    prev = F.lag(F.struct("run_id", "mean", "std", "freqs")).over(w)
    j = snapshots.withColumn("_p", prev).where("_p is not null")
    s1, s2 = F.greatest(F.col("_p.std"), F.lit(1e-6)), F.greatest(F.col("std"), F.lit(1e-6))
    j = j.withColumn("_s1", s1).withColumn("_s2", s2)
    lo = F.least(F.col("_p.mean") - 3 * F.col("_s1"), F.col("mean") - 3 * F.col("_s2"))
    hi = F.greatest(F.col("_p.mean") + 3 * F.col("_s1"), F.col("mean") + 3 * F.col("_s2"))
    j = j.withColumn("_lo", lo).withColumn("_hi", hi)
    edges = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / float(BINS))
    j = j.withColumn("_e", edges)
    marks = lambda mean, std: F.transform(F.transform("_e", lambda e: (e - mean) / std), lambda z: normal_cdf(z))
    j = j.withColumn("_f1", marks(F.col("_p.mean"), F.col("_s1"))).withColumn("_f2", marks(F.col("mean"), F.col("_s2")))
    mass = lambda f: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(F.col(f), i + 1) - F.get(F.col(f), i) + F.lit(TINY))
    names = F.array_sort(F.array_union(F.transform("freqs", lambda x: x["value"]), F.transform("_p.freqs", lambda x: x["value"])))
    j = j.withColumn("_names", names)
    ratio = lambda column: F.transform("_names", lambda v: F.coalesce(F.get(F.filter(F.col(column), lambda x: x["value"] == v), F.lit(0))["ratio"], F.lit(0.0)) + F.lit(TINY))
    p = F.when(F.col("kind") == "numeric", mass("_f1")).otherwise(ratio("_p.freqs"))
    q = F.when(F.col("kind") == "numeric", mass("_f2")).otherwise(ratio("freqs"))
    j = j.withColumn("_a", p).withColumn("_b", q)
    j = j.withColumn("_a", _shares(F.col("_a"))).withColumn("_b", _shares(F.col("_b")))
    out = j.select("run_id", F.col("_p.run_id").alias("previous"), "column", "kind", (F.round(_js(F.col("_a"), F.col("_b")), 4) + F.lit(0.0)).alias("js"))
    return out.withColumn("drifted", F.col("js") > WARN).withColumn("critical", F.col("js") > CRITICAL)


def run_history(runs: DataFrame, dataset: str, time: str, keep: int = 50) -> DataFrame:
    """The newest ``keep`` runs per dataset with their age rank; rank 1 is the latest."""
    w = Window.partitionBy(dataset).orderBy(F.desc(time))
    ranked = runs.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)
    return ranked.withColumn("latest", F.col("age") == 1)
