"""Column profiles, value frequencies, constraints and summaries (long tables, one row per column or value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES, PROBS, is_integer_type
from veilwork.operators.frames import (
    cell,
    column_rows,
    exact_quantiles,
    melt_numbers,
    melt_text,
    number_cell,
    numeric_columns,
    other_columns,
    piece_counts,
    running_totals,
    value_counts,
)

LOW_CARDINALITY = 50
STORED_VALUES = 200


def profile_light(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing share (null or empty), distinct count and, for numbers, min/max/mean/sample deviation."""
    names = list(columns or df.columns)
    numeric = set(numeric_columns(df))

    def fields(c):
        text = cell(c).cast("string")
        filled = text.isNotNull() & (text != "")
        x = number_cell(df, c) if c in numeric else F.lit(None).cast("double")
        spread = F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0))
        return [
            F.avg(F.when(filled, 0.0).otherwise(1.0)).alias("missing_ratio"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.avg(x).alias("mean"),
            spread.alias("std"),
        ]

    moments = column_rows(df, names, fields)
    distinct = (
        value_counts(melt_text(df, names)).where(F.col("value") != "").groupBy("column").agg(F.count("*").alias("distinct"))
    )
    return moments.join(distinct, "column", "left").select(
        "column", "missing_ratio", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "mean", "std"
    )


def number_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value double, n): the pre-aggregated form that quantiles, ranks and ratios start from."""
    return value_counts(melt_numbers(df, list(columns or numeric_columns(df))))


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Full numeric profile: nulls, moments, distinct count, 15 exact percentiles, fences, whole-number flag."""
    names = list(columns or numeric_columns(df))
    whole = {f.name for f in df.schema.fields if is_integer_type(f.dataType)}

    def fields(c):
        x = number_cell(df, c)
        return [
            F.avg(F.when(x.isNull() | F.isnan(x), 1.0).otherwise(0.0)).alias("null_ratio"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.avg(x).alias("mean"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
            (F.lit(True) if c in whole else F.min(x % 1 == 0)).alias("is_integer"),
        ]

    moments = column_rows(df, names, fields)
    levels = exact_quantiles(piece_counts(df, names), ["column"], PROBS)
    cut = {n: F.col("q")[i] for i, n in enumerate(PROB_NAMES)}
    iqr = cut["q75"] - cut["q25"]
    return moments.join(levels, "column", "left").select(
        "column",
        "null_ratio",
        F.coalesce("distinct", F.lit(0)).alias("unique_count"),
        "min",
        "max",
        "mean",
        "std",
        *[c.alias(n) for n, c in cut.items()],
        iqr.alias("iqr"),
        (cut["q25"] - 1.5 * iqr).alias("lo_fence"),
        (cut["q75"] + 1.5 * iqr).alias("hi_fence"),
        "is_integer",
    )


def iqr_bounds(profile: DataFrame, factor: float = 1.5) -> DataFrame:
    iqr = F.col("q75") - F.col("q25")
    return profile.select(
        "column", iqr.alias("iqr"), (F.col("q25") - factor * iqr).alias("lo"), (F.col("q75") + factor * iqr).alias("hi")
    )


def is_integer_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole-number flag over all rows."""
    names = list(columns or numeric_columns(df))
    return column_rows(df, names, lambda c: [F.coalesce(F.min(number_cell(df, c) % 1 == 0), F.lit(False)).alias("is_integer")])


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or other_columns(df))
    nulls = column_rows(df, names, lambda c: [F.avg(F.when(cell(c).isNull(), 1.0).otherwise(0.0)).alias("null_ratio")])
    distinct = value_counts(melt_text(df, names)).groupBy("column").agg(F.count("*").alias("unique_count"))
    return nulls.join(distinct, "column", "left").select(
        "column", "null_ratio", F.coalesce("unique_count", F.lit(0)).alias("unique_count")
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add ``total``, ``distinct`` and ``ratio`` per column to (column, value, n)."""
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    return counts.join(F.broadcast(totals), "column").withColumn("ratio", F.col("n") / F.col("total"))


def value_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact frequencies of whole-number columns with 2 to 50 distinct values."""
    names = list(columns or numeric_columns(df))
    counts = with_ratios(number_counts(df, names))
    flags = is_integer_column(df, names).where("is_integer").select("column")
    return (
        counts.where(F.col("distinct").between(2, LOW_CARDINALITY))
        .join(F.broadcast(flags), "column", "left_semi")
        .select("column", F.col("value").cast("long").alias("value"), "n", "ratio")
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value.

    Only k rows per column leave each task (Spark's window group limit), so wide domains stay distributed.
    """
    counts = value_counts(melt_text(df, list(columns or other_columns(df))))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("ratio"), F.col("rank").cast("int").alias("rank")
    )


def full_value_distribution(df: DataFrame, columns: Sequence[str] | None = None, cap: int = STORED_VALUES) -> DataFrame:
    """All ratios of columns with at most ``cap`` distinct values."""
    counts = with_ratios(value_counts(melt_text(df, list(columns or other_columns(df)))))
    return counts.where(F.col("distinct") <= cap).select("column", "value", "n", "ratio")


def constraints(df: DataFrame, max_null_ratio: float = 0.0) -> DataFrame:
    """(column, kind, lo, hi, allowed, null_ratio, null_ok): ranges of numbers, allowed values of small domains."""
    numbers, others = numeric_columns(df), other_columns(df)
    null_share = lambda c: F.avg(F.when(cell(c).isNull(), 1.0).otherwise(0.0))
    parts = []
    if numbers:
        parts.append(
            column_rows(
                df,
                numbers,
                lambda c: [
                    F.lit("range").alias("kind"),
                    F.min(number_cell(df, c)).alias("lo"),
                    F.max(number_cell(df, c)).alias("hi"),
                    F.lit(None).cast("array<string>").alias("allowed"),
                    null_share(c).alias("null_ratio"),
                ],
            )
        )
    if others:
        small = full_value_distribution(df, others, LOW_CARDINALITY)
        allowed = small.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("allowed"))
        nulls = column_rows(df, others, lambda c: [null_share(c).alias("null_ratio")])
        parts.append(
            nulls.join(allowed, "column", "left").select(
                "column",
                F.when(F.col("allowed").isNull(), "open").otherwise("allowed").alias("kind"),
                F.lit(None).cast("double").alias("lo"),
                F.lit(None).cast("double").alias("hi"),
                "allowed",
                "null_ratio",
            )
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("null_ok", F.col("null_ratio") <= max_null_ratio)


def rules_text(constraint_rows: DataFrame) -> DataFrame:
    """One readable sentence per constraint row."""
    sentence = (
        F.when(F.col("kind") == "range", F.format_string("%s must be between %s and %s.", F.col("column"), F.col("lo").cast("string"), F.col("hi").cast("string")))
        .when(F.col("kind") == "allowed", F.format_string("%s must be one of the %d observed values.", F.col("column"), F.size("allowed")))
    )
    return constraint_rows.select("column", sentence.alias("rule")).where("rule is not null")


def value_entropy(counts: DataFrame) -> DataFrame:
    """(column, total, distinct, entropy): Shannon bits over value counts, 1e-10 inside the logarithm."""
    shares = with_ratios(counts)
    return shares.groupBy("column").agg(
        F.first("total").alias("total"),
        F.first("distinct").alias("distinct"),
        (-F.sum(F.col("ratio") * F.log2(F.col("ratio") + F.lit(1e-10)))).alias("entropy"),
    )


def histogram(sides: dict[str, DataFrame], columns: Sequence[str], bins: int = 20) -> DataFrame:
    """(column, side, bin, n): equal-width bins over the joint range, last bin closed."""
    long = None
    for side, df in sides.items():
        part = melt_numbers(df, columns).withColumn("side", F.lit(side))
        long = part if long is None else long.unionByName(part)
    counts = long.groupBy("side", "column", "value").agg(F.count("*").alias("n"))
    edges = counts.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = counts.join(F.broadcast(edges), "column").where("hi > lo")
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return binned.groupBy("column", "side", at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def stat_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, population deviation, upper median and count over all rows."""
    names = list(columns or numeric_columns(df))

    def fields(c):
        x = number_cell(df, c)
        return [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("count")]

    moments = column_rows(df, names, fields)
    placed = running_totals(piece_counts(df, names), ["column"], ["value"], ["n"], merge=True)
    middle = F.floor(F.col("count") / 2)
    found = placed.join(F.broadcast(moments.select("column", "count")), "column").where(
        (F.col("before_n") <= middle) & (middle < F.col("before_n") + F.col("n"))
    )
    return moments.join(found.select("column", F.col("value").alias("median")), "column", "left").select(
        "column", "min", "max", "mean", "std", "median", "count"
    )


def compare_means(original: DataFrame, synthetic: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Relative mean shift in percent between two ``stat_summary`` tables."""
    joined = original.select("column", F.col("mean").alias("mean_original")).join(
        synthetic.select("column", F.col("mean").alias("mean_synthetic")), "column"
    )
    delta = F.when(
        F.col("mean_original") != 0,
        (F.col("mean_synthetic") - F.col("mean_original")) / F.abs("mean_original") * 100.0,
    )
    return joined.withColumn("delta_pct", delta).withColumn(
        "flagged", F.coalesce(F.abs("delta_pct") > threshold, F.lit(False))
    )


def missing_report(profile: DataFrame, thresholds: Sequence[float] = (0.05, 0.30, 0.60)) -> DataFrame:
    """Columns above the reporting level with their severity."""
    low, mid, high = thresholds
    level = F.when(F.col("null_ratio") > high, "high").when(F.col("null_ratio") > mid, "medium").otherwise("low")
    return profile.where(F.col("null_ratio") > low).select("column", "null_ratio", level.alias("severity"))
