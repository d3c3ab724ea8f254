"""Associations between columns: Pearson, Cramer's V, point-biserial and correlation ratio, null co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.operators.frames import cell, number_cell, numeric_columns, other_columns, text_cell
from veilwork.operators.profile import LOW_CARDINALITY, is_integer_column, number_counts, profile_categorical

_PAIR_CHUNK = 150


def strength(value: Column) -> Column:
    a = F.abs(value)
    return (
        F.when(a >= 0.9, "very_strong")
        .when(a >= 0.7, "strong")
        .when(a >= 0.4, "medium")
        .when(a >= 0.2, "weak")
        .otherwise("very_weak")
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; null when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _pair_rows(df: DataFrame, pairs, expression) -> DataFrame:
    """Evaluate one aggregate per pair in as few passes as the expression limit allows."""
    out = None
    for start in range(0, len(pairs), _PAIR_CHUNK):
        structs = [
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), expression(a, b).alias("value"))
            for a, b in pairs[start : start + _PAIR_CHUNK]
        ]
        part = df.agg(F.array(*structs).alias("r")).select(F.inline("r"))
        out = part if out is None else out.unionByName(part)
    return out


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None, min_abs: float = 0.0) -> DataFrame:
    """Pearson r of every numeric pair over the rows where both are present, one pass, no shuffle of rows."""
    names = list(columns or numeric_columns(df))
    pairs = list(combinations(names, 2))
    picked = df.select(*[number_cell(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    rows = None
    for start in range(0, len(pairs), _PAIR_CHUNK):
        chunk = pairs[start : start + _PAIR_CHUNK]
        cells = F.array(*[F.struct(F.col(f"x{names.index(a)}").alias("x"), F.col(f"x{names.index(b)}").alias("y")) for a, b in chunk])
        # one small aggregate keyed by the pair number; its two sides collapse inside each task
        grouped = picked.select(F.posexplode(cells).alias("pair", "v")).groupBy("pair").agg(safe_corr(F.col("v.x"), F.col("v.y")).alias("value"))
        labels = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")) for a, b in chunk])
        part = grouped.select(F.get(labels, F.col("pair")).alias("l"), "value").select("l.col_a", "l.col_b", "value")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, value double, strength string")
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") >= min_abs))
    return kept.withColumn("strength", strength(F.col("value")))


def association_columns(df: DataFrame, cardinality: int = LOW_CARDINALITY) -> list[str]:
    """Categoricals and whole-number columns with 2..cardinality distinct values, decided from the profile."""
    texts, numbers = other_columns(df), numeric_columns(df)
    chosen = []
    if texts:
        rows = profile_categorical(df, texts).where(F.col("unique_count").between(2, cardinality))
        found = {r["column"] for r in rows.select("column").collect()}
        chosen += [c for c in texts if c in found]
    if numbers:
        distinct = number_counts(df, numbers).groupBy("column").agg(F.count("*").alias("distinct"))
        rows = distinct.where(F.col("distinct").between(2, cardinality)).join(
            is_integer_column(df, numbers).where("is_integer"), "column"
        )
        found = {r["column"] for r in rows.select("column").collect()}
        chosen += [c for c in numbers if c in found]
    return chosen


def _code_text(df: DataFrame, name: str) -> Column:
    return text_cell(df, name)


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, val_a, val_b, n) for all pairs in one grouping.

    Each row is expanded to its pairs and collapsed again before the shuffle: at most the sum of the pair domains
    leaves a task.
    """
    texts = df.select(*[_code_text(df, c).alias(c) for c in columns])
    pairs = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), cell(a).alias("val_a"), cell(b).alias("val_b"))
        for a, b in combinations(columns, 2)
    ]
    long = texts.select(F.inline(F.array(*pairs))).where(F.col("val_a").isNotNull() & F.col("val_b").isNotNull())
    return long.groupBy("col_a", "col_b", "val_a", "val_b").agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, columns: Sequence[str] | None = None, min_abs: float = 0.0) -> DataFrame:
    """Cramer's V with the corrected denominator; zero cells enter through chi2 = n (sum o^2/(ra cb) - 1)."""
    cells = pair_counts(df, list(columns or association_columns(df)))
    keys = ["col_a", "col_b"]
    rows = cells.groupBy(*keys, "val_a").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*keys, "val_b").agg(F.sum("n").alias("col_n"))
    joined = cells.join(rows, [*keys, "val_a"]).join(cols, [*keys, "val_b"])
    stats = joined.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))).alias("s"),
        F.count_distinct("val_a").alias("k"),
        F.count_distinct("val_b").alias("r"),
    )
    n = F.col("n").cast("double")
    side = lambda c: F.col(c) - (F.col(c) - 1) * (F.col(c) - 1) / (n - 1) - 1
    denom = F.least(side("k"), side("r"))
    value = F.sqrt(F.greatest(F.lit(0.0), (F.col("s") - 1.0) / denom))
    return (
        stats.where((F.col("n") >= 2) & (F.col("k") >= 2) & (F.col("r") >= 2) & (denom > 0))
        .select(*keys, value.alias("value"), "n", "k", "r")
        .where(F.abs("value") >= min_abs)
    )


def group_moments(df: DataFrame, cats: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(cat, val, num, n, mean, m2): per-category moments of every numeric column in one grouping."""
    tags = F.array(*[F.struct(F.lit(c).alias("cat"), _code_text(df, c).alias("val")) for c in cats])
    picked = df.select(F.explode(tags).alias("t"), *[number_cell(df, c).alias(c) for c in numbers])
    grouped = picked.where(F.col("t.val").isNotNull()).groupBy(F.col("t.cat").alias("cat"), F.col("t.val").alias("val"))
    moments = [
        F.struct(
            F.lit(c).alias("num"),
            F.count(cell(c)).alias("n"),
            F.avg(cell(c)).alias("mean"),
            (F.var_pop(cell(c)) * F.count(cell(c))).alias("m2"),
        )
        for c in numbers
    ]
    return grouped.agg(F.array(*moments).alias("m")).select("cat", "val", F.inline("m")).where("n > 0")


def cat_num_association(
    df: DataFrame,
    cats: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    exact: bool = False,
    min_abs: float = 0.0,
) -> DataFrame:
    """Signed point-biserial for two classes (value order), correlation ratio for more.

    ``exact=False`` keeps the doubly scaled deviation of the two-class form; ``exact=True`` gives the textbook
    value.
    """
    cats = list(cats or association_columns(df))
    numbers = list(numbers or numeric_columns(df))
    groups = group_moments(df, cats, numbers)
    totals = groups.groupBy("cat", "num").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.count("*").alias("classes"),
        F.min_by("mean", "val").alias("m0"),
        F.max_by("mean", "val").alias("m1"),
        F.min_by("n", "val").alias("n0"),
        F.max_by("n", "val").alias("n1"),
        F.sum("m2").alias("within"),
    )
    between = (
        groups.join(F.broadcast(totals.select("cat", "num", "grand")), ["cat", "num"])
        .groupBy("cat", "num")
        .agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"))
    )
    j = totals.join(between, ["cat", "num"])
    n = F.col("n").cast("double")
    total = F.col("within") + F.col("between")
    variance = total / (n - 1)
    spread = F.sqrt(variance) if exact else F.sqrt(variance * n / (n - 1))
    if exact:
        spread = F.sqrt(total / n)
    two = (F.col("m1") - F.col("m0")) / spread * F.sqrt(F.col("n0") * F.col("n1") / (n * n))
    many = F.sqrt(F.col("between") / total)
    value = F.when(F.col("classes") == 2, two).otherwise(many)
    return (
        j.where((F.col("cat") != F.col("num")) & (F.col("n") >= 2) & (F.col("classes") >= 2) & (total > 0))
        .select(F.col("cat").alias("col_a"), F.col("num").alias("col_b"), value.alias("value"), "classes")
        .where(F.abs("value") >= min_abs)
    )


def null_correlation(df: DataFrame, min_null_ratio: float = 0.01) -> DataFrame:
    """Pearson r between the null indicators of columns whose null share exceeds the limit."""
    flags = df.select(*[F.when(cell(c).isNull(), 1.0).otherwise(0.0).alias(c) for c in df.columns])
    rows = _pair_rows(
        flags,
        list(combinations(df.columns, 2)),
        lambda a, b: F.when(
            (F.avg(cell(a)) > min_null_ratio) & (F.avg(cell(b)) > min_null_ratio), safe_corr(cell(a), cell(b))
        ),
    )
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of one chosen pair; null when the product of the spreads is below 1e-10."""
    a, b = number_cell(df, x), number_cell(df, y)
    r = safe_corr(a, b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    spread = F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n)
    return df.agg(
        F.lit(x).alias("col_x"), F.lit(y).alias("col_y"), F.when(spread >= 1e-10, r).alias("pearson"), n.alias("n")
    )

