"""Conditional statistics: what a column looks like given a class, a partner category or a binned partner number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES, PROBS
from veilwork.functions.sizing import maybe_broadcast
from veilwork.operators.association import cat_num_association, cramers_v
from veilwork.operators.frames import (
    cell,
    exact_quantiles,
    melt_numbers,
    melt_text,
    number_cell,
    numeric_columns,
    other_columns,
    piece_counts,
    text_cell,
    value_counts,
)
from veilwork.operators.profile import STORED_VALUES, value_ratios, with_ratios

CLASS_PULL = 20.0
REGRESSION_PULL = 8.0
PARTNER_PULL = 2.0
BIN_PULL = 10.0


def with_label(df: DataFrame, label: str) -> DataFrame:
    """Add the label as text in ``_label``; null labels stay null and are dropped by the groupings."""
    return df.withColumn("_label", text_cell(df, label))


def _grouped_profile(long: DataFrame, groups: Sequence[str], min_rows: int) -> DataFrame:
    """Moments and 15 percentiles of (groups.., value); the long rows are collapsed to value counts first."""
    counts = piece_counts(long, ["value"], groups, tag=None)
    moments = long.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    levels = exact_quantiles(counts, groups, PROBS).select(*groups, "q")
    std = F.when(F.coalesce("std", F.lit(0.0)) > 0, F.col("std")).otherwise(F.lit(1e-6))
    return (
        moments.where(F.col("n") >= min_rows)
        .join(levels, list(groups))
        .select(*groups, "n", "mean", std.alias("std"), "min", "max", *[F.col("q")[i].alias(q) for i, q in enumerate(PROB_NAMES)])
    )


def class_stats(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(label, column, n, mean, std, min, max, q01..q99) for classes with at least two values."""
    names = [c for c in (columns or numeric_columns(df)) if c != label]
    long = melt_numbers(with_label(df, label), names, ["_label"]).where(F.col("_label").isNotNull())
    return _grouped_profile(long.withColumnRenamed("_label", "label"), ["label", "column"], 2)


def class_value_ratios(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per class frequencies of the whole-number columns that ``value_ratios`` accepts."""
    names = [c for c in (columns or numeric_columns(df)) if c != label]
    discrete = value_ratios(df, names).select("column").distinct()
    counts = value_counts(melt_numbers(with_label(df, label), names, ["_label"]), ["_label"])
    kept = counts.where(F.col("_label").isNotNull()).join(F.broadcast(discrete), "column", "left_semi")
    totals = kept.groupBy("_label", "column").agg(F.sum("n").alias("total"))
    return kept.join(maybe_broadcast(totals), ["_label", "column"]).select(
        F.col("_label").alias("label"),
        "column",
        F.col("value").cast("long").alias("value"),
        "n",
        (F.col("n") / F.col("total")).alias("ratio"),
    )


def shrink(observed: DataFrame, reference: DataFrame, groups: Sequence[str], pull: float) -> DataFrame:
    """Empirical-Bayes shrinkage of grouped frequencies toward the overall ones.

    ``observed`` is (groups.., column, value, n), ``reference`` (column, value, ratio, distinct). The result covers
    the whole value domain of every group: alpha = n / (n + max(1, k/5) * pull).
    """
    totals = observed.groupBy(*groups, "column").agg(F.sum("n").alias("n_group"))
    grid = totals.join(maybe_broadcast(reference.select("column", "value", "ratio", "distinct")), "column")
    joined = grid.join(observed, [*groups, "column", "value"], "left")
    weight = F.greatest(F.lit(1.0), F.col("distinct") / 5.0) * F.lit(pull)
    alpha = F.col("n_group") / (F.col("n_group") + weight)
    raw = F.coalesce(F.col("n"), F.lit(0)) / F.col("n_group")
    return joined.select(
        *groups, "column", "value", "n_group", raw.alias("raw"), (alpha * raw + (1.0 - alpha) * F.col("ratio")).alias("p")
    )


def protect_sparse(freqs: DataFrame, groups: Sequence[str], factor: float = 0.5, max_moved: float = 0.15) -> DataFrame:
    """Raise every observed value to at least ``factor`` times its raw share, paid for by the other values.

    At most ``max_moved`` of the total mass moves. Groups are bounded value domains, so a window per group is fine.
    """
    w = Window.partitionBy(*groups)
    lift = F.when((F.col("raw") > 0) & (F.lit(factor) * F.col("raw") > F.col("p")), F.lit(factor) * F.col("raw") - F.col("p")).otherwise(0.0)
    f = freqs.withColumn("_lift", lift)
    f = f.withColumn("_need", F.sum("_lift").over(w)).withColumn(
        "_donor", F.sum(F.when(F.col("_lift") > 0, 0.0).otherwise(F.col("p"))).over(w)
    )
    moved = F.least(F.col("_need"), F.lit(max_moved))
    scale = F.when(F.col("_need") > 0, moved / F.col("_need")).otherwise(0.0)
    act = (F.col("_need") > 0) & (F.col("_donor") > 0)
    donor_scale = F.greatest(F.lit(0.0), F.try_divide(F.col("_donor") - moved, F.col("_donor")))
    p = F.when(act & (F.col("_lift") > 0), F.col("p") + F.col("_lift") * scale).when(act, F.col("p") * donor_scale).otherwise(F.col("p"))
    f = f.withColumn("p", p)
    return f.withColumn("p", F.col("p") / F.sum("p").over(w)).drop("_lift", "_need", "_donor")


def class_freq(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, pull: float = CLASS_PULL, protect: bool = True,
    max_values: int | None = STORED_VALUES,
) -> DataFrame:
    """(label, column, value, n_group, raw, p): per class frequencies shrunk to the overall ones.

    Columns with more than ``max_values`` distinct values have no stored distribution and are left out; None keeps all.
    """
    names = [c for c in (columns or other_columns(df)) if c != label]
    labelled = with_label(df, label).where(F.col("_label").isNotNull())
    counts = value_counts(melt_text(labelled, names, ["_label"]), ["_label"]).withColumnRenamed("_label", "label")
    overall = with_ratios(counts.groupBy("column", "value").agg(F.sum("n").alias("n")))
    kept = counts
    if max_values is not None:
        overall = overall.where(F.col("distinct") <= max_values)
        kept = counts.join(F.broadcast(overall.select("column").distinct()), "column", "left_semi")
    out = shrink(kept, overall, ["label"], pull)
    return protect_sparse(out, ["label", "column"]) if protect else out


def adaptive_bins(rows: int, categories: int, per_cell: int = 5, lo: int = 3, hi: int = 10) -> int:
    return max(lo, min(hi, rows // max(1, categories * per_cell)))


def equal_count_edges(df: DataFrame, column: str, bins: Sequence[int]) -> dict[int, list[float]]:
    """Distinct quantile edges for each requested bin count; one quantile pass for all of them."""
    levels = sorted({i / b for b in bins for i in range(b + 1)})
    counts = piece_counts(df, [column])
    rows = exact_quantiles(counts, ["column"], levels).select("q").collect()
    if not rows:
        return {b: [] for b in bins}
    at = dict(zip(levels, rows[0]["q"]))
    return {b: sorted({at[i / b] for i in range(b + 1)}) for b in bins}


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the bin (lo, hi]; the first bin also holds its lower edge. Outside values are clipped."""
    out = F.lit(max(0, len(edges) - 2))
    for i in reversed(range(len(edges) - 2)):
        out = F.when(value <= F.lit(edges[i + 1]), F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def quantile_bins(df: DataFrame, target: str, max_cardinality: int = 1) -> DataFrame:
    """(bin, lo, hi, n): equal-count bins of a regression target.

    Starts at min(10, max(3, rows/100)) bins and goes down to 3 until every bin holds max(30, 5 x cardinality).
    """
    spark = df.sparkSession
    x = number_cell(df, target)
    rows = df.count()
    start = min(10, max(3, rows // 100))
    floor = max(30, max_cardinality * 5)
    edges = equal_count_edges(df, target, range(3, start + 1))
    tallies = []
    for b, e in edges.items():
        for i in range(max(0, len(e) - 1)):
            tallies.append(F.count(F.when(bin_of(x, e) == i, 1)).alias(f"b{b}_{i}"))
    found = df.agg(*tallies).first() if tallies else None
    chosen = 3
    for b in range(start, 3, -1):
        sizes = [found[f"b{b}_{i}"] for i in range(len(edges[b]) - 1)]
        if sizes and min(sizes) >= floor:
            chosen = b
            break
    e = edges[chosen]
    data = [(i, e[i], e[i + 1], found[f"b{chosen}_{i}"]) for i in range(len(e) - 1)]
    return spark.createDataFrame(data, "bin int, lo double, hi double, n long")


def best_partners(pairs: DataFrame, min_abs: float = 0.30) -> dict[str, tuple[str, float]]:
    """Strongest Cramer partner per column whose joint table is not too sparse (k1 k2 <= n / 5)."""
    best: dict[str, tuple[str, float]] = {}
    rows = pairs.where((F.col("value") >= min_abs) & (F.col("k") * F.col("r") <= F.col("n") / 5)).collect()
    for row in sorted(rows, key=lambda r: (r["col_a"], r["col_b"])):
        for a, b in ((row["col_a"], row["col_b"]), (row["col_b"], row["col_a"])):
            if a not in best or row["value"] > best[a][1]:
                best[a] = (b, row["value"])
    return best


def cond_freq_cat(
    df: DataFrame, columns: Sequence[str], min_abs: float = 0.30, min_rows: int = 5, partners: dict[str, tuple[str, float]] | None = None
) -> DataFrame:
    """(column, partner, given, value, n_group, raw, p): category given its best partner category."""
    if partners is None:
        partners = best_partners(cramers_v(df, columns), min_abs)
    schema = "column string, partner string, given string, value string, n_group long, raw double, p double"
    if not partners:
        return df.sparkSession.createDataFrame([], schema)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(p).alias("partner"), text_cell(df, c).alias("value"), text_cell(df, p).alias("given"))
            for c, (p, _) in sorted(partners.items())
        ]
    )
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "partner", "given", "value").agg(F.count("*").alias("n"))
    overall = with_ratios(counts.groupBy("column", "value").agg(F.sum("n").alias("n")))
    paired = counts.where(F.col("given").isNotNull())
    big = paired.groupBy("column", "given").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_rows)
    kept = paired.join(maybe_broadcast(big.drop("_n")), ["column", "given"], "left_semi")
    out = shrink(kept, overall, ["partner", "given"], PARTNER_PULL)
    return protect_sparse(out, ["column", "partner", "given"])


def cond_freq_num(
    df: DataFrame, columns: Sequence[str], numbers: Sequence[str], min_abs: float = 0.30
) -> tuple[DataFrame, dict[str, tuple[str, list[float]]]]:
    """Category given the equal-count bin of its strongest numeric partner.

    Returns (column, partner, bin, value, n_group, raw, p) and the bin edges per column.
    """
    links: dict[str, tuple[str, float]] = {}
    for r in cat_num_association(df, columns, numbers, min_abs=min_abs).collect():
        if r["col_a"] not in links or (abs(r["value"]), r["col_b"]) > (links[r["col_a"]][1], links[r["col_a"]][0]):
            links[r["col_a"]] = (r["col_b"], abs(r["value"]))
    schema = "column string, partner string, bin int, value string, n_group long, raw double, p double"
    if not links:
        return df.sparkSession.createDataFrame([], schema), {}
    sizes = df.agg(
        *[F.count(number_cell(df, p)).alias(f"n{i}") for i, (c, (p, _)) in enumerate(sorted(links.items()))],
        *[F.count_distinct(text_cell(df, c)).alias(f"k{i}") for i, c in enumerate(sorted(links))],
    ).first()
    edges, structs = {}, []
    for i, (c, (p, _)) in enumerate(sorted(links.items())):
        b = adaptive_bins(sizes[f"n{i}"], sizes[f"k{i}"])
        e = equal_count_edges(df, p, [b])[b]
        edges[c] = (p, e)
        structs.append(
            F.struct(F.lit(c).alias("column"), F.lit(p).alias("partner"), bin_of(number_cell(df, p), e).alias("bin"), text_cell(df, c).alias("value"))
        )
    long = df.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "partner", "bin", "value").agg(F.count("*").alias("n"))
    overall = with_ratios(counts.groupBy("column", "value").agg(F.sum("n").alias("n")))
    out = shrink(counts.where(F.col("bin").isNotNull()), overall, ["partner", "bin"], BIN_PULL)
    return protect_sparse(out, ["column", "partner", "bin"]), edges


def best_categories(links: DataFrame, min_abs: float = 0.30) -> dict[str, tuple[str, float]]:
    """Strongest category per number by absolute association."""
    best: dict[str, tuple[str, float]] = {}
    for r in links.where(F.abs("value") >= min_abs).collect():
        if r["col_b"] not in best or (abs(r["value"]), r["col_a"]) > (best[r["col_b"]][1], best[r["col_b"]][0]):
            best[r["col_b"]] = (r["col_a"], abs(r["value"]))
    return best


def cond_profile(
    df: DataFrame, cats: Sequence[str], numbers: Sequence[str], min_abs: float = 0.30, min_rows: int = 10,
    best: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """(column, partner, given, n, mean, std, min, max, q..): number given its strongest category by |r|."""
    if best is None:
        best = best_categories(cat_num_association(df, cats, numbers), min_abs)
    if not best:
        raise ValueError("no category is associated with any of the numbers")
    structs = [
        F.struct(F.lit(x).alias("column"), F.lit(c).alias("partner"), text_cell(df, c).alias("given"), number_cell(df, x).alias("value"))
        for x, (c, _) in sorted(best.items())
    ]
    long = df.select(F.inline(F.array(*structs))).where(F.col("given").isNotNull() & F.col("value").isNotNull())
    return _grouped_profile(long, ["column", "partner", "given"], min_rows)


def variance_driver(df: DataFrame, target: str, cats: Sequence[str], min_share: float = 0.05) -> DataFrame:
    """(column, share) of the category explaining most of the target's variance, when above the limit."""
    x = number_cell(df, target)
    tags = F.array(*[F.struct(F.lit(c).alias("column"), text_cell(df, c).alias("given")) for c in cats])
    long = df.select(F.explode(tags).alias("t"), x.alias("x")).where(F.col("t.given").isNotNull() & F.col("x").isNotNull())
    groups = long.groupBy(F.col("t.column").alias("column"), F.col("t.given").alias("given")).agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    mean, var = df.agg(F.avg(x)).scalar(), df.agg(F.var_samp(x)).scalar()
    # a projection of its own: a subquery over rows that were dealt or drawn may not stand inside an aggregate
    parts = groups.select("column", "n", (F.col("n") * F.pow(F.col("m") - mean, 2)).alias("s"))
    sums = parts.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"))
    shares = sums.where(F.col("k") >= 2).select("column", F.try_divide(F.col("s") / F.col("n"), var).alias("share"))
    return shares.where(F.col("share") > min_share).orderBy(F.desc("share"), "column").limit(1)


def target_quantiles(df: DataFrame, target: str, driver: str, bins: DataFrame, min_rows: int = 5) -> DataFrame:
    """(bin, given, n, mean, ..): target percentiles per target bin and driver category."""
    rows = bins.orderBy("bin").collect()
    edges = [rows[0]["lo"]] + [r["hi"] for r in rows]
    x = number_cell(df, target)
    long = df.select(bin_of(x, edges).alias("bin"), text_cell(df, driver).alias("given"), x.alias("value"))
    long = long.where(F.col("given").isNotNull() & F.col("value").isNotNull())
    return _grouped_profile(long, ["bin", "given"], min_rows)


def class_covariance(df: DataFrame, label: str, numbers: Sequence[str]) -> DataFrame:
    """(label, n, col_a, col_b, cov): per class covariances on complete rows, off-diagonals shrunk to zero."""
    names = list(numbers)
    k = len(names)
    picked = with_label(df, label).select(F.col("_label").alias("label"), *[number_cell(df, c).alias(c) for c in names]).dropna()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.covar_samp(cell(a), cell(b)).alias("cov")) for a, b in pairs]
    grouped = picked.groupBy("label").agg(F.count("*").alias("n"), F.array(*structs).alias("c")).where(F.col("n") >= k + 1)
    alpha = F.least(F.lit(1.0), F.lit(float(k)) / F.greatest(F.lit(1.0), F.col("n") - F.lit(k + 1.0)))
    return grouped.select("label", "n", F.inline("c")).select(
        "label", "n", "col_a", "col_b", F.when(F.col("col_a") == F.col("col_b"), F.col("cov")).otherwise((1.0 - alpha) * F.col("cov")).alias("cov")
    )
