"""Synthetic tables drawn from fitted statistics.

Fitting reduces a table to small facts: curves, weights, conditional tables and a k x k matrix. Generation starts
from ``spark.range`` and is one projection plus joins with those small tables; every draw depends only on the seed,
the column and the row id, so lost partitions are recomputed to the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions.curves import curve_column, curve_draw, curve_of, curve_value, literal, running, weighted_pick
from veilwork.functions.draws import normal, uniform, uuid_text
from veilwork.functions.numeric import normal_cdf, probit
from veilwork.functions.sizing import maybe_broadcast
from veilwork.operators import conditional as C
from veilwork.operators.association import association_columns, cat_num_association, cramers_v, null_correlation, pearson_pairs
from veilwork.operators.compare import assert_not_generated, tag_origin
from veilwork.operators.frames import (
    cell,
    column_rows,
    exact_quantiles,
    number_cell,
    numeric_columns,
    piece_counts,
    pinned,
    range_lookup,
    running_totals,
    spread_join,
    text_cell,
    value_counts,
)
from veilwork.operators.profile import constraints, full_value_distribution, profile_numeric, value_ratios
from veilwork.operators.scan import hint_category
from veilwork.operators.typing import classify_columns, column_facts, detect_target
from veilwork.session import cut_lineage

if TYPE_CHECKING:
    from veilwork.operators.targeted import TargetModel

CORRELATED = 0.20
STRONG = 0.30
#: What a step draws of the rows it needs by the share accepted so far.
SLACK = 1.05
#: Rows (class and value) up to which a column's table of scores is broadcast.
SMALL_TABLE = 100_000


# ---- single columns ----------------------------------------------------------------------------------------------


def new_rows(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).withColumnRenamed("id", "row_id")


def with_draws(rows: DataFrame, draws: dict[str, Column]) -> DataFrame:
    """Add helper columns in a projection of their own, so that later formulas read them instead of repeating them."""
    return rows.select("*", *[d.alias(n) for n, d in draws.items()])


def sample_numeric(rows: DataFrame, curves: dict[str, Sequence[float] | Column], seed: int, us: dict[str, str] | None = None) -> DataFrame:
    """Add columns drawn from 17-knot curves. ``us`` names columns of uniforms that replace the own ones."""
    us = us or {}
    row = F.col("row_id")
    draws = {f"_j_{c}": uniform(row, seed, c + "/jitter") for c in curves}
    draws.update({f"_u_{c}": uniform(row, seed, c) for c in curves if c not in us})
    staged = with_draws(rows, draws)
    made = {
        c: curve_draw(k if isinstance(k, Column) else literal(k), cell(us.get(c, f"_u_{c}")), cell(f"_j_{c}")) for c, k in curves.items()
    }
    return staged.select("*", *[v.alias(c) for c, v in made.items()]).drop(*draws)


def sample_weighted(rows: DataFrame, tables: dict[str, tuple[Sequence, Sequence[float]]], seed: int) -> DataFrame:
    """Add columns drawn from frequency tables (categories, or whole numbers with their exact ratios)."""
    draws = {f"_u_{c}": uniform(F.col("row_id"), seed, c) for c in tables}
    staged = with_draws(rows, draws)
    made = [weighted_pick(F.array(*[F.lit(v) for v in values]), literal(running(w)), cell(f"_u_{c}")).alias(c) for c, (values, w) in tables.items()]
    return staged.select("*", *made).drop(*draws)


def weight_table(ratios: DataFrame, column: str) -> tuple[list, list[float]]:
    """Values and weights of one column of a stored (bounded) distribution, in value order."""
    rows = ratios.where(F.col("column") == column).orderBy("value").collect()
    return [r["value"] for r in rows], [r["ratio"] for r in rows]


def sample_integers(rows: DataFrame, ratios: DataFrame, column: str, seed: int) -> DataFrame:
    return sample_weighted(rows, {column: weight_table(ratios, column)}, seed)


def sample_categorical(rows: DataFrame, distribution: DataFrame, column: str, seed: int) -> DataFrame:
    return sample_weighted(rows, {column: weight_table(distribution, column)}, seed)


def pack_weights(freqs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups.., _values, _ends): one row per group from (groups.., value, p); groups are stored value domains."""
    w = Window.partitionBy(*groups)
    ordered = freqs.withColumn("_c", F.sum("p").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("p").over(w))
    packed = ordered.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("value", "_c"))).alias("_w"))
    return packed.select(*groups, F.col("_w.value").alias("_values"), F.col("_w._c").alias("_ends"))


def sample_conditional_category(
    rows: DataFrame, column: str, given: Sequence[str], freqs: DataFrame, seed: int, fallback: tuple[Sequence, Sequence[float]] | None = None,
    u: str | None = None, stream: str | None = None,
) -> DataFrame:
    """Add ``column`` drawn given the columns ``given``; ``freqs`` is (given.., value, p). Unknown givens fall back.

    ``u`` names a column of uniforms that replaces the own ones; ``stream`` names the own ones (default: the column).
    """
    packed = pack_weights(freqs, list(given))
    joined = rows.join(maybe_broadcast(packed), list(given), "left")
    staged = with_draws(joined, {"_u": cell(u) if u else uniform(F.col("row_id"), seed, stream or column)})
    value = weighted_pick(F.col("_values"), F.col("_ends"), F.col("_u"))
    if fallback is not None:
        other = weighted_pick(F.array(*[F.lit(v) for v in fallback[0]]), literal(running(fallback[1])), F.col("_u"))
        value = F.when(F.col("_values").isNotNull(), value).otherwise(other)
    return staged.withColumn(column, value).drop("_values", "_ends", "_u")


def sample_conditional_number(
    rows: DataFrame, column: str, given: Sequence[str], profiles: DataFrame, seed: int, fallback: Sequence[float] | None = None, u: str | None = None
) -> DataFrame:
    """Add ``column`` drawn from the curve of its group; ``profiles`` is (given.., min, max, q01..q99)."""
    knots = profiles.select(*given, curve_column().alias("_knots"))
    joined = rows.join(maybe_broadcast(knots), list(given), "left")
    if fallback is not None:
        joined = joined.withColumn("_knots", F.coalesce(F.col("_knots"), literal(fallback)))
    return sample_numeric(joined, {column: F.col("_knots")}, seed, {column: u} if u else None).drop("_knots")


def generate_ids(strategy: str, seed: int, stream: str, start: int = 0, row_id: str = "row_id") -> Column:
    """sequential numbers after ``start``, md5 texts or version-4 shaped identifiers."""
    row = F.col(row_id)
    if strategy == "sequential":
        return row + F.lit(start + 1).cast("long")
    if strategy == "hash":
        return F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(stream), row.cast("string")))
    return uuid_text(row, seed, stream)


def generate_datetimes(lo_micros: int, hi_micros: int, seed: int, stream: str, row_id: str = "row_id") -> Column:
    span = F.lit(hi_micros - lo_micros).cast("long")
    return F.timestamp_micros(F.lit(lo_micros).cast("long") + F.floor(uniform(F.col(row_id), seed, stream) * span).cast("long"))


def inject_nulls(rows: DataFrame, ratios: dict[str, float], seed: int, correlation: np.ndarray | None = None, tied: Sequence[str] = ()) -> DataFrame:
    """Set cells to null by share, alone or (for ``tied``) through thresholds on correlated normal draws."""
    out = {}
    if correlation is not None and len(tied) >= 2:
        rows = correlated_normals(rows, [f"_z_{c}" for c in tied], np.zeros(len(tied)), correlation, seed, "null")
        for c in tied:
            if c in rows.columns and ratios.get(c, 0.0) > 0:
                share = min(max(ratios[c], 1e-9), 1 - 1e-9)
                out[c] = cell(f"_z_{c}") < probit(F.lit(share))
    for c, share in ratios.items():
        if c in rows.columns and c not in out and share > 0:
            out[c] = uniform(F.col("row_id"), seed, f"null/{c}") < F.lit(float(share))
    helpers = {f"_z_{c}" for c in tied}
    return rows.select(*[F.when(~out[c], cell(c)).alias(c) if c in out else cell(c) for c in rows.columns if c not in helpers])


def sample_text(rows: DataFrame, source: DataFrame, column: str, seed: int, allow_source_text: bool = False) -> DataFrame:
    """Add ``column`` as a uniform pick from all non-null source cells.

    It releases real source texts, so it must be allowed by the caller; otherwise the column is null. The pool is
    numbered in value order across the cluster, as ranges of numbers, in which the drawn numbers are looked up.
    """
    if not allow_source_text:
        return rows.withColumn(column, F.lit(None).cast("string"))
    pool = source.select(text_cell(source, column).alias(column)).where(cell(column).isNotNull())
    size = pool.count()
    if size == 0:
        return rows.withColumn(column, F.lit(None).cast("string"))
    counts = pool.groupBy(column).agg(F.count("*").alias("n"))
    return draw_counted(rows, counts, column, size, seed)


def draw_counted(rows: DataFrame, counts: DataFrame, column: str, size: int, seed: int) -> DataFrame:
    """Add ``column`` drawn from (column, n) value counts that sum to ``size``; values are numbered in their order."""
    placed = running_totals(counts, [], [column], ["n"])
    drawn = rows.withColumn("_draw", F.floor(uniform(F.col("row_id"), seed, f"text/{column}") * F.lit(size)).cast("long"))
    return range_lookup(drawn, "_draw", placed, "before_n", column).drop("_draw")


# ---- joint draws -------------------------------------------------------------------------------------------------


def correlated_normals(rows: DataFrame, names: Sequence[str], mean: Sequence[float], cov: np.ndarray, seed: int, stream: str) -> DataFrame:
    """Add one column per dimension: mean + A z with independent normals z.

    A holds the eigenvectors of the covariance, each times the root of its eigenvalue; a matrix that is not positive
    loses its negative directions.
    """
    values, vectors = np.linalg.eigh(np.asarray(cov, dtype=float))
    factor = vectors * np.sqrt(np.clip(values, 1e-8, None))
    z = [f"_n_{stream}_{j}" for j in range(len(factor))]
    staged = with_draws(rows, {n: normal(F.col("row_id"), seed, f"{stream}/{j}") for j, n in enumerate(z)})
    out = {}
    for i, name in enumerate(names):
        total = F.lit(float(mean[i]))
        for j in range(len(factor)):
            if abs(factor[i, j]) > 1e-15:
                total = total + F.lit(float(factor[i, j])) * cell(z[j])
        out[name] = total
    return with_draws(staged, out).drop(*z)


def normal_scores(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Probit of each value's rank share (ties share their mean rank), per class when a label is given."""
    tag = F.lit("all") if label is None else text_cell(df, label)
    out = df.select(tag.alias("_label"), *[number_cell(df, c).alias(c) for c in columns])
    placed = running_totals(piece_counts(out, columns, ["_label"]), ["_label", "column"], ["value"], ["n"], totals=True, merge=True)
    rank = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("before_n") + (F.col("n") + 1) / 2.0) / F.col("total_n")))
    shares = placed.select("_label", "column", "value", rank.alias("_p"))
    table = shares.select("_label", "column", "value", probit(F.col("_p")).alias("_z"))
    # a column of few values takes its scores from a broadcast table, only the others move the rows
    sizes = {r["column"]: r["k"] for r in placed.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    # shares of all rows, not of a class: at most a thousand values per column, one row per column is broadcast
    grand = placed.groupBy("column").agg(F.sum("n").alias("whole"))
    often = placed.join(F.broadcast(grand), "column").where(F.col("n") * 1000 > F.col("whole"))
    often = pinned(often.select("_label", "column", "value", (F.col("n") / F.col("whole")).alias("_share")))
    for c in columns:
        part = table.where(F.col("column") == c).select("_label", F.col("value").alias(c), F.col("_z").alias(f"z_{c}"))
        if sizes.get(c, 0) <= SMALL_TABLE:
            out = out.join(F.broadcast(part), ["_label", c], "left")
            continue
        hot = often.where(F.col("column") == c).select("_label", F.col("value").alias(c), "_share")
        out = spread_join(out, part, ["_label", c], "left", hot=hot)
    return out.select("_label", *[F.col(f"z_{c}").alias(c) for c in columns])


def copula_fit(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(label, n, col_a, col_b, mean_a, mean_b, cov): shrunk covariances of the normal scores on complete rows.

    Classes need at least columns + 2 rows; without a label there is one class ``all``.
    """
    names = list(columns)
    k = len(names)
    z = normal_scores(df, names, label).dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    structs = [
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.avg(cell(a)).alias("mean_a"), F.avg(cell(b)).alias("mean_b"), F.covar_samp(cell(a), cell(b)).alias("cov"))
        for a, b in pairs
    ]
    grouped = z.groupBy(F.col("_label").alias("label")).agg(F.count("*").alias("n"), F.array(*structs).alias("c")).where(F.col("n") >= k + 2)
    alpha = F.least(F.lit(1.0), F.lit(float(k)) / F.greatest(F.lit(1.0), F.col("n") - F.lit(k + 1.0)))
    flat = grouped.where("label is not null").select("label", "n", F.inline("c"))
    shrunk = F.when(F.col("col_a") == F.col("col_b"), F.col("cov")).otherwise((1.0 - alpha) * F.col("cov"))
    return flat.withColumn("cov", shrunk)


def copula_matrices(fit: DataFrame, columns: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """label -> (mean vector, covariance matrix), both k-sized."""
    names = list(columns)
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in fit.collect():
        mean, cov = out.setdefault(r["label"], (np.zeros(len(names)), np.zeros((len(names), len(names)))))
        i, j = names.index(r["col_a"]), names.index(r["col_b"])
        mean[i], mean[j] = r["mean_a"], r["mean_b"]
        cov[i, j] = cov[j, i] = r["cov"]
    return out


def copula_uniforms(rows: DataFrame, names: Sequence[str], mean: Sequence[float], cov: np.ndarray, seed: int, stream: str = "copula") -> DataFrame:
    """Add correlated uniforms: normals clipped to +-8 through the normal distribution function."""
    z = [f"_z_{n}" for n in names]
    tied = correlated_normals(rows, z, mean, cov, seed, stream)
    clipped = with_draws(tied, {f"{c}_c": F.greatest(F.lit(-8.0), F.least(F.lit(8.0), cell(c))) for c in z})
    return with_draws(clipped, {n: normal_cdf(cell(f"{c}_c")) for n, c in zip(names, z)}).drop(*z, *[f"{c}_c" for c in z])


def copula_sample(rows: DataFrame, curves: dict[str, Sequence[float]], mean: Sequence[float], cov: np.ndarray, seed: int, stream: str = "copula") -> DataFrame:
    """Add all columns of ``curves`` drawn jointly through a Gaussian copula."""
    us = [f"_u_{c}" for c in curves]
    staged = copula_uniforms(rows, us, mean, cov, seed, stream)
    return staged.select("*", *[curve_value(literal(k), cell(u)).alias(c) for (c, k), u in zip(curves.items(), us)]).drop(*us)


def inject_correlation(pairs: DataFrame, columns: Sequence[str], min_abs: float = CORRELATED) -> tuple[list[str], np.ndarray]:
    """Columns tied by |r| >= 0.20 and their correlation matrix (others independent)."""
    rows = [r for r in pairs.collect() if abs(r["value"]) >= min_abs and r["col_a"] in columns and r["col_b"] in columns]
    names = [c for c in columns if any(c in (r["col_a"], r["col_b"]) for r in rows)]
    matrix = np.eye(len(names))
    for r in rows:
        i, j = names.index(r["col_a"]), names.index(r["col_b"])
        matrix[i, j] = matrix[j, i] = r["value"]
    return names, matrix


# ---- category encoding -------------------------------------------------------------------------------------------


def encode_categories(df: DataFrame, columns: Sequence[str], numbers: Sequence[str], target: str | None = None, min_abs: float = STRONG) -> DataFrame:
    """(column, strategy, partner, category, code): a continuous code per category.

    Strongest numeric partner first (conditional mean, James-Stein shrunk from three categories on), then the
    strongest categorical one (mean frequency rank of its values), else the middle of the smoothed cumulative share.
    A regression ``target`` is always tried first. Binary 0/1 partners are passed over.
    """
    names, nums = list(columns), list(numbers)
    spark = df.sparkSession
    counts = value_counts(_melt_filled(df, names))
    k_of = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count("*").alias("k")).collect()}
    binary = {
        c
        for c, row in ((r["column"], r) for r in column_rows(df, nums, lambda c: [F.min(number_cell(df, c).isin(0.0, 1.0)).alias("b")]).collect())
        if row["b"]
    }
    partner: dict[str, str] = {}
    links = cat_num_association(df, [c for c in names if k_of.get(c, 0) > 1], nums).collect() if nums else []
    for c in names:
        options = sorted([(-abs(r["value"]), r["col_b"]) for r in links if r["col_a"] == c and abs(r["value"]) >= min_abs])
        chosen = target if target is not None and target != c else (options[0][1] if options else None)
        if chosen is not None and chosen not in binary:
            partner[c] = chosen
    cat_partner: dict[str, str] = {}
    rest = [c for c in names if k_of.get(c, 0) > 1 and c not in partner]
    if rest:
        strong: dict[str, tuple[float, str]] = {}
        for r in cramers_v(df, [c for c in names if k_of.get(c, 0) > 1]).where(F.col("value") >= min_abs).collect():
            bias = (r["k"] - 1) * (r["r"] - 1) / (r["n"] - 1)
            v = max(0.0, r["value"] ** 2 - bias) ** 0.5
            for a, b in ((r["col_a"], r["col_b"]), (r["col_b"], r["col_a"])):
                if a in rest and v > 0 and (a not in strong or (-v, b) < (-strong[a][0], strong[a][1])):
                    strong[a] = (v, b)
        cat_partner = {c: p for c, (_, p) in strong.items()}

    parts = []
    for c in names:
        if k_of.get(c, 0) == 0:
            continue
        if k_of[c] == 1:
            parts.append(counts.where(F.col("column") == c).select("column", F.lit("constant").alias("strategy"), F.lit(None).cast("string").alias("partner"), F.col("value").alias("category"), F.lit(0.5).alias("code")))
        elif c in partner:
            parts.append(_mean_codes(df, c, partner[c], k_of[c]))
        elif c in cat_partner:
            parts.append(_rank_codes(df, c, cat_partner[c]))
        else:
            parts.append(_share_codes(counts, c, k_of[c]))
    out = spark.createDataFrame([], "column string, strategy string, partner string, category string, code double")
    for p in parts:
        out = out.unionByName(p)
    return out


def _melt_filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    from veilwork.operators.frames import melt_text

    return melt_text(df, names)


def _mean_codes(df, column, partner, k):
    x = number_cell(df, partner)
    mean, var = df.agg(F.avg(x)).scalar(), df.agg(F.var_samp(x)).scalar()
    groups = df.select(text_cell(df, column).alias("category"), x.alias("x")).where("category is not null").groupBy("category").agg(F.count("x").alias("n"), F.avg("x").alias("m"))
    sq = F.col("n") * F.pow(F.col("m") - mean, 2)
    keep = F.greatest(F.lit(0.0), 1.0 - F.lit(float(k - 2)) * var / F.greatest(F.lit(1e-10), sq))
    shrunk = F.when(F.lit(k >= 3) & (var > 0), mean + keep * (F.col("m") - mean)).otherwise(F.col("m"))
    return groups.select(F.lit(column).alias("column"), F.lit("pb_mean").alias("strategy"), F.lit(partner).alias("partner"), "category", F.coalesce(shrunk, mean).alias("code"))


def _rank_codes(df, column, partner):
    both = df.select(text_cell(df, column).alias("category"), text_cell(df, partner).alias("p"))
    freq = both.where("p is not null").groupBy("p").agg(F.count("*").alias("f"))
    ranks = freq.select("p", (F.row_number().over(Window.orderBy(F.desc("f"), "p")) - 1).cast("double").alias("rank"))
    counts = both.where("category is not null and p is not null").groupBy("category", "p").agg(F.count("*").alias("n"))
    codes = counts.join(maybe_broadcast(ranks), "p").groupBy("category").agg((F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("code"))
    return codes.select(F.lit(column).alias("column"), F.lit("cramers_weighted").alias("strategy"), F.lit(partner).alias("partner"), "category", "code")


def _share_codes(counts, column, k):
    own = counts.where(F.col("column") == column)
    total = own.agg(F.sum("n")).scalar()
    p = (F.col("n") + 0.5) / (total + F.lit(k * 0.5))
    shares = running_totals(own.withColumn("p", p).withColumn("_rank", -F.col("n")), ["column"], ["_rank", "value"], ["p"])
    return shares.select(
        F.lit(column).alias("column"), F.lit("cumprob").alias("strategy"), F.lit(None).cast("string").alias("partner"),
        F.col("value").alias("category"), (F.col("before_p") + F.col("p") / 2.0).alias("code"),
    )


def encode(df: DataFrame, codes: DataFrame, column: str, into: str) -> DataFrame:
    """Add the code of each row's category; unknown categories get the mean code."""
    own = codes.where(F.col("column") == column).select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
    mean = own.agg(F.avg("_code")).scalar()
    joined = df.withColumn("_cat", text_cell(df, column)).join(maybe_broadcast(own), "_cat", "left")
    return joined.withColumn(into, F.coalesce("_code", mean)).drop("_cat", "_code")


def decode_categories(rows: DataFrame, code_column: str, codes: Sequence[tuple[str, float]], seed: int | None, stream: str) -> Column:
    """The category of a continuous code: nearest centre, or softmax over distance with temperature min gap / 4."""
    ordered = sorted(codes, key=lambda c: (c[1], c[0]))
    centres = [c for _, c in ordered]
    gaps = [b - a for a, b in zip(centres, centres[1:])]
    heat = max(min(gaps) / 4.0, 1e-8) if gaps else 0.1
    x = F.col(code_column)
    entries = []
    for i, (category, centre) in enumerate(ordered):
        score = -F.abs(x - F.lit(centre)) / F.lit(heat)
        if seed is not None:
            score = score - F.log(-F.log(uniform(F.col("row_id"), seed, f"{stream}/gumbel/{i}")))
        entry = F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(category).alias("c"))
        entries.append(entry)
    best = F.greatest(*entries) if len(entries) > 1 else entries[0]
    return best["c"]


# ---- whole tables ------------------------------------------------------------------------------------------------


@dataclass
class TableModel:
    """Small facts of one fitted table; the conditional tables stay DataFrames."""

    columns: list[str]
    types: dict[str, T.DataType]
    roles: dict[str, str]
    curves: dict[str, list[float]] = field(default_factory=dict)
    whole: set[str] = field(default_factory=set)
    ratios: dict[str, tuple[list, list[float]]] = field(default_factory=dict)
    nulls: dict[str, float] = field(default_factory=dict)
    ids: dict[str, tuple[str, int]] = field(default_factory=dict)
    spans: dict[str, tuple[int, int]] = field(default_factory=dict)
    cat_given: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    num_given: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    tied: list[str] = field(default_factory=list)
    correlation: np.ndarray | None = None
    copula: tuple[list[str], np.ndarray, np.ndarray] | None = None
    null_tied: list[str] = field(default_factory=list)
    null_correlation: np.ndarray | None = None
    coded: dict[str, tuple[list, list[float]]] = field(default_factory=dict)
    wide: list[str] = field(default_factory=list)
    pairs: DataFrame | None = None
    label: str | None = None
    class_rows: DataFrame | None = None
    target: TargetModel | None = None
    source: DataFrame | None = None
    profile: DataFrame | None = None


def dependency_order(partner: dict[str, str], weight: dict[str, float]) -> tuple[list[str], list[str]]:
    """(conditioned columns in drawing order, columns cut loose): each cycle loses its weakest link."""
    links = dict(partner)
    for start in sorted(partner):
        path, at = [], start
        while at in links and at not in path:
            path.append(at)
            at = links[at]
        if at in path:
            cycle = path[path.index(at) :]
            links.pop(min(cycle, key=lambda c: (weight.get(c, 0.0), c)))
    order, left = [], set(links)
    while left:
        ready = sorted(c for c in left if links[c] not in left)
        order += ready
        left -= set(ready)
    return order, sorted(set(partner) - set(links))


def fit(
    df: DataFrame, key: str | None = None, method: str = "conditional", overrides: dict[str, str] | None = None, excluded: Sequence[str] = (), driven: bool = True
) -> TableModel:
    """Reduce a table to the facts the generator needs. Rows marked as generated are refused.

    With ``driven`` a detected target is drawn first and the other columns given it (not with method marginal).
    """
    from veilwork.operators.targeted import fit_target

    if method not in ("marginal", "conditional", "copula"):
        raise ValueError(f"unknown method {method}")
    df = assert_not_generated(df)
    facts = column_facts(df, key)
    kinds = {r["column"]: r for r in classify_columns(facts, overrides, excluded).collect()}
    model = TableModel(df.columns, {f.name: f.dataType for f in df.schema.fields}, {c: kinds[c]["type"] for c in df.columns}, source=df)
    share = column_rows(df, df.columns, lambda c: [F.avg(F.when(cell(c).isNull(), 1.0).otherwise(0.0)).alias("r")]).collect()
    model.nulls = {r["column"]: r["r"] for r in share}
    numbers = [c for c in numeric_columns(df) if model.roles[c] in ("CONTINUOUS_NUMERIC", "DISCRETE_NUMERIC")]
    texts = [c for c in df.columns if model.roles[c] == "LOW_CARD_CATEGORICAL"]
    if numbers:
        model.profile = pinned(profile_numeric(df, numbers))
        for r in model.profile.collect():
            if r["min"] is not None:
                model.curves[r["column"]] = curve_of(r)
                if r["is_integer"]:
                    model.whole.add(r["column"])
        countable = [c for c in model.whole if c in model.curves]
        for r in [] if not countable else value_ratios(df, countable).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("value", "ratio"))).alias("w")).collect():
            model.ratios[r["column"]] = ([w["value"] for w in r["w"]], [w["ratio"] for w in r["w"]])
    if texts:
        full = full_value_distribution(df, texts).select("column", "value", "ratio")
        for r in full.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("value", "ratio"))).alias("w")).collect():
            model.ratios[r["column"]] = ([w["value"] for w in r["w"]], [w["ratio"] for w in r["w"]])
        model.wide = [c for c in texts if c not in model.ratios]
    for c in df.columns:
        if model.roles[c] == "ID_COLUMN":
            model.ids[c] = (kinds[c]["id_strategy"], int(kinds[c]["id_start"] or 0))
    times = [c for c in df.columns if model.roles[c] == "DATETIME"]
    if times:
        ends = df.agg(*[F.struct(F.min(F.unix_micros(cell(c).cast("timestamp"))).alias("a"), F.max(F.unix_micros(cell(c).cast("timestamp"))).alias("b")).alias(f"t{i}") for i, c in enumerate(times)]).first()
        model.spans = {c: (ends[f"t{i}"]["a"], ends[f"t{i}"]["b"]) for i, c in enumerate(times) if ends[f"t{i}"]["a"] is not None}
    holes = [c for c in df.columns if model.nulls[c] > 0.01]
    if len(holes) >= 2:
        rows = null_correlation(df.select(*[cell(c) for c in holes])).collect()
        if len(rows) == len(holes) * (len(holes) - 1) // 2:
            model.null_tied, model.null_correlation = inject_correlation(df.sparkSession.createDataFrame(rows), holes, 0.0)
    smooth = [c for c in numbers if c not in model.ratios and c in model.curves]
    small = [c for c in texts if c in model.ratios and 2 <= len(model.ratios[c][0]) <= 50]
    if len(smooth) >= 2:
        model.pairs = pinned(pearson_pairs(df, smooth))
    ties = pinned(cat_num_association(df, small, smooth)) if small and smooth else None
    found = find_target(df, small, smooth, model, ties) if smooth else None
    target, regression = (None, False) if found is None else (found["column"], found["target_type"] == "regression")
    if target is not None and not regression:
        model.label, model.class_rows = target, class_means(df, target, smooth)
    if method == "marginal":
        return model
    if method == "copula":
        if target is not None and driven:
            code_categories(df, [c for c in small if c != target], smooth, model)
            model.target = fit_target(df, model, target, regression, small, smooth, {}, [], True)
        if model.target is None:
            fit_copula(df, small, smooth, model)
        return model
    best = C.best_partners(cramers_v(df, small)) if len(small) >= 2 else {}
    links = C.best_categories(ties, STRONG) if ties is not None else {}
    if target is not None and driven:
        # what hangs on another column than the target more than on any stays with that column
        best = {c: b for c, b in best.items() if target not in (c, b[0])}
        links = {c: b for c, b in links.items() if target not in (c, b[0])}
    order, _loose = dependency_order({c: p for c, (p, _) in best.items()}, {c: v for c, (_, v) in best.items()})
    if target is not None and driven:
        model.target = fit_target(df, model, target, regression, small, smooth, {c: best[c][0] for c in order}, list(links), False)
        if model.target is not None and model.target.driver in order:
            order.remove(model.target.driver)
    if order:
        table = cut_lineage(C.cond_freq_cat(df, small, partners=best))
        model.order = order
        model.cat_given = {c: (best[c][0], table.where(F.col("column") == c)) for c in order}
    if links:
        # small tables of curves; written once, because every generated batch joins them
        table = cut_lineage(C.cond_profile(df, small, smooth, best=links))
        model.num_given = {c: (p, table.where(F.col("column") == c)) for c, (p, _) in links.items()}
    if model.pairs is not None and model.target is None:
        model.tied, model.correlation = inject_correlation(model.pairs, smooth)
    return model


def find_target(df: DataFrame, small: Sequence[str], smooth: Sequence[str], model: TableModel, ties: DataFrame | None):
    """The row of ``detect_target`` for the fitted columns, or None."""
    spark = df.sparkSession
    none = spark.createDataFrame([], "col_a string, col_b string, value double")
    shown = [(c, str(v)) for c in small for v in model.ratios[c][0]]
    categorical = spark.createDataFrame([(c, len(model.ratios[c][0])) for c in small], "column string, unique_count long")
    pairs = model.pairs if model.pairs is not None else none
    return detect_target(categorical, spark.createDataFrame(shown, "column string, value string"), pairs, ties if ties is not None else none, df.count(), smooth).first()


def class_means(df: DataFrame, label: str, smooth: Sequence[str]) -> DataFrame:
    """(label, column, mean, std) of the numbers in each class."""
    facts = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(number_cell(df, c)).alias("mean"), F.stddev_samp(number_cell(df, c)).alias("std")) for c in smooth])
    grouped = df.where(cell(label).isNotNull()).groupBy(text_cell(df, label).alias("label")).agg(facts.alias("f"))
    return pinned(grouped.select("label", F.inline("f")))


def latent_correlation(cov: np.ndarray, coded: Sequence[bool]) -> np.ndarray:
    """The correlation of the normals behind scores of which some are categories' codes.

    A code's score is nearly the mean of its normal over the category, so a covariance with it is the correlation
    times the score's own variance. The matrix is brought back to a positive one with a unit diagonal.
    """
    var = np.clip(np.diag(cov), 1e-6, None)
    scale = np.where(np.asarray(coded), np.minimum(var, 1.0), np.sqrt(var))
    corr = np.clip(cov / np.outer(scale, scale), -0.99, 0.99)
    np.fill_diagonal(corr, 1.0)
    values, vectors = np.linalg.eigh(corr)
    fixed = (vectors * np.clip(values, 1e-6, None)) @ vectors.T
    size = np.sqrt(np.diag(fixed))
    return fixed / np.outer(size, size)


def code_categories(df: DataFrame, small: Sequence[str], smooth: Sequence[str], model: TableModel) -> None:
    """Sets ``model.coded``: each category's values in the order of their codes, with their shares."""
    coded: dict[str, dict[str, float]] = {}
    for r in encode_categories(df, small, smooth).collect() if small else []:
        coded.setdefault(r["column"], {})[r["category"]] = r["code"]
    # at most 50 values per column; values with one code are told apart by their names
    for c in small:
        share = dict(zip(map(str, model.ratios[c][0]), model.ratios[c][1]))
        ordered = sorted((v for v in coded[c] if v in share), key=lambda v: (coded[c][v], v))
        model.coded[c] = (ordered, [share[v] for v in ordered])


def fit_copula(df: DataFrame, small: Sequence[str], smooth: Sequence[str], model: TableModel) -> None:
    """Numbers and encoded categories under one copula; a category's values lie in the order of their codes."""
    names = [*smooth, *small]
    if len(names) < 2:
        return
    joint = df.select(*[cell(c) for c in names])
    code_categories(df, small, smooth, model)
    if small:
        places = {c: F.create_map(*[F.lit(x) for i, v in enumerate(model.coded[c][0]) for x in (v, float(i))]) for c in small}
        joint = df.select(*[cell(c) for c in smooth], *[places[c][text_cell(df, c)].alias(c) for c in small])
    mats = copula_matrices(copula_fit(joint, names), names)
    if "all" in mats:
        mean, cov = mats["all"]
        is_code = [c in model.coded for c in names]
        model.copula = (names, np.zeros(len(names)), latent_correlation(cov, is_code))
    else:
        model.coded = {}


def draw_rows(spark: SparkSession, model: TableModel, n: int, seed: int, start: int = 0, allow_source_text: bool = False) -> DataFrame:
    """``n`` raw rows (with ``row_id``) from a fitted model, before validation."""
    from veilwork.operators.targeted import draw_given, draw_group

    rows, t = new_rows(spark, n, start), model.target
    if t is not None:
        rows = draw_group(rows, model, t, seed)
    done = set() if t is None else {t.column, *t.categories}
    cats = [c for c in model.columns if model.roles[c] == "LOW_CARD_CATEGORICAL" and c in model.ratios and c not in model.coded and c not in done]
    rows = sample_weighted(rows, {c: model.ratios[c] for c in cats if c not in model.order}, seed)
    for c in model.order:
        given, table = model.cat_given[c]
        freqs = table.select(F.col("given").alias(given), "value", "p")
        rows = sample_conditional_category(rows, c, [given], freqs, seed, model.ratios[c])
    us: dict[str, str] = {}
    if t is not None:
        rows, us = draw_given(rows, model, t, seed)
        done |= {*t.counted, *t.numbers}
    elif model.copula is not None:
        names, mean, cov = model.copula
        us = {c: f"_t_{c}" for c in names}
        rows = copula_uniforms(rows, list(us.values()), mean, cov, seed)
        picks = {c: weighted_pick(F.array(*[F.lit(v) for v in values]), literal(running(w)), cell(us[c])) for c, (values, w) in model.coded.items()}
        rows = with_draws(rows, picks)
    elif len(model.tied) >= 2:
        us = {c: f"_t_{c}" for c in model.tied}
        rows = copula_uniforms(rows, list(us.values()), np.zeros(len(us)), model.correlation, seed)
    discrete = [c for c in model.curves if c in model.ratios and c not in done]
    rows = sample_weighted(rows, {c: model.ratios[c] for c in discrete}, seed)
    alone = {c: k for c, k in model.curves.items() if c not in model.ratios and c not in model.num_given and c not in done}
    rows = sample_numeric(rows, alone, seed, us)
    for c, (given, table) in model.num_given.items():
        profiles = table.withColumnRenamed("given", given).drop("column", "partner", "n", "mean", "std")
        rows = sample_conditional_number(rows, c, [given], profiles, seed, model.curves[c], us.get(c))
    rows = rows.drop(*us.values(), *([t.group] if t is not None and t.edges else []))
    plain = [generate_ids(strategy, seed, c, first).alias(c) for c, (strategy, first) in model.ids.items()]
    plain += [generate_datetimes(a, b, seed, c).alias(c) for c, (a, b) in model.spans.items()]
    rows = rows.select("*", *plain)
    for c in model.columns:
        if c not in rows.columns:
            pooled = model.roles[c] in ("FREE_TEXT", "HIGH_CARD_CATEGORICAL") and hint_category(c) is None
            rows = sample_text(rows, model.source, c, seed, c in model.wide or (allow_source_text and pooled))
    return round_and_fill(inject_nulls(rows, model.nulls, seed, model.null_correlation, model.null_tied), model)


def round_and_fill(rows: DataFrame, model: TableModel) -> DataFrame:
    """Whole-number columns rounded, missing numbers of null-free columns set to the median, source types restored."""
    out = []
    for c in rows.columns:
        value = cell(c)
        if c in model.curves:
            if model.nulls.get(c, 0.0) == 0.0:
                value = F.coalesce(value, F.lit(model.curves[c][8]))
            if c in model.whole:
                value = F.round(value, 0)
        dtype = model.types.get(c)
        out.append((value.cast(dtype) if dtype is not None else value).alias(c))
    return rows.select(*out)


def bootstrap_independent(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Every column drawn alone: numbers from their curve without jitter, categories from their frequencies."""
    numbers = numeric_columns(df)
    rows = new_rows(df.sparkSession, n)
    curves = {r["column"]: curve_of(r) for r in profile_numeric(df, numbers).collect() if r["min"] is not None} if numbers else {}
    others = [c for c in df.columns if c not in numbers]
    table = pinned(full_value_distribution(df, others)) if others else None
    few = {r["column"] for r in table.select("column").distinct().collect()} if others else set()
    staged = with_draws(rows, {f"_u_{c}": uniform(F.col("row_id"), seed, c) for c in curves})
    out = staged.select("row_id", *[curve_value(literal(k), cell(f"_u_{c}")).alias(c) for c, k in curves.items()])
    if few:
        out = sample_weighted(out, {c: weight_table(table, c) for c in others if c in few}, seed)
    for c in others:
        if c not in few:  # all values, met by number; a column of nulls stays null
            out = sample_text(out, df, c, seed, True)
    return out.select("row_id", *curves, *others)


def sample_by_label(df: DataFrame, label: str, columns: Sequence[str], numbers: Sequence[str], n: int, seed: int) -> DataFrame:
    """Rows drawn label first, then every category and number given the label."""
    spark = df.sparkSession
    known = pinned(full_value_distribution(df, [label]))
    rows = new_rows(spark, n)
    rows = sample_text(rows, df, label, seed, True) if known.isEmpty() else sample_categorical(rows, known, label, seed)
    freqs = C.class_freq(df, label, columns, max_values=None).withColumnRenamed("label", label) if columns else None
    stats = C.class_stats(df, label, numbers).withColumnRenamed("label", label)
    for c in columns:
        rows = sample_conditional_category(rows, c, [label], freqs.where(F.col("column") == c).select(label, "value", "p"), seed)
    for c in numbers:
        rows = sample_conditional_number(rows, c, [label], stats.where(F.col("column") == c).drop("column", "n", "mean", "std"), seed)
    return rows


def sample_by_target(df: DataFrame, target: str, columns: Sequence[str], numbers: Sequence[str], n: int, seed: int) -> DataFrame:
    """Rows drawn from a binned regression target: bin, driver category, target inside the bin, then the rest."""
    spark = df.sparkSession
    bins = C.quantile_bins(df, target, max(1, len(columns)))
    edges_rows = bins.orderBy("bin").collect()
    edges = [edges_rows[0]["lo"]] + [r["hi"] for r in edges_rows]
    binned = df.withColumn("_bin", C.bin_of(number_cell(df, target), edges).cast("string"))
    driver_row = C.variance_driver(df, target, columns).first() if columns else None
    driver = driver_row["column"] if driver_row else None
    rows = sample_categorical(new_rows(spark, n), full_value_distribution(binned, ["_bin"]), "_bin", seed)
    freqs = C.class_freq(binned, "_bin", columns, C.REGRESSION_PULL, max_values=None).withColumnRenamed("label", "_bin") if columns else None
    for c in columns:
        rows = sample_conditional_category(rows, c, ["_bin"], freqs.where(F.col("column") == c).select("_bin", "value", "p"), seed)
    whole = curve_of(profile_numeric(df, [target]).first())
    if driver:
        cells = C.target_quantiles(df, target, driver, bins).select(F.col("bin").cast("string").alias("_bin"), F.col("given").alias(driver), "min", "max", *C.PROB_NAMES)
        rows = sample_conditional_number(rows, target, ["_bin", driver], cells, seed, whole)
    else:
        rows = sample_numeric(rows, {target: whole}, seed)
    limits = spark.createDataFrame([(str(r["bin"]), r["lo"], r["hi"]) for r in edges_rows], "_bin string, _lo double, _hi double")
    rows = rows.join(F.broadcast(limits), "_bin")
    rows = rows.withColumn(target, F.greatest("_lo", F.least("_hi", cell(target)))).drop("_lo", "_hi")
    stats = C.class_stats(binned, "_bin", numbers).withColumnRenamed("label", "_bin")
    for c in numbers:
        rows = sample_conditional_number(rows, c, ["_bin"], stats.where(F.col("column") == c).drop("column", "n", "mean", "std"), seed)
    return rows.withColumnRenamed("_bin", "target_bin")


def first_rows(rows: DataFrame, n: int, id_column: str = "row_id", width: int = 1_000_000) -> DataFrame:
    """The n rows with the smallest ids, found by counting id ranges instead of sorting everything into one task."""
    low, size = 0, None
    need = n
    span = rows.agg(F.min(id_column).alias("a"), F.max(id_column).alias("b")).first()
    if span["a"] is None:
        return rows
    low, high = span["a"], span["b"] + 1
    while high - low > width:
        step = max(1, -(-(high - low) // 1000))
        part = rows.where((F.col(id_column) >= low) & (F.col(id_column) < high))
        buckets = part.groupBy(F.floor((F.col(id_column) - low) / step).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
        size = sum(b["n"] for b in buckets)
        if size <= need:
            return rows.where(F.col(id_column) < high)
        for b in buckets:
            if need - b["n"] < 0:
                low, high = low + b["b"] * step, min(high, low + (b["b"] + 1) * step)
                break
            need -= b["n"]
        if step == 1:
            break
    rest = rows.where((F.col(id_column) >= low) & (F.col(id_column) < high)).select(id_column).orderBy(id_column).limit(need)
    cut = rest.agg(F.max(id_column)).first()[0]
    return rows.where(F.col(id_column) <= (cut if cut is not None else low - 1))


def generate(
    df: DataFrame, n: int, seed: int = 42, key: str | None = None, method: str = "conditional", rules: Sequence[dict] = (),
    overrides: dict[str, str] | None = None, excluded: Sequence[str] = (), allow_source_text: bool = False, max_rounds: int = 8, driven: bool = True,
) -> DataFrame:
    """``n`` validated synthetic rows, marked as generated; an error when the rounds do not yield enough.

    The first round draws at most half as many rows again as requested; later rounds draw only for the deficit. A round
    goes in steps of as many rows as the share accepted so far calls for: draws are numbered, so that the accepted rows
    do not hang on the steps. Accepted rows are written once per step, so later steps never draw again.
    """
    from veilwork.operators import validate as V

    spark = df.sparkSession
    model = fit(df, key, method, overrides, excluded, driven)
    limits = pinned(constraints(df))
    profile = model.profile if model.curves else None
    compared = [c for c in df.columns if c not in model.ids]
    names = [c for c in df.columns if c in model.ratios and model.roles[c] == "LOW_CARD_CATEGORICAL"]
    shares = [(c, str(v), float(p)) for c in names for v, p in zip(*model.ratios[c])]
    distribution = spark.createDataFrame(shares, "column string, value string, ratio double")
    accepted, have, start = None, 0, 0
    for turn in range(max_rounds):
        end = start + max(1, int((n - have) * (1.5 if turn == 0 else 2.0)) + 8)
        while start < end:
            share = max(have / start, 0.5) if start else 1.0
            want = min(end - start, int((n - have) / share * SLACK) + 8)
            raw = draw_rows(spark, model, want, seed, start, allow_source_text)
            checked = V.validate(
                raw, df, limits, profile, "row_id", seed, compared=compared, rules=rules, pairs=model.pairs, distribution=distribution,
                label=model.label, class_rows=model.class_rows,
            )
            part = cut_lineage(checked)
            accepted = part if accepted is None else accepted.unionByName(part)
            have, start = have + part.count(), start + want
            if have >= n:
                return tag_origin(first_rows(accepted, n).select("row_id", *df.columns))
    raise RuntimeError(f"only {have} of {n} rows accepted after {max_rounds} rounds")


__all__ = [
    "TableModel", "association_columns", "bootstrap_independent", "copula_fit", "copula_matrices", "copula_sample", "decode_categories",
    "dependency_order", "draw_rows", "encode", "encode_categories", "first_rows", "fit", "generate", "generate_datetimes", "generate_ids",
    "inject_correlation", "inject_nulls", "new_rows", "round_and_fill", "sample_by_label", "sample_by_target", "sample_categorical",
    "sample_conditional_category", "sample_conditional_number", "sample_integers", "sample_numeric", "sample_text", "sample_weighted",
    "weight_table", "with_draws",
]
