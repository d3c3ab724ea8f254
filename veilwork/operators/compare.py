"""Fidelity, leakage and drift between two versions of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.numeric import clamp, is_numeric_type
from veilwork.operators.association import pearson_pairs
from veilwork.operators.frames import (
    cell,
    column_rows,
    melt_numbers,
    melt_text,
    number_cell,
    numeric_columns,
    other_columns,
    piece_counts,
    spread_join,
    task_count,
    text_cell,
    value_counts,
    whole_counts,
)
from veilwork.session import cut_lineage

ORIGIN = "_origin"
GENERATED = "generated"
TINY = 1e-10


def shared_columns(original: DataFrame, synthetic: DataFrame) -> list[str]:
    return [c for c in original.columns if c in synthetic.columns]


def comparable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Numbers rounded to four decimals, everything else as text; nulls stay null and equal each other."""
    out = []
    for c in columns:
        if is_numeric_type(df.schema[c].dataType):
            out.append((F.round(number_cell(df, c), 4) + F.lit(0.0)).alias(c))
        else:
            out.append(text_cell(df, c).alias(c))
    return out


def _hashed(df: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
    """(more.., _row, _h): the compared cells of each row and their hash."""
    rows = df.select(*[cell(c) for c in more], F.struct(*comparable(df, names)).alias("_row"))
    return rows.select("*", F.xxhash64("_row").alias("_h"))


def _shared_hashes(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The hashes ``_h`` that come on both sides, each once and written; only hashes are shuffled, never rows."""
    sides = original.select("_h", F.lit(1).alias("_side")).union(synthetic.select("_h", F.lit(2).alias("_side")))
    return cut_lineage(sides.groupBy("_h").agg(F.bit_or("_side").alias("_side")).where("_side = 3").select("_h"))


def exact_copy_rate(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(copies, rows, rate): synthetic rows equal to any original row.

    Only rows whose hash comes on both sides can be equal. They are collapsed into one grouping by the full row, so
    repeated rows cost nothing extra. Both tables are read twice.
    """
    names = list(columns or shared_columns(original, synthetic))
    o, s = _hashed(original, names), _hashed(synthetic, names)
    both = _shared_hashes(o, s)
    side = lambda df, a, b: spread_join(df, both, ["_h"], "left_semi").select("_h", "_row", F.lit(a).alias("_o"), F.lit(b).alias("_s"))
    rows = side(o, 1, 0).unionByName(side(s, 0, 1)).groupBy("_h", "_row").agg(F.max("_o").alias("_o"), F.sum("_s").alias("_s"))
    copies = rows.agg(F.coalesce(F.sum(F.when(F.col("_o") == 1, F.col("_s"))), F.lit(0)).alias("copies"))
    out = copies.crossJoin(F.broadcast(synthetic.agg(F.count(F.lit(1)).alias("rows"))))
    return out.withColumn("rate", F.col("copies") / F.greatest(F.col("rows"), F.lit(1)))


def drop_copies(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Synthetic rows that equal no original row, compared in full (never by hash alone).

    Original rows whose hash no synthetic row has are left out before the comparison. Both tables are read twice.
    """
    names = list(columns or shared_columns(original, synthetic))
    o, s = _hashed(original, names), _hashed(synthetic, names, *synthetic.columns)
    known = cut_lineage(spread_join(o, _shared_hashes(o, s), ["_h"], "left_semi").select("_h", "_row").distinct())
    return spread_join(s, known, ["_h", "_row"], "left_anti").select(*[cell(c) for c in synthetic.columns])


def side_pieces(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_o, n_s) of the numbers of both sides, written; a value comes once a chunk."""
    n, none = F.col("n"), F.lit(0).cast("long")
    o = piece_counts(original, columns).select("column", "value", n.alias("n_o"), none.alias("n_s"))
    s = piece_counts(synthetic, columns).select("column", "value", none.alias("n_o"), n.alias("n_s"))
    return cut_lineage(o.unionByName(s))


def side_counts(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], numeric: bool) -> DataFrame:
    """(column, value, n_o, n_s) over the union of the values of both sides."""
    if numeric:
        return whole_counts(side_pieces(original, synthetic, columns))
    melt = melt_text
    o = melt(original, columns).withColumn("s", F.lit(0))
    s = melt(synthetic, columns).withColumn("s", F.lit(1))
    return o.unionByName(s).groupBy("column", "value").agg(F.sum(1 - F.col("s")).alias("n_o"), F.sum("s").alias("n_s"))


def _divergence(parts: DataFrame, keys: Sequence[str], inner: float) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of the normalised columns p and q, summed per key."""
    m = 0.5 * (F.col("p") + F.col("q"))
    term = lambda x: x * F.log(x / m + F.lit(inner))
    return parts.groupBy(*keys).agg((0.5 * F.sum(term(F.col("p"))) + 0.5 * F.sum(term(F.col("q")))).alias("js"))


def js_numeric(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None, bins: int = 20, variant: str = "evaluation"
) -> DataFrame:
    """(column, js) over equal-width bins of the joint range.

    ``evaluation`` clamps to 0..1; ``leakage`` adds 1e-10 inside the logarithm and does not clamp.
    """
    names = list(columns or [c for c in numeric_columns(original) if c in synthetic.columns])
    counts = side_counts(original, synthetic, names, numeric=True)
    edges = counts.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n_o").alias("t_o"), F.sum("n_s").alias("t_s")
    )
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    placed = (
        counts.join(F.broadcast(edges), "column")
        .where("hi > lo")
        .groupBy("column", at.alias("bin"))
        .agg(F.sum("n_o").alias("n_o"), F.sum("n_s").alias("n_s"))
    )
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(placed, ["column", "bin"], "left")
    width = (F.col("hi") - F.col("lo")) / bins
    density = lambda n, t: F.coalesce(F.col(n), F.lit(0)) / F.col(t) / width + F.lit(TINY)
    usable = grid.where((F.col("hi") > F.col("lo")) & (F.col("t_o") > 0) & (F.col("t_s") > 0))
    raw = usable.select("column", density("n_o", "t_o").alias("p0"), density("n_s", "t_s").alias("q0"))
    total = raw.groupBy("column").agg(F.sum("p0").alias("ps"), F.sum("q0").alias("qs"))
    parts = raw.join(F.broadcast(total), "column").select("column", (F.col("p0") / F.col("ps")).alias("p"), (F.col("q0") / F.col("qs")).alias("q"))
    js = _divergence(parts, ["column"], 0.0 if variant == "evaluation" else TINY)
    value = F.coalesce("js", F.lit(0.0))
    return edges.select("column").join(js, "column", "left").select(
        "column", (clamp(value, 0.0, 1.0) if variant == "evaluation" else value).alias("js")
    )


def js_categorical(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None, variant: str = "evaluation"
) -> DataFrame:
    """(column, js) over the union of the values; 1e-10 goes on counts (evaluation) or on ratios (leakage)."""
    names = list(columns or [c for c in other_columns(original) if c in synthetic.columns])
    counts = side_counts(original, synthetic, names, numeric=False)
    totals = counts.groupBy("column").agg(F.sum("n_o").alias("t_o"), F.sum("n_s").alias("t_s"), F.count("*").alias("k"))
    j = counts.join(F.broadcast(totals), "column")
    if variant == "evaluation":
        share = lambda n, t: (F.col(n) + F.lit(TINY)) / (F.col(t) + F.col("k") * F.lit(TINY))
    else:
        share = lambda n, t: (F.coalesce(F.try_divide(n, t), F.lit(0.0)) + F.lit(TINY)) / (F.when(F.col(t) > 0, 1.0).otherwise(0.0) + F.col("k") * F.lit(TINY))
    parts = j.select("column", share("n_o", "t_o").alias("p"), share("n_s", "t_s").alias("q"), "t_o", "t_s")
    js = _divergence(parts, ["column"], 0.0 if variant == "evaluation" else TINY)
    if variant != "evaluation":
        return js
    filled = totals.select("column", ((F.col("t_o") > 0) & (F.col("t_s") > 0)).alias("both"))
    return js.join(F.broadcast(filled), "column").select("column", F.when(F.col("both"), clamp(F.col("js"), 0.0, 1.0)).otherwise(0.0).alias("js"))


def column_drift(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, kind, drift) for all shared columns, rounded to four digits."""
    numbers = [c for c in numeric_columns(original) if c in synthetic.columns]
    others = [c for c in other_columns(original) if c in synthetic.columns]
    parts = []
    if numbers:
        parts.append(js_numeric(original, synthetic, numbers, variant="leakage").withColumn("kind", F.lit("numeric")))
    if others:
        parts.append(js_categorical(original, synthetic, others, variant="leakage").withColumn("kind", F.lit("categorical")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("column", "kind", (F.round("js", 4) + F.lit(0.0)).alias("drift"))


def drift_level(drift: Column) -> Column:
    return F.when(drift < 0.05, "low").when(drift < 0.15, "moderate").otherwise("high")


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(F.avg("drift").alias("avg_drift"), F.max("drift").alias("max_drift")).withColumn("level", drift_level(F.col("avg_drift")))


def ks_statistic(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """(column, ks): largest gap between the two empirical distribution functions."""
    names = list(columns or [c for c in numeric_columns(original) if c in synthetic.columns])
    pieces = side_pieces(original, synthetic, names)
    # one row per column
    sums = pieces.groupBy("column").agg(F.sum("n_o").alias("t_o"), F.sum("n_s").alias("t_s")).where("t_o > 0 and t_s > 0").collect()
    ends = _sorted_ends(pieces, {r["column"]: (r["t_o"], r["t_s"]) for r in sums})
    before = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rank = lambda side, end: (F.col(f"{end}_{side}") + F.coalesce(F.sum(f"sum_{side}").over(before), F.lit(0))) / F.col(f"t_{side}")
    gaps = [F.abs(rank("o", end) - rank("s", end)) for end in ("hi", "lo")]
    return ends.select("column", F.greatest(*gaps).alias("ks")).groupBy("column").agg(F.max("ks").alias("ks"))


def _sorted_ends(pieces: DataFrame, totals: dict[str, tuple[int, int]]) -> DataFrame:
    """(column, _part, sum_o, sum_s, hi_o, hi_s, lo_o, lo_s, t_o, t_s) of the columns in ``totals``, a row per column and
    part of the sorted values: its counts, and the running counts where the first side is ahead and behind the most.

    What the parts before add to a difference of shares is the same all over a part, so no other value of it can have
    the largest gap. The sorted values stream by and are not written.
    """
    fields = [f"{end}_{side}" for end in ("sum", "hi", "lo") for side in ("o", "s")]
    schema = f"column string, _part int, {', '.join(f'{x} long' for x in [*fields, 't_o', 't_s'])}"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, open_at, part = {}, None, None

        def meet(name, run_o, run_s):
            t_o, t_s = totals[name]
            ahead, found = run_o / t_o - run_s / t_s, state[name]
            if len(ahead):
                hi, lo = int(ahead.argmax()), int(ahead.argmin())
                if ahead[hi] > found["hi"][0]:
                    found["hi"] = (ahead[hi], int(run_o[hi]), int(run_s[hi]))
                if ahead[lo] < found["lo"][0]:
                    found["lo"] = (ahead[lo], int(run_o[lo]), int(run_s[lo]))

        def close():
            # equal values may go on in the next batch, so the last one counts when another follows
            if open_at is not None:
                meet(open_at[0], *(np.array([x]) for x in state[open_at[0]]["sum"]))

        for batch in batches:
            if not batch.num_rows:
                continue
            part, coded = batch.column("_part")[0].as_py(), batch.column("column").dictionary_encode()
            code, labels = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            value, n_o, n_s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "n_o", "n_s"))
            starts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), len(code)]
            for a, b in zip(starts, starts[1:]):
                name = labels[code[a]]
                if open_at != (name, value[a]):
                    close()
                found = state.setdefault(name, {"sum": (0, 0), "hi": (-np.inf, 0, 0), "lo": (np.inf, 0, 0)})
                run_o, run_s = found["sum"][0] + np.cumsum(n_o[a:b]), found["sum"][1] + np.cumsum(n_s[a:b])
                last = np.flatnonzero(value[a + 1 : b] != value[a : b - 1])
                meet(name, run_o[last], run_s[last])
                found["sum"], open_at = (int(run_o[-1]), int(run_s[-1])), (name, value[b - 1])
        close()
        rows = [(name, part, *f["sum"], *f["hi"][1:], *f["lo"][1:], *totals[name]) for name, f in state.items()]
        if rows:
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * (len(fields) + 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["column", "_part", *fields, "t_o", "t_s"])

    places = ["column", "value"]
    ranged = pieces.where(F.col("column").isin(list(totals))).repartitionByRange(task_count(pieces), *places).sortWithinPartitions(*places)
    return ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(ends, schema)


def category_max_gap(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, gap): largest share difference over the original categories; shares are of all rows."""
    names = list(columns or [c for c in other_columns(original) if c in synthetic.columns])
    counts = side_counts(original, synthetic, names, numeric=False)
    totals = counts.groupBy("column").agg(F.sum("n_o").alias("t_o"))
    rows = synthetic.agg(F.count("*")).scalar()
    j = counts.where("n_o > 0").join(F.broadcast(totals), "column")
    gap = F.abs(F.col("n_o") / F.col("t_o") - F.col("n_s") / F.greatest(rows, F.lit(1)))
    # a projection of its own: a subquery over rows that were dealt or drawn may not stand inside an aggregate
    return j.select("column", gap.alias("gap")).groupBy("column").agg(F.max("gap").alias("gap"))


def fidelity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, kind, gap, label) per shared column: KS for numbers, largest share gap for categories."""
    ks = ks_statistic(original, synthetic).select("column", F.lit("numeric").alias("kind"), F.col("ks").alias("gap"))
    gaps = category_max_gap(original, synthetic).select("column", F.lit("categorical").alias("kind"), "gap")
    label = F.when(F.col("gap") < 0.05, "PASS").when(F.col("gap") < 0.15, "WARN").otherwise("FAIL")
    return ks.unionByName(gaps).withColumn("label", label)


def fidelity_pct(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("columns"),
        F.avg("gap").alias("avg_gap"),
        F.round((1.0 - F.least(F.lit(1.0), F.avg("gap") * 2.0)) * 100.0, 0).alias("fidelity_pct"),
    )


def range_adherence(constraints: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_oob, oob_rate, passed): values outside the constraint range; below 1 % passes."""
    names = list(columns or numeric_columns(synthetic))
    ranges = constraints.where("kind = 'range'").select("column", "lo", "hi")
    counts = value_counts(melt_numbers(synthetic, names)).join(F.broadcast(ranges), "column")
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    sums = counts.groupBy("column").agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_oob"), F.sum("n").alias("total"))
    rate = F.col("n_oob") / F.greatest(F.col("total"), F.lit(1))
    return sums.select("column", "n_oob", F.round(rate, 4).alias("oob_rate"), (rate < 0.01).alias("passed"))


def category_adherence(constraints: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_invented, inv_rate, passed): values outside the allowed set; any one fails."""
    names = list(columns or other_columns(synthetic))
    allowed = constraints.where("kind = 'allowed'").select("column", F.explode("allowed").alias("value"), F.lit(True).alias("known"))
    checked = constraints.where("kind = 'allowed'").select("column")
    counts = value_counts(melt_text(synthetic, names)).join(F.broadcast(checked), "column", "left_semi")
    joined = counts.join(F.broadcast(allowed), ["column", "value"], "left")
    sums = joined.groupBy("column").agg(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("n_invented"), F.sum("n").alias("total"))
    rate = F.col("n_invented") / F.greatest(F.col("total"), F.lit(1))
    return sums.select("column", "n_invented", F.round(rate, 4).alias("inv_rate"), (F.col("n_invented") == 0).alias("passed"))


def linear_fit(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0, standardise: bool = False) -> tuple[list[float], float]:
    """Coefficients and intercept from one pass of means and covariances; only a k x k system reaches the driver."""
    names = [*features, target]
    x = {c: F.coalesce(number_cell(df, c), F.lit(0.0)) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    k = len(features)
    cov = np.zeros((k + 1, k + 1))
    for i, (a, b) in enumerate(pairs):
        p, q = names.index(a), names.index(b)
        cov[p, q] = cov[q, p] = row[f"c{i}"] or 0.0
    scale = np.sqrt(np.diag(cov)[:k]) if standardise else np.ones(k)
    scale[scale == 0] = 1.0
    gram = cov[:k, :k] / np.outer(scale, scale) * row["n"]
    right = cov[:k, k] / scale * row["n"]
    weights = np.linalg.lstsq(gram + ridge * np.eye(k), right, rcond=None)[0] / scale
    means = [row[f"m{i}"] or 0.0 for i in range(k + 1)]
    return [float(w) for w in weights], float(means[k] - np.dot(weights, means[:k]))


def r_squared(df: DataFrame, features: Sequence[str], target: str, weights: Sequence[float], intercept: float) -> DataFrame:
    """(r2) of given coefficients on ``df``; nulls count as zero."""
    y = F.coalesce(number_cell(df, target), F.lit(0.0))
    guess = F.lit(intercept)
    for c, w in zip(features, weights):
        guess = guess + F.coalesce(number_cell(df, c), F.lit(0.0)) * F.lit(w)
    total = F.var_pop(y) * F.count(F.lit(1))
    return df.agg((1.0 - F.sum(F.pow(y - guess, 2)) / F.greatest(total, F.lit(1e-10))).alias("r2"))


#: Parts of column names that hint at a target (fixed values).
TARGET_HINTS = ("charge", "price", "salary", "cost", "income", "revenue", "target", "label", "score", "value", "amount")


def target_columns(df: DataFrame) -> DataFrame:
    """(column, hinted, choice) of the numeric columns: those with a hint come first, in table order, then the rest from
    the last one back."""
    places = df.sparkSession.createDataFrame(list(enumerate(numeric_columns(df))), "place int, column string")
    hinted = F.lower("column").rlike("|".join(TARGET_HINTS))
    order = Window.orderBy(hinted.desc(), F.when(hinted, F.col("place")).otherwise(-F.col("place")))
    return places.select("column", hinted.alias("hinted"), F.row_number().over(order).alias("choice"))


def tstr_r2(original: DataFrame, synthetic: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """(target, r2): ridge (alpha 1, standardised) trained on synthetic, scored on original; null below two features.

    Without a target, the numeric column whose name suggests one is taken.
    """
    if target is None:
        first = target_columns(original).where("choice = 1").first()
        target = first["column"] if first else None
    names = list(features or [c for c in numeric_columns(original) if c != target and c in synthetic.columns])
    if len(names) < 2:
        return original.sparkSession.createDataFrame([(target, None)], "target string, r2 double")
    weights, intercept = linear_fit(synthetic, names, target, ridge=1.0, standardise=True)
    return r_squared(original, names, target, weights, intercept).select(F.lit(target).alias("target"), "r2")


def evaluation_verdict(js: DataFrame, ranges: DataFrame, categories: DataFrame, copies: DataFrame, extra_warnings: int = 0) -> DataFrame:
    """(js_fails, range_fails, invented, warnings, verdict) from the four partial checks.

    ``js`` is (column, kind, js). FAIL on an invented category or more than 40 % copies; WARN on any failed
    column or more than three warnings.
    """
    bad_js = js.agg(F.count(F.when(F.col("js") >= F.when(F.col("kind") == "numeric", 0.25).otherwise(0.20), 1))).scalar()
    bad_range = ranges.agg(F.count(F.when(~F.col("passed"), 1))).scalar()
    invented = categories.agg(F.count(F.when(~F.col("passed"), 1))).scalar()
    out = copies.select(
        "rate", bad_js.alias("js_fails"), bad_range.alias("range_fails"), invented.alias("invented"),
    )
    warnings = F.col("range_fails") + F.when(F.col("rate") > 0.10, 1).otherwise(0) + F.lit(extra_warnings)
    verdict = (
        F.when((F.col("invented") > 0) | (F.col("rate") > 0.40), "FAIL")
        .when((F.col("js_fails") > 0) | (F.col("range_fails") > 0) | (F.col("warnings") > 3), "WARN")
        .otherwise("PASS")
    )
    return out.withColumn("warnings", warnings.cast("long")).withColumn("verdict", verdict)


def correlation_gap(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(gap): mean absolute difference of the two correlation matrices, undefined entries as zero."""
    names = list(columns or [c for c in numeric_columns(original) if c in synthetic.columns])
    a = pearson_pairs(original, names).select("col_a", "col_b", F.col("value").alias("a"))
    b = pearson_pairs(synthetic, names).select("col_a", "col_b", F.col("value").alias("b"))
    j = a.join(b, ["col_a", "col_b"], "full")
    off = F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.lit(0.0))
    # constant columns have no defined diagonal: 1 on one side and 0 on the other
    def constant(df):
        return column_rows(df, names, lambda c: [F.coalesce(F.var_pop(number_cell(df, c)) > 0, F.lit(False)).alias("varies")])

    d = constant(original).join(constant(synthetic).withColumnRenamed("varies", "other"), "column")
    diagonal = d.agg(F.count(F.when(F.col("varies") != F.col("other"), 1))).scalar()
    return j.agg(((2.0 * off + diagonal) / float(len(names) ** 2)).alias("gap"))


def unique_row_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, ratio)."""
    names = list(columns or df.columns)
    groups = df.groupBy(*[cell(c) for c in names]).agg(F.count("*").alias("_n"))
    out = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return out.withColumn("ratio", F.col("distinct_rows") / F.greatest(F.col("rows"), F.lit(1)))


def overfitting_score(original: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(avg_js, max_js, corr_gap, unique_ratio, score, failed) against the real original."""
    names = list(columns or [c for c in numeric_columns(original) if c in synthetic.columns])
    js = js_numeric(original, synthetic, names).agg(F.avg("js").alias("avg_js"), F.max("js").alias("max_js"))
    gap = correlation_gap(original, synthetic, names).scalar()
    unique = unique_row_ratio(synthetic).select("ratio").scalar()
    out = js.select("avg_js", "max_js", gap.alias("corr_gap"), unique.alias("unique_ratio"))
    parts = [F.col("avg_js") / 0.30, F.col("corr_gap") / 0.40, F.greatest(F.lit(0.0), (0.01 - F.col("unique_ratio")) / 0.01)]
    score = sum(parts, F.lit(0.0)) / 3.0
    failed = (F.col("max_js") > 0.30) | (F.col("corr_gap") > 0.40) | (F.col("unique_ratio") < 0.01) | (F.col("score") > 0.60)
    return out.withColumn("score", score).withColumn("failed", failed)


def entropy_diversity(df: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(column, entropy, collapsed): normalised entropy per column that has at least two values.

    Numbers fall into min(20, distinct) equal-width bins. Below 0.05 a column counts as collapsed unless its
    ``baseline`` entropy (column, entropy) explains it: unknown, or at most 1/0.3 times the value found.
    """
    numbers, others = numeric_columns(df), other_columns(df)
    parts = []
    if numbers:
        counts = value_counts(melt_numbers(df, [c for c in numbers if not c.startswith("_")]))
        edges = counts.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("k"))
        j = counts.join(F.broadcast(edges), "column").where("k > 1")
        bins = F.least(F.lit(20), F.col("k"))
        at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), bins - 1)
        parts.append(j.groupBy("column", at.cast("string").alias("cell")).agg(F.sum("n").alias("n")))
    if others:
        counts = value_counts(melt_text(df, [c for c in others if not c.startswith("_")]))
        many = counts.groupBy("column").agg(F.count("*").alias("k")).where("k > 1").select("column")
        parts.append(counts.join(F.broadcast(many), "column", "left_semi").select("column", F.col("value").alias("cell"), "n"))
    cells = reduce(DataFrame.unionByName, parts)
    totals = cells.groupBy("column").agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    p = F.col("n") / F.col("t")
    sums = cells.join(F.broadcast(totals), "column").groupBy("column").agg(
        (-F.sum(p * F.log2(p + F.lit(1e-12)))).alias("h"), F.first("k").alias("k"), F.first("t").alias("t")
    )
    entropy = F.col("h") / F.when(F.col("k") > 1, F.log2("k")).otherwise(1.0)
    rows = sums.where("t >= 2").select("column", entropy.alias("entropy"))
    if baseline is None:
        return rows.withColumn("collapsed", F.col("entropy") < 0.05)
    base = baseline.select("column", F.col("entropy").alias("base"))
    explained = F.col("base").isNull() | ((F.col("base") > 0) & (F.col("entropy") >= F.col("base") * 0.30))
    return rows.join(F.broadcast(base), "column", "left").select(
        "column", "entropy", ((F.col("entropy") < 0.05) & ~explained).alias("collapsed")
    )


def baseline_entropy(profile: DataFrame | None, top: DataFrame | None) -> DataFrame:
    """(column, entropy) from stored statistics: steps between seven percentiles, or the top value shares."""
    parts = []
    if profile is not None:
        marks = F.array_sort(F.array(*[F.col(q) for q in ("q01", "q05", "q25", "q50", "q75", "q95", "q99")]))
        steps = F.filter(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.get(marks, i) - F.get(marks, i - 1)), lambda d: d > 0)
        parts.append(profile.select("column", steps.alias("w"), (F.col("max") - F.col("min")).alias("span"), "std"))
    if top is not None:
        parts.append(
            top.groupBy("column").agg(F.sort_array(F.collect_list("ratio")).alias("w")).select(
                "column", "w", F.lit(0.0).alias("span"), F.lit(0.0).alias("std")
            )
        )
    rows = reduce(DataFrame.unionByName, parts)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    h = -F.aggregate("w", F.lit(0.0), lambda a, x: a + x / total * F.log2(x / total + F.lit(1e-12)))
    spread = F.when((F.col("span") > 0) & (F.col("std") / F.col("span") >= 0.01), F.lit(0.5))
    return rows.select("column", F.when(F.size("w") >= 2, h / F.log2(F.size("w"))).otherwise(spread).alias("entropy"))


def tag_origin(df: DataFrame) -> DataFrame:
    return df.withColumn(ORIGIN, F.lit(GENERATED))


def origin_purity(df: DataFrame) -> DataFrame:
    """(rows, generated, contamination_rate, pure): whether a table holds rows marked as generated."""
    if ORIGIN not in df.columns:
        return df.agg(F.count("*").alias("rows"), F.lit(0).cast("long").alias("generated"), F.lit(0.0).alias("contamination_rate"), F.lit(True).alias("pure"))
    hits = F.count(F.when(F.col(ORIGIN) == GENERATED, 1))
    return df.agg(
        F.count("*").alias("rows"), hits.alias("generated"), F.round(hits / F.greatest(F.count("*"), F.lit(1)), 4).alias("contamination_rate"), (hits == 0).alias("pure")
    )


def assert_not_generated(df: DataFrame) -> DataFrame:
    """``df`` itself, refused when it holds generated rows."""
    if ORIGIN in df.columns:
        row = origin_purity(df).first()
        if row["generated"]:
            raise ValueError(f"{row['generated']} generated rows in training input (rate {row['contamination_rate']})")
    return df
