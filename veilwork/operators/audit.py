"""Privacy risk of a table or of a released version of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.operators.association import pearson_pairs
from veilwork.operators.compare import linear_fit, r_squared
from veilwork.operators.frames import (
    column_rows,
    exact_quantiles,
    number_cell,
    numeric_columns,
    other_columns,
    piece_counts,
    text_cell,
    whole_counts,
)
from veilwork.operators.nearest import nearest_points, points
from veilwork.session import cut_lineage


def k_anonymity(df: DataFrame, categories: Sequence[str] | None = None, numbers: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """(min_k, mean_k, unique_groups, total_groups, unique_share, vulnerable, severity) over quasi-identifier groups.

    Non-numeric columns as they are and numeric ones in right-closed equal-width bins; all columns unless named.
    """
    cats = list(categories if categories is not None else other_columns(df))
    nums = list(numbers if numbers is not None else numeric_columns(df))
    picked = df.select(
        *[F.coalesce(text_cell(df, c), F.lit("__NA__")).alias(f"c{i}") for i, c in enumerate(cats)],
        *[F.coalesce(number_cell(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(nums)],
    )
    if nums:
        ends = picked.agg(*[F.struct(F.min(f"x{i}").alias("lo"), F.max(f"x{i}").alias("hi")).alias(f"x{i}") for i in range(len(nums))]).first()
        for i in range(len(nums)):
            lo, hi = (ends[f"x{i}"]["lo"], ends[f"x{i}"]["hi"]) if ends[f"x{i}"] else (None, None)
            code = F.lit(0)
            if lo is not None:
                for b in range(1, bins):
                    code = code + F.when(F.col(f"x{i}") > F.lit(lo + b * (hi - lo) / bins), 1).otherwise(0)
            picked = picked.withColumn(f"x{i}", code)
    groups = picked.groupBy(*picked.columns).agg(F.count("*").alias("n"))
    out = groups.agg(
        F.min("n").alias("min_k"), F.avg("n").alias("mean_k"), F.count(F.when(F.col("n") == 1, 1)).alias("unique_groups"), F.count("*").alias("total_groups")
    )
    k = F.col("min_k")
    severity = F.when(k == 1, "critical").when(k < 3, "high").when(k < 5, "medium").otherwise("low")
    return out.withColumn("unique_share", F.col("unique_groups") / F.greatest(F.col("total_groups"), F.lit(1))).withColumn(
        "vulnerable", k < 3
    ).withColumn("severity", severity)


# ---- nearest rows ------------------------------------------------------------------------------------------------


def sample_rows(df: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """A reproducible sample: the n rows with the smallest md5 of (seed, key); all rows if ``n`` is None."""
    if n is None:
        return df
    rank = F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))
    return df.orderBy(rank, key).limit(n)


def population_scale(df: DataFrame, columns: Sequence[str]) -> list[float]:
    row = df.agg(*[F.stddev_pop(F.coalesce(number_cell(df, c), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(columns))]


def nearest_rows(
    probes: DataFrame, pool: DataFrame, columns: Sequence[str], scale: Sequence[float], probe_key: str, pool_key: str,
    exclude_self: bool = False, label: Column | None = None,
) -> DataFrame:
    """(probe, dist, key, label): the nearest pool row of every probe row, ties to the smallest key; exact, on whole
    tables, see ``nearest``. Keys are unique on each side."""
    tag = (label if label is not None else F.lit(None)).cast("string").alias("label")
    return nearest_points(points(probes, probe_key, columns, scale), points(pool, pool_key, columns, scale, [tag]), len(columns), exclude_self)


def nearest_record_rate(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str], original_key: str, synthetic_key: str,
    n: int | None = None, seed: int = 42, threshold: float = 0.5,
) -> DataFrame:
    """(probes, close, rate, vulnerable, severity): synthetic rows closer than 0.5 to any original row; all of them, or
    a sample of ``n``."""
    return close_record_rate(original, sample_rows(synthetic, synthetic_key, n, seed), columns, threshold)


def close_record_rate(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(probes, close, rate, vulnerable, severity): all synthetic rows closer than ``threshold`` to any original row.

    The form of ``nearest_record_rate`` for whole tables, exact and without pairs. Equal rows are collapsed first. Rows
    that share a cell so small that any two of its points are close are settled by the cell alone, which takes care of
    dense regions; only the others look for a close original, in the neighbouring cells of their widest columns, by a
    semi join that stops at the first one.
    """
    k = len(columns)
    xs = [f"x{i}" for i in range(k)]
    scale = population_scale(original, columns)
    ends = _points_only(original, columns).agg(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(x) for x in xs]).first()
    lows = [ends[x]["lo"] or 0.0 for x in xs]
    spread = [((ends[x]["hi"] or 0.0) - low) / s for x, low, s in zip(xs, lows, scale)]
    wide = sorted(range(k), key=lambda i: (-spread[i], i))[:3]

    def scaled(df: DataFrame) -> DataFrame:
        return _points_only(df, columns).select(*[((F.col(x) - F.lit(low)) / F.lit(s)).alias(x) for x, low, s in zip(xs, lows, scale)])

    small, large = threshold / k**0.5 * (1 - 1e-9), threshold * (1 + 1e-9)
    inner = [F.floor(F.col(x) / F.lit(small)).alias(f"c{i}") for i, x in enumerate(xs)]
    cells = [f"c{i}" for i in range(k)]
    outer = {f"g{i}": F.floor(F.col(f"x{i}") / F.lit(large)) for i in wide}
    made = cut_lineage(scaled(synthetic).groupBy(*xs).agg(F.count(F.lit(1)).alias("n")))
    known = cut_lineage(scaled(original).distinct())
    marked = made.select("*", *inner)
    filled = known.select(*inner).distinct()
    rest = marked.join(filled, cells, "left_anti").drop(*cells)
    for g, cell in outer.items():
        rest = rest.withColumn(g, F.explode(F.array(*[cell + F.lit(step) for step in (-1, 0, 1)])))
    others = known.select(*[F.col(x).alias(f"y{i}") for i, x in enumerate(xs)], *[cell.alias(f"o_{g}") for g, cell in outer.items()])
    apart = F.lit(0.0)
    for i in range(k):
        apart = apart + (F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}"))
    meet = F.sqrt(apart) < F.lit(threshold)
    for g in outer:
        meet = meet & (F.col(g) == F.col(f"o_{g}"))
    hits = rest.join(others, meet, "left_semi").select(*xs, "n").distinct()
    close = marked.join(filled, cells, "left_semi").select("n").unionByName(hits.select("n"))
    tally = made.select("n", F.lit(0).cast("long").alias("c")).union(close.select(F.lit(0).cast("long"), "n"))
    none = F.lit(0).cast("long")
    out = tally.agg(F.coalesce(F.sum("n"), none).alias("probes"), F.coalesce(F.sum("c"), none).alias("close"))
    rate = F.col("close") / F.greatest(F.col("probes"), F.lit(1))
    return out.withColumn("rate", rate).withColumn("vulnerable", rate > 0.1).withColumn(
        "severity", F.when(rate > 0.3, "critical").when(rate > 0.1, "high").otherwise("low")
    )


def _points_only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.coalesce(number_cell(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])


def _weighted(df: DataFrame, key: str, columns: Sequence[str], scale: Sequence[float], extra: Sequence[Column] = ()) -> DataFrame:
    """(key, x0.., extra, n): equal rows once, under their smallest key."""
    rows = points(df, key, columns, scale, extra)
    return cut_lineage(rows.groupBy(*[c for c in rows.columns if c != "key"]).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))


def _member_distances(original, synthetic, columns, original_key, synthetic_key, n, seed, include_self):
    """((dist, n) of the originals, (dist, n) of the synthetic rows, the median of the first): to the nearest original."""
    scale, k = population_scale(original, columns), len(columns)
    inside = _weighted(sample_rows(original, original_key, n, seed), original_key, columns, scale)
    outside = _weighted(sample_rows(synthetic, synthetic_key, n, seed), synthetic_key, columns, scale)
    pool = inside.withColumn("label", F.lit(None).cast("string"))
    zero = F.lit(0.0).alias("dist")
    if include_self:
        members = inside.select(zero, "n")
    else:
        # a row with equals lies at distance 0 from them; the others look for the nearest row elsewhere
        alone = inside.where("n = 1")
        found = nearest_points(alone, pool, k, exclude_self=True)
        members = inside.where("n > 1").select(zero, "n").union(found.select("dist", F.lit(1).cast("long")))
    near = nearest_points(outside, pool, k)
    others = near.join(outside.select(F.col("key").alias("probe"), "n"), "probe").select("dist", "n")
    members, others = (cut_lineage(side.groupBy("dist").agg(F.sum("n").alias("n"))) for side in (members, others))
    middle = exact_quantiles(members.select(F.col("dist").alias("value"), "n"), [], [0.5]).first()
    return members, others, F.lit(middle["q"][0] if middle else None).cast("double")


def _total(condition: Column | None = None) -> Column:
    n = F.col("n") if condition is None else F.when(condition, F.col("n"))
    return F.coalesce(F.sum(n), F.lit(0))


def membership_proximity(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str], original_key: str, synthetic_key: str,
    n: int | None = None, seed: int = 42, include_self: bool = False,
) -> DataFrame:
    """(threshold, above, score): how far synthetic rows lie from the originals, against the originals themselves.

    All rows of both tables, or samples of ``n`` each. ``include_self`` keeps the zero distance of a member to itself,
    which makes the threshold zero.
    """
    _members, others, limit = _member_distances(original, synthetic, columns, original_key, synthetic_key, n, seed, include_self)
    share = _total(F.col("dist") > limit) / F.greatest(_total(), F.lit(1))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * (share - 0.5)))
    return others.agg(F.max(limit).alias("threshold"), share.alias("above"), score.alias("score"))


def membership_accuracy(
    original: DataFrame, synthetic: DataFrame, columns: Sequence[str], original_key: str, synthetic_key: str,
    n: int | None = None, seed: int = 42, include_self: bool = False,
) -> DataFrame:
    """(threshold, accuracy, vulnerable, severity): guessing membership by the median member distance.

    The accuracy is the mean of the two sides' shares of right guesses, so that their sizes need not agree.
    """
    members, others, limit = _member_distances(original, synthetic, columns, original_key, synthetic_key, n, seed, include_self)
    near = F.col("dist") <= limit
    sides = members.select("dist", "n", F.lit(1).alias("m")).unionByName(others.select("dist", "n", F.lit(0).alias("m")))
    inside, outside = F.col("m") == 1, F.col("m") == 0
    share = lambda side, right: _total(side & right) / F.greatest(_total(side), F.lit(1))
    out = sides.agg(F.max(limit).alias("threshold"), ((share(inside, near) + share(outside, ~near)) / 2).alias("accuracy"))
    a = F.col("accuracy")
    return out.withColumn("vulnerable", a > 0.65).withColumn(
        "severity", F.when(a > 0.8, "critical").when(a > 0.65, "high").otherwise("low")
    )


def attribute_inference(
    original: DataFrame, synthetic: DataFrame, target: str, columns: Sequence[str], original_key: str, synthetic_key: str,
    n: int | None = None, seed: int = 42,
) -> DataFrame:
    """(probes, correct, accuracy, baseline, vulnerable, severity): labels of originals guessed from the nearest
    synthetic row; of all originals, or of a sample of ``n``."""
    scale = population_scale(synthetic, columns)
    label = lambda df, name: F.coalesce(text_cell(df, target), F.lit("__NA__")).alias(name)
    probes = _weighted(sample_rows(original, original_key, n, seed), original_key, columns, scale, [label(original, "truth")])
    near = nearest_points(probes, points(synthetic, synthetic_key, columns, scale, [label(synthetic, "label")]), len(columns))
    labels = original.agg(F.count_distinct(label(original, "truth"))).scalar()
    guessed = probes.join(near.select(F.col("probe").alias("key"), "label"), "key")
    # a projection of its own: a subquery over rows that were dealt or drawn may not stand inside an aggregate
    out = guessed.select("n", "label", "truth", (1.0 / F.greatest(labels, F.lit(1))).alias("baseline")).agg(
        _total().alias("probes"), _total(F.col("label") == F.col("truth")).alias("correct"), F.max("baseline").alias("baseline")
    )
    a = F.col("correct") / F.greatest(F.col("probes"), F.lit(1))
    return out.withColumn("accuracy", a).withColumn("vulnerable", a > F.col("baseline") * 2).withColumn(
        "severity", F.when(a > 0.7, "high").when(F.col("vulnerable"), "medium").otherwise("low")
    )


def linear_inversion_r2(original: DataFrame, synthetic: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(target, r2, vulnerable, severity): least squares on synthetic, scored on original, clamped to 0..1."""
    weights, intercept = linear_fit(synthetic, features, target)
    out = r_squared(original, features, target, weights, intercept)
    r2 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2")))
    return out.select(F.lit(target).alias("target"), r2.alias("r2")).withColumn("vulnerable", F.col("r2") > 0.5).withColumn(
        "severity", F.when(F.col("r2") > 0.7, "high").when(F.col("r2") > 0.5, "medium").otherwise("low")
    )


def audit_summary(results: DataFrame) -> DataFrame:
    """(run, succeeded, vulnerability, risk_score, recommendations) from (name, vulnerable) rows."""
    # Advice per audit (fixed values).
    advice = [
        ("membership", "Add differential privacy noise to reduce membership inference risk."),
        ("reconstruction", "Increase synthetic data diversity; reduce exact-row similarity."),
        ("inversion", "Add feature perturbation to prevent attribute reconstruction."),
        ("k-anonymity", "Ensure quasi-identifiers have k>=5 equivalence classes."),
    ]
    tip = F.lit(None).cast("string")
    for word, text in reversed(advice):
        tip = F.when(F.contains(F.lower("name"), F.lit(word)), text).otherwise(tip)
    out = results.agg(
        F.count("*").alias("run"),
        F.count(F.when(F.col("vulnerable"), 1)).alias("succeeded"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("vulnerable"), tip))), " ").alias("recommendations"),
    )
    s = F.col("succeeded")
    return out.withColumn(
        "vulnerability", F.when(s == 0, "safe").when(s <= 1, "moderate").when(s <= 3, "vulnerable").otherwise("critical")
    ).withColumn("risk_score", F.when(s == 0, 10.0).when(s <= 1, 40.0).when(s <= 3, 70.0).otherwise(90.0))


# ---- column risk -------------------------------------------------------------------------------------------------


def reidentification_risk(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, risk): 0.6 x distinct / rows + 0.4 x normalised entropy, at most 1; all-null columns 0."""
    names = list(columns or df.columns)
    pieces = cut_lineage(piece_counts(df, names, text=True))
    totals = pieces.groupBy("column").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    h = whole_counts(pieces).join(F.broadcast(totals), "column").groupBy("column").agg(
        (-F.sum(p * F.log2(p + F.lit(1e-10)))).alias("h"), F.count(F.lit(1)).alias("d")
    )
    rows = column_rows(df, names, lambda c: [F.count(F.lit(1)).alias("rows")])
    risk = F.least(F.lit(1.0), 0.6 * F.col("d") / F.greatest(F.col("rows"), F.lit(1)) + 0.4 * F.col("h") / F.log2(F.col("d") + 1))
    return rows.join(h, "column", "left").select("column", (F.round(F.coalesce(risk, F.lit(0.0)), 4) + F.lit(0.0)).alias("risk"))


def rank_sensitive(df: DataFrame, pii: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """(column, score, pii_score, reid, drift, corr) by descending score.

    ``pii`` is column findings (column, severity), ``drift`` is (column, drift).
    """
    out = reidentification_risk(df).withColumnRenamed("risk", "reid")
    spark = df.sparkSession
    if pii is None:
        pii = spark.createDataFrame([], "column string, severity string")
    weight = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "high", 0.8).when(F.col("severity") == "medium", 0.5).otherwise(0.2)
    flags = pii.groupBy("column").agg(F.max(weight).alias("pii_score"))
    if drift is None:
        drift = spark.createDataFrame([], "column string, drift double")
    peak = F.greatest(drift.agg(F.max("drift")).scalar(), F.lit(0.001))
    moved = drift.select("column", (F.col("drift") / peak).alias("drift"))
    pairs = pearson_pairs(df) if len(numeric_columns(df)) > 1 else spark.createDataFrame([], "col_a string, col_b string, value double, strength string")
    sides = pairs.select(F.col("col_a").alias("column"), "value").unionByName(pairs.select(F.col("col_b").alias("column"), "value"))
    tied = sides.groupBy("column").agg(F.max(F.abs("value")).alias("corr"))
    for part in (flags, moved, tied):
        out = out.join(part, "column", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.4 * z("pii_score") + 0.3 * z("reid") + 0.2 * z("drift") + 0.1 * z("corr")
    return out.select(
        "column",
        F.round(score, 4).alias("score"),
        *[F.round(z(c), 4).alias(c) for c in ("pii_score", "reid", "drift", "corr")],
    ).orderBy(F.desc("score"), "column")


def outlier_exposure(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, direction, value, extreme_ratio, fence, severity): the farthest value beyond q1-3 iqr or q3+3 iqr."""
    names = list(columns or numeric_columns(df))
    counts = cut_lineage(piece_counts(df, names))
    q = exact_quantiles(counts, ["column"], [0.25, 0.75]).where("total >= 4")
    q = q.select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), (F.col("q")[1] - F.col("q")[0]).alias("iqr")).where("iqr > 0")
    j = counts.join(F.broadcast(q), "column")
    lo, hi = F.col("q1") - 3 * F.col("iqr"), F.col("q3") + 3 * F.col("iqr")
    direction = F.when(F.col("value") > hi, "high").when(F.col("value") < lo, "low")
    side = F.when(F.col("value") > hi, F.col("q3")).otherwise(F.col("q1"))
    ratio = F.abs(F.col("value") - side) / F.greatest(F.col("iqr"), F.lit(1e-9))
    found = j.select("column", "value", direction.alias("direction"), ratio.alias("ratio"), F.when(F.col("value") > hi, hi).otherwise(lo).alias("fence"))
    worst = found.where("direction is not null").groupBy("column", "direction").agg(
        F.max_by("value", "ratio").alias("value"), F.max("ratio").alias("extreme_ratio"), F.first("fence").alias("fence")
    )
    r = F.col("extreme_ratio")
    return worst.withColumn("severity", F.when(r > 20, "critical").when(r > 5, "high").otherwise("medium"))


def outlier_score(outliers: DataFrame) -> DataFrame:
    weight = F.when(F.col("severity") == "critical", 0.30).when(F.col("severity") == "high", 0.20).when(F.col("severity") == "medium", 0.10).otherwise(0.05)
    return outliers.agg(F.least(F.lit(1.0), F.coalesce(F.sum(weight), F.lit(0.0))).alias("outlier_score"))


def recommend(reid: DataFrame, density: Column, outliers: DataFrame, pii: DataFrame) -> DataFrame:
    """(recommendation): distinct advice from column risk, density, finding categories and outliers."""
    # Advice per finding category (fixed values).
    by_category = [
        ("email", "Mask email addresses (retain domain only)"),
        ("phone", "Truncate or hash phone numbers"),
        ("credit_card", "Remove credit card data - store only last 4 digits"),
        ("ssn", "Remove SSN data - replace with anonymised ID"),
        ("quasi_identifier", "Apply k-anonymity to quasi-identifier columns"),
        ("high_entropy_token", "Rotate or remove high-entropy tokens (possible API keys)"),
    ]
    spark = reid.sparkSession
    pct = F.concat(F.round(F.col("risk") * 100, 0).cast("int").cast("string"), F.lit("%"))
    quoted = F.concat(F.lit("'"), F.col("column"), F.lit("'"))
    first = reid.where("risk > 0.6").select(
        F.when(F.col("risk") > 0.8, F.concat(F.lit("Hash or tokenize "), quoted, F.lit(" - re-identification risk "), pct))
        .otherwise(F.concat(F.lit("Consider pseudonymization for "), quoted, F.lit(" (risk "), pct, F.lit(")")))
        .alias("recommendation")
    )
    dense = F.when(
        density > 0.5,
        F.array(F.lit("Apply dataset-level anonymization - PII density exceeds 50% of columns"), F.lit("Remove or mask direct identifiers before sharing or training")),
    ).when(density > 0.2, F.array(F.lit("Review and restrict access to columns flagged as PII"))).otherwise(F.array().cast("array<string>"))
    second = spark.range(1).select(F.explode(dense).alias("recommendation"))
    table = spark.createDataFrame(by_category, "category string, recommendation string")
    third = pii.select("category").distinct().join(F.broadcast(table), "category").select("recommendation")
    worst = outliers.groupBy("column").agg(F.max_by("severity", "extreme_ratio").alias("severity"))
    strong = F.col("severity").isin("critical", "high")
    texts = F.when(
        strong,
        F.array(
            F.concat(F.lit("Clip or cap extreme values in "), quoted, F.lit(" - "), F.col("severity"), F.lit(" outlier exposure")),
            F.concat(F.lit("Consider noise injection (Laplace/Gaussian) for "), quoted, F.lit(" before release")),
        ),
    ).otherwise(F.array(F.concat(F.lit("Review outlier values in "), quoted, F.lit(" before dataset sharing"))))
    fourth = worst.select(F.explode(texts).alias("recommendation"))
    found = first.unionByName(second).unionByName(third).unionByName(fourth).distinct()
    calm = spark.createDataFrame([("Dataset appears low-risk. Maintain access controls and audit logging.",)], "recommendation string")
    return found.unionByName(calm.where(found.agg(F.count("*")).scalar() == 0))


def anomaly_signals(profile: DataFrame, drift: DataFrame, outliers: DataFrame) -> DataFrame:
    """(column, issue, severity): drift, missing cells, high variation, outliers.

    ``profile`` needs column, kind, null_ratio, mean and std.
    """
    moved = drift.where("drift > 0.15").select(
        "column", F.lit("Distribution drift").alias("issue"), F.when(F.col("drift") > 0.30, "high").otherwise("medium").alias("severity")
    )
    missing = profile.where("null_ratio > 0.30").select(
        "column", F.lit("High missing rate").alias("issue"), F.when(F.col("null_ratio") > 0.60, "high").otherwise("medium").alias("severity")
    )
    varied = profile.where("kind = 'numeric' and mean <> 0 and abs(std / mean) > 3.0").select(
        "column", F.lit("High variance / skewed distribution").alias("issue"), F.lit("medium").alias("severity")
    )
    exposed = outliers.select(
        "column", F.lit("Outlier exposure risk").alias("issue"), F.when(F.col("severity").isin("critical", "high"), "high").otherwise("medium").alias("severity")
    )
    return moved.unionByName(missing).unionByName(varied).unionByName(exposed)


def cleaning_actions(profile: DataFrame, anomalies: DataFrame, pii_columns: DataFrame, reid: DataFrame) -> DataFrame:
    """(column, action, priority) from missing cells, anomalies and personal-data columns."""
    holes = profile.where("null_ratio > 0.30").select(
        "column",
        F.when(F.col("null_ratio") > 0.60, "Consider dropping this column")
        .when(F.col("kind") == "numeric", "Impute with median or model-based imputation")
        .otherwise("Impute with mode or Unknown category")
        .alias("action"),
        F.when(F.col("null_ratio") > 0.60, "high").otherwise("medium").alias("priority"),
    )
    skew = anomalies.where("issue = 'High variance / skewed distribution'").select(
        "column", F.lit("Apply log1p transform or IQR-based clipping").alias("action"), F.lit("medium").alias("priority")
    )
    exposed = anomalies.where("issue = 'Outlier exposure risk'").select(
        "column", F.lit("Clip to 99th percentile or add Laplace noise").alias("action"), F.lit("high").alias("priority")
    )
    risky = F.coalesce(F.col("risk"), F.lit(0.0)) > 0.6
    personal = pii_columns.select("column").distinct().join(reid, "column", "left").select(
        "column",
        F.when(risky, "Apply k-anonymity generalisation or replace with a surrogate").otherwise("Mask with format-preserving pseudonymisation or remove").alias("action"),
        F.when(risky, "high").otherwise("medium").alias("priority"),
    )
    return holes.unionByName(skew).unionByName(exposed).unionByName(personal)


def governance_actions(ranking: DataFrame, risk: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """(column, action, urgency) for sensitive columns, and for the table at a risk of 70 or more.

    ``top`` looks at that many columns of the highest score only.
    """
    best = ranking if top is None else ranking.orderBy(F.desc("score"), "column").limit(top)
    masked = best.where("pii_score > 0.7").select("column", F.lit("Mask or tokenise").alias("action"), F.lit("high").alias("urgency"))
    grouped = best.where("reid > 0.7").select("column", F.lit("Apply k-anonymity or suppress").alias("action"), F.lit("critical").alias("urgency"))
    out = masked.unionByName(grouped)
    if risk is not None:
        out = out.unionByName(
            risk.where("score >= 70").select(F.lit("DATASET").alias("column"), F.lit("Mandatory privacy impact assessment").alias("action"), F.lit("critical").alias("urgency"))
        )
    return out.distinct()


