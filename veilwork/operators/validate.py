"""Row validation, repair and table checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.curves import curve_of, curve_value, literal, running, weighted_pick
from veilwork.functions.draws import uniform
from veilwork.functions.numeric import is_integer_type, is_numeric_type
from veilwork.operators.compare import drop_copies
from veilwork.operators.frames import cell, column_rows, melt_text, number_cell, numeric_columns, pinned, text_cell, value_counts
from veilwork.session import cut_lineage

FENCE = 3.0
MAHALANOBIS = 9.21
CLASS_SIGMA = 4.0
# comparison name -> test (fixed values)
OPERATORS = ("<", "<=", ">", ">=", "!=")


def _row_number(df: DataFrame, key: str) -> Column:
    whole = is_integer_type(df.schema[key].dataType)
    return F.abs(F.col(key).cast("long")) if whole else F.pmod(F.xxhash64(cell(key)), F.lit(1 << 53))


def _with_uniforms(df: DataFrame, columns: Sequence[str], key: str, seed: int, purpose: str) -> DataFrame:
    """Add ``_u_<column>`` in a projection of its own, because the redraw formulas read it many times."""
    row = _row_number(df, key)
    return df.select("*", *[uniform(row, seed, f"{purpose}/{c}").alias(f"_u_{c}") for c in columns])


def repair_ranges(df: DataFrame, constraint_rows: DataFrame, profile: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Numbers outside their range redrawn from the column's curve, which lies inside the range."""
    ranges = {r["column"]: r for r in constraint_rows.where("kind = 'range'").collect()}
    curves = {r["column"]: curve_of(r) for r in profile.collect() if r["min"] is not None}
    targets = [c for c in df.columns if c in ranges and c in curves and ranges[c]["lo"] is not None]
    row = _row_number(df, key)
    out = []
    for c in df.columns:
        if c not in targets:
            out.append(cell(c))
            continue
        x = number_cell(df, c)
        outside = (x < F.lit(ranges[c]["lo"])) | (x > F.lit(ranges[c]["hi"]))
        # inside a function over arrays the formulas run for the rows outside only; written out, those of a few columns
        # outgrow what the JVM compiles
        fresh = F.get(F.transform(F.array(uniform(row, seed, f"repair/{c}")), partial(curve_value, literal(curves[c]))), 0)
        dtype = df.schema[c].dataType
        if is_integer_type(dtype):
            fresh = F.round(fresh, 0)
        out.append(F.when(outside, fresh.cast(dtype)).otherwise(cell(c)).alias(c))
    return df.select(*out)


def count_out_of_range(df: DataFrame, constraint_rows: DataFrame) -> DataFrame:
    """(column, repaired): cells that ``repair_ranges`` would redraw."""
    ranges = {r["column"]: r for r in constraint_rows.where("kind = 'range' and lo is not null").collect()}
    names = [c for c in df.columns if c in ranges]

    def fields(c):
        x = number_cell(df, c)
        return [F.count(F.when((x < F.lit(ranges[c]["lo"])) | (x > F.lit(ranges[c]["hi"])), 1)).alias("repaired")]

    return column_rows(df, names, fields)


def repair_categories(df: DataFrame, distribution: DataFrame, constraint_rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Values outside the allowed set redrawn by the weights of the allowed ones; nulls stay."""
    allowed = {r["column"]: sorted(r["allowed"]) for r in constraint_rows.where("kind = 'allowed'").collect()}
    names = [c for c in df.columns if c in allowed]
    weights: dict[str, dict[str, float]] = {c: {} for c in names}
    for r in distribution.where(F.col("column").isin(names)).collect():
        weights[r["column"]][r["value"]] = r["ratio"]
    out = []
    for c in df.columns:
        if c not in names:
            out.append(cell(c))
            continue
        known = [v for v in allowed[c] if weights[c].get(v, 0.0) > 0] or allowed[c]
        shares = [weights[c].get(v, 1.0) for v in known]
        pick = weighted_pick(F.array(*[F.lit(v) for v in known]), literal(running(shares)), cell(f"_u_{c}"))
        bad = cell(c).isNotNull() & ~text_cell(df, c).isin(allowed[c])
        out.append(F.when(bad, pick.cast(df.schema[c].dataType)).otherwise(cell(c)).alias(c))
    return _with_uniforms(df, names, key, seed, "repair").select(*out)


def count_invented(df: DataFrame, constraint_rows: DataFrame) -> DataFrame:
    """(column, repaired): cells that ``repair_categories`` would redraw."""
    allowed = {r["column"]: list(r["allowed"]) for r in constraint_rows.where("kind = 'allowed'").collect()}
    names = [c for c in df.columns if c in allowed]
    return column_rows(df, names, lambda c: [F.count(F.when(cell(c).isNotNull() & ~text_cell(df, c).isin(allowed[c]), 1)).alias("repaired")])


def complete_schema(df: DataFrame, columns: Sequence[str], profile: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Missing numeric columns drawn from their curve, other missing ones null; order restored, extras dropped."""
    curves = {r["column"]: curve_of(r) for r in profile.collect() if r["min"] is not None}
    out = []
    for c in columns:
        if c in df.columns:
            out.append(cell(c))
        elif c in curves:
            out.append(curve_value(literal(curves[c]), cell(f"_u_{c}")).alias(c))
        else:
            out.append(F.lit(None).cast("string").alias(c))
    keep = [cell(key)] if key not in columns else []
    drawn = [c for c in columns if c not in df.columns and c in curves]
    return _with_uniforms(df, drawn, key, seed, "fill").select(*keep, *out)


def _fences(profile: DataFrame) -> dict[str, tuple[float, float]]:
    out = {}
    for r in profile.collect():
        if r["q25"] is not None and r["q75"] is not None:
            iqr = r["q75"] - r["q25"]
            if iqr > 0:
                out[r["column"]] = (r["q25"] - FENCE * iqr, r["q75"] + FENCE * iqr)
        elif r["mean"] is not None and (r["std"] or 0.0) > 0:
            out[r["column"]] = (r["mean"] - FENCE * r["std"], r["mean"] + FENCE * r["std"])
    return out


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def iqr_outlier_flag(df: DataFrame, profile: DataFrame) -> Column:
    """Whether any number lies outside its outer fences."""
    flags = []
    for c, (lo, hi) in _fences(profile).items():
        if c in df.columns:
            x = number_cell(df, c)
            flags.append((x < F.lit(lo)) | (x > F.lit(hi)))
    return _any(flags)


def mahalanobis_flag(df: DataFrame, profile: DataFrame, pairs: DataFrame, min_abs: float = 0.4, limit: float = MAHALANOBIS) -> Column:
    """Whether a strongly tied pair lies outside its joint ellipse: (za^2 - 2 r za zb + zb^2) / (1 - r^2) > 9.21."""
    stats = {r["column"]: r for r in profile.collect()}
    flags = []
    for p in pairs.where(F.abs("value") >= min_abs).collect():
        a, b, r = stats.get(p["col_a"]), stats.get(p["col_b"]), p["value"]
        if a is None or b is None or not (a["std"] or 0) > 0 or not (b["std"] or 0) > 0 or p["col_a"] not in df.columns or p["col_b"] not in df.columns:
            continue
        za = (number_cell(df, p["col_a"]) - F.lit(a["mean"])) / F.lit(a["std"])
        zb = (number_cell(df, p["col_b"]) - F.lit(b["mean"])) / F.lit(b["std"])
        # 1 - r^2 has the floor that the smallest eigenvalue 1e-8 gives it
        rest = max(1.0 - r * r, 1e-8 * (1.0 + abs(r)))
        flags.append((za * za - F.lit(2.0 * r) * za * zb + zb * zb) / F.lit(rest) > F.lit(limit))
    return _any(flags)


def class_zscore(df: DataFrame, label: str, stats: DataFrame, limit: float = CLASS_SIGMA) -> DataFrame:
    """Add ``class_outlier``: any number farther than four class deviations from its class mean.

    ``stats`` (label, column, mean, std) is pivoted to one row per class; the number of classes is small by
    construction of the class statistics.
    """
    names = [c for c in numeric_columns(df) if c != label]
    wide = stats.where(F.col("column").isin(names)).groupBy(F.col("label").alias("_label")).pivot("column", names).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    from veilwork.functions.sizing import maybe_broadcast

    joined = df.withColumn("_label", text_cell(df, label)).join(maybe_broadcast(wide), "_label", "left")
    flags = [
        (F.abs(number_cell(df, c) - F.col(f"`{c}_mean`")) > F.lit(limit) * F.col(f"`{c}_std`")) & (F.col(f"`{c}_std`") > 0) for c in names
    ]
    return joined.select(*[cell(c) for c in df.columns], _any(flags).alias("class_outlier"))


def quality_flags(
    df: DataFrame, profile: DataFrame, pairs: DataFrame | None = None, label: str | None = None, class_rows: DataFrame | None = None
) -> DataFrame:
    """Add iqr_outlier, joint_outlier and class_outlier; each check counts at most once per row."""
    out = df
    if label is not None and class_rows is not None:
        out = class_zscore(out, label, class_rows)
    else:
        out = out.withColumn("class_outlier", F.lit(False))
    joint = mahalanobis_flag(df, profile, pairs) if pairs is not None else F.lit(False)
    return out.withColumn("iqr_outlier", iqr_outlier_flag(df, profile)).withColumn("joint_outlier", joint)


def accept_rows(flagged: DataFrame, max_failures: int = 1) -> DataFrame:
    """Add ``accepted``: not more than ``max_failures`` of the three checks failed (1 by default, so two reject)."""
    failed = sum((F.col(c).cast("int") for c in ("iqr_outlier", "joint_outlier", "class_outlier")), F.lit(0))
    return flagged.withColumn("accepted", failed <= max_failures)


def validate(
    df: DataFrame, original: DataFrame, constraint_rows: DataFrame, profile: DataFrame | None, key: str, seed: int = 42,
    compared: Sequence[str] | None = None, rules: Sequence[dict] = (), max_failures: int = 1, pairs: DataFrame | None = None,
    distribution: DataFrame | None = None, label: str | None = None, class_rows: DataFrame | None = None,
) -> DataFrame:
    """Repaired, plausible rows that copy no original row: repair, quality checks, cross-column rules, copies.

    Categories are repaired when their ``distribution`` is given; the joint and the class check need ``pairs`` and
    ``label`` with ``class_rows`` (label, column, mean, std).
    """
    out = df
    constraint_rows = pinned(constraint_rows)
    if distribution is not None:
        out = repair_categories(out, distribution, constraint_rows, key, seed)
    if profile is not None:
        profile = pinned(profile)
        repaired = repair_ranges(out, constraint_rows, profile, key, seed)
        # The verdict is written with the rows before they are filtered: a filter on formulas would be pushed below
        # the projections that make the columns and repeat their whole text for every use.
        flagged = cut_lineage(accept_rows(quality_flags(repaired, profile, pairs, label, class_rows), max_failures))
        out = flagged.where("accepted").select(*[cell(c) for c in df.columns])
    else:
        out = cut_lineage(out)
    if rules:
        out = enforce_rules(out, rules)
    return drop_copies(original, out, [c for c in (compared or original.columns) if c in out.columns])


def validation_counts(
    df: DataFrame, original: DataFrame, constraint_rows: DataFrame, profile: DataFrame, key: str, seed: int = 42, compared: Sequence[str] | None = None,
    pairs: DataFrame | None = None, distribution: DataFrame | None = None, label: str | None = None, class_rows: DataFrame | None = None,
    max_failures: int = 1,
) -> DataFrame:
    """(evaluated, repaired, rejected_quality, rejected_copies, accepted) of one validation run.

    ``repaired`` counts numbers outside their range, and invented categories when their ``distribution`` is given.
    """
    constraint_rows, profile = pinned(constraint_rows), pinned(profile)
    counts = count_out_of_range(df, constraint_rows)
    fixed = df
    if distribution is not None:
        counts = counts.unionByName(count_invented(df, constraint_rows))
        fixed = repair_categories(df, distribution, constraint_rows, key, seed)
    repaired = counts.agg(F.sum("repaired")).scalar()
    fixed = repair_ranges(fixed, constraint_rows, profile, key, seed)
    flagged = cut_lineage(accept_rows(quality_flags(fixed, profile, pairs, label, class_rows), max_failures))
    good = flagged.where("accepted")
    final = drop_copies(original, good.select(*[cell(c) for c in df.columns]), compared)
    kept = final.agg(F.count("*")).scalar()
    return flagged.agg(F.count("*").alias("evaluated"), F.count(F.when(F.col("accepted"), 1)).alias("_good")).select(
        "evaluated",
        F.coalesce(repaired, F.lit(0)).alias("repaired"),
        (F.col("evaluated") - F.col("_good")).alias("rejected_quality"),
        (F.col("_good") - kept).alias("rejected_copies"),
        kept.alias("accepted"),
    )


# ---- cross-column rules ------------------------------------------------------------------------------------------


def _scalar(df: DataFrame, name: str) -> Column:
    """Numbers as they are; dates and times as microseconds."""
    dtype = df.schema[name].dataType
    if is_numeric_type(dtype):
        return number_cell(df, name)
    return F.unix_micros(cell(name).cast("timestamp")).cast("double")


def _holds(df: DataFrame, rule: dict) -> Column:
    a, b = _scalar(df, rule["left"]), _scalar(df, rule["right"])
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}[rule["op"]]


def _violates(df: DataFrame, rule: dict) -> Column:
    if rule["type"] == "comparison":
        return F.coalesce(~_holds(df, rule), F.lit(False))
    when, then = rule["when"], rule["then"]
    x = number_cell(df, then["column"])
    hit = F.lit(False)
    if then.get("min") is not None:
        hit = hit | (x < F.lit(float(then["min"])))
    if then.get("max") is not None:
        hit = hit | (x > F.lit(float(then["max"])))
    return F.coalesce((text_cell(df, when["column"]) == F.lit(str(when.get("equals")))) & hit, F.lit(False))


def usable_rules(rules: Sequence[dict], columns: Sequence[str]) -> list[dict]:
    """Well-formed rules whose columns exist."""
    out = []
    for r in rules:
        if r.get("type") == "comparison" and r.get("op") in OPERATORS and r.get("left") in columns and r.get("right") in columns:
            out.append(r)
        elif r.get("type") == "conditional":
            when, then = r.get("when") or {}, r.get("then") or {}
            if when.get("column") in columns and then.get("column") in columns and (then.get("min") is not None or then.get("max") is not None):
                out.append(r)
    return out


def enforce_comparison(df: DataFrame, left: str, op: str, right: str) -> DataFrame:
    """Rows breaking ``left op right`` get left = right, moved by one unit (integers, days) or 1e-6 where strict."""
    rule = {"type": "comparison", "left": left, "op": op, "right": right}
    dtype = df.schema[left].dataType
    step = {"<": -1, "<=": 0, ">": 1, ">=": 0, "!=": 1}[op]
    if is_integer_type(dtype):
        fixed = (F.round(number_cell(df, right), 0) + step).cast(dtype)
    elif is_numeric_type(dtype):
        fixed = (number_cell(df, right) + step * 1e-6).cast(dtype)
    else:
        fixed = (cell(right).cast("timestamp") + F.make_dt_interval(F.lit(step))).cast(dtype)
    return df.withColumn(left, F.when(_violates(df, rule), fixed).otherwise(cell(left)))


def enforce_conditional(df: DataFrame, when_column: str, equals, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Where ``when_column`` equals a value, clamp ``column`` to [lo, hi]."""
    x = number_cell(df, column)
    fixed = x
    if lo is not None:
        fixed = F.greatest(fixed, F.lit(float(lo)))
    if hi is not None:
        fixed = F.least(fixed, F.lit(float(hi)))
    match = (text_cell(df, when_column) == F.lit(str(equals))) & x.isNotNull()
    return df.withColumn(column, F.when(match, fixed.cast(df.schema[column].dataType)).otherwise(cell(column)))


def apply_rule(df: DataFrame, rule: dict) -> DataFrame:
    if rule["type"] == "comparison":
        return enforce_comparison(df, rule["left"], rule["op"], rule["right"])
    then = rule["then"]
    return enforce_conditional(df, rule["when"]["column"], rule["when"].get("equals"), then["column"], then.get("min"), then.get("max"))


def count_violations(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """(rule, violations) per usable rule, in one pass."""
    usable = usable_rules(rules, df.columns)
    structs = [F.struct(F.lit(i).alias("rule"), F.count(F.when(_violates(df, r), 1)).alias("violations")) for i, r in enumerate(usable)]
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def _remaining(df: DataFrame, rules: Sequence[dict]) -> int:
    return count_violations(df, rules).agg(F.sum("violations").alias("v")).first()["v"] or 0


def enforce_rules(df: DataFrame, rules: Sequence[dict], max_rounds: int = 3, fail_share: float | None = 0.05) -> DataFrame:
    """All rules applied in order, up to three rounds; refused when violations (summed over rules) pass 5 % of rows.

    Two rounds that leave no violation are enough: another one would change nothing.
    """
    usable = usable_rules(rules, df.columns)
    if not usable:
        return df
    out = df
    for turn in range(max_rounds):
        if turn == 2:
            if not _remaining(out, usable):
                return out
            out = cut_lineage(out)
        for rule in usable:
            out = apply_rule(out, rule)
    if fail_share is not None:
        left = _remaining(out, usable)
        rows = out.count()
        if left > fail_share * max(rows, 1):
            raise ValueError(f"{left} rule violations remain in {rows} rows")
    return out


# ---- table checks ------------------------------------------------------------------------------------------------


def check_invariants(df: DataFrame, expected: Sequence[str], constraint_rows: DataFrame, requested: int | None = None) -> DataFrame:
    """(check, column, n_bad, passed): emptiness, schema, order, missing or infinite numbers, allowed values, rows."""
    spark = df.sparkSession
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    order = [c for c in df.columns if c in expected] != [c for c in expected if c in df.columns]
    static = [("SCHEMA_MATCH", c, 1) for c in missing + extra] or [("SCHEMA_MATCH", "", 0)]
    static.append(("COL_ORDER", "", int(order)))
    rows = spark.createDataFrame(static, "check string, column string, n_bad long")
    rules = constraint_rows.where(F.col("column").isin(df.columns)).collect()
    checks = [
        F.struct(F.lit("NO_EMPTY").alias("check"), F.lit("").alias("column"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("n_bad"))
    ]
    if requested is not None:
        short = F.greatest(F.lit(requested).cast("long") - F.count(F.lit(1)), F.lit(0).cast("long"))
        checks.append(F.struct(F.lit("ROW_COUNT").alias("check"), F.lit("").alias("column"), short.alias("n_bad")))
    for r in rules:
        c = r["column"]
        if r["kind"] == "range" and r["null_ratio"] == 0.0:
            text = text_cell(df, c)
            x = F.try_to_number(text, F.lit("S9")).cast("double") if not is_numeric_type(df.schema[c].dataType) else number_cell(df, c)
            if not is_numeric_type(df.schema[c].dataType):
                x = text.try_cast("double")
                checks.append(F.struct(F.lit("TYPE_SAFETY").alias("check"), F.lit(c).alias("column"), F.count(F.when(text.isNotNull() & x.isNull(), 1)).alias("n_bad")))
            endless = (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))
            checks.append(F.struct(F.lit("NO_NAN").alias("check"), F.lit(c).alias("column"), F.count(F.when(x.isNull() | F.isnan(x), 1)).alias("n_bad")))
            checks.append(F.struct(F.lit("NO_INF").alias("check"), F.lit(c).alias("column"), F.count(F.when(endless, 1)).alias("n_bad")))
        elif r["kind"] == "allowed":
            bad = cell(c).isNotNull() & ~text_cell(df, c).isin(r["allowed"])
            checks.append(F.struct(F.lit("CAT_VALIDITY").alias("check"), F.lit(c).alias("column"), F.count(F.when(bad, 1)).alias("n_bad")))
    measured = df.agg(F.array(*checks).alias("r")).select(F.inline("r"))
    return rows.unionByName(measured).withColumn("passed", F.col("n_bad") == 0)


def sanity_checks(df: DataFrame, profile: DataFrame, top: DataFrame, constraint_rows: DataFrame) -> DataFrame:
    """(check, column, detail) of each contradiction: collapsed numbers, one dominant value, invented categories.

    Needs at least 100 rows for the first two; invented values within 1e-6 of an allowed number are tolerated.
    """
    numbers = [c for c in numeric_columns(df)]
    others = [c for c in df.columns if c not in numbers]
    parts = []
    if numbers:
        spread = column_rows(df, numbers, lambda c: [F.count(number_cell(df, c)).alias("n"), (F.max(number_cell(df, c)) - F.min(number_cell(df, c))).alias("span")])
        base = profile.select("column", F.col("std").alias("base_std"))
        parts.append(
            spread.join(F.broadcast(base), "column").where("n >= 100 and span < 1e-9 and coalesce(base_std, 1.0) > 1e-3").select(
                F.lit("NUMERIC_COLLAPSE").alias("check"), "column", F.col("base_std").cast("string").alias("detail")
            )
        )
    if others:
        counts = value_counts(melt_text(df, others))
        rows = df.agg(F.count("*")).scalar()
        leaders = counts.groupBy("column").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"))
        known = top.select("column", "value", F.col("ratio").alias("base"))
        share = F.col("n") / F.greatest(rows, F.lit(1))
        parts.append(
            leaders.join(F.broadcast(known), ["column", "value"], "left")
            .where((rows >= 100) & (share >= 0.99) & (F.coalesce("base", F.lit(0.0)) < 0.60))
            .select(F.lit("CATEGORICAL_DOMINANCE").alias("check"), "column", F.col("value").alias("detail"))
        )
        allowed = constraint_rows.where("kind = 'allowed'").select("column", "allowed")
        number = F.col("value").try_cast("double")
        near = F.exists("allowed", lambda a: F.abs(a.try_cast("double") - number) < 1e-6)
        invented = counts.join(F.broadcast(allowed), "column").where(~F.array_contains("allowed", F.col("value")) & ~F.coalesce(near, F.lit(False)))
        parts.append(
            invented.groupBy("column").agg(F.count("*").alias("k")).select(
                F.lit("INVENTED_CATEGORIES").alias("check"), "column", F.col("k").cast("string").alias("detail")
            )
        )
    return reduce(DataFrame.unionByName, parts)
