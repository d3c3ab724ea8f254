"""Scores, gates and decisions over a table of run metrics (one row per run and table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions.numeric import clamp

# Metric catalogue: name, lowest, highest, whether higher means riskier (fixed values)
CATALOG = [
    ("privacy_score", 0.0, 1.0, False),
    ("duplicates_rate", 0.0, 1.0, True),
    ("membership_proximity_risk_score", 0.0, 1.0, True),
    ("statistical_drift_score", 0.0, 1.0, True),
    ("reidentification_risk", 0.0, 1.0, True),
    ("sensitivity_score", 0.0, 1.0, True),
    ("dataset_risk_score", 0.0, 100.0, True),
    ("dataset_intelligence_risk", 0.0, 100.0, True),
    ("statistical_reliability_score", 0.0, 1.0, False),
    ("membership_attack_success", 0.0, 1.0, True),
    ("reconstruction_risk", 0.0, 1.0, True),
    ("nearest_neighbor_leakage", 0.0, 1.0, True),
    ("outlier_risk_score", 0.0, 1.0, True),
    ("pii_density", 0.0, 1.0, True),
    ("column_drift", 0.0, 1.0, True),
    ("duplicates_risk", 0.0, 1.0, True),
    ("mi_attack_risk", 0.0, 1.0, True),
    ("distance_similarity_risk", 0.0, 1.0, True),
    ("distribution_drift_risk", 0.0, 1.0, True),
    ("acceptance_rate", 0.0, 1.0, False),
    ("rejection_rate", 0.0, 1.0, True),
]

# Gate thresholds: name, lowest and highest allowed, the same in high-risk mode (fixed values)
THRESHOLDS = [
    ("privacy_score", 0.0, 1.0, 0.0, 1.0),
    ("duplicates_rate", 0.0, 0.40, 0.0, 0.10),
    ("membership_proximity_risk_score", 0.0, 1.0, 0.0, 1.0),
    ("statistical_drift_score", 0.0, 1.0, 0.0, 1.0),
    ("membership_inference_auc", 0.0, 1.0, 0.0, 1.0),
    ("dataset_risk_score", 0.0, 100.0, 0.0, 100.0),
    ("dataset_intelligence_risk", 0.0, 100.0, 0.0, 100.0),
    ("acceptance_rate", 0.10, 1.0, 0.20, 1.0),
    ("rejection_rate", 0.0, 0.90, 0.0, 0.90),
]


def metric_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "metric string, lo double, hi double, higher_is_riskier boolean")


def riskier_is_higher(metrics: DataFrame) -> DataFrame:
    """(run_id, metric, value) with the direction normalised and values outside the catalogue range flagged."""
    eps = 1e-9
    j = metrics.join(F.broadcast(metric_catalog(metrics.sparkSession)), "metric")
    valid = F.col("value").between(F.col("lo") - eps, F.col("hi") + eps) & ~F.isnan("value")
    snapped = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("value")))
    risk = F.when(F.col("higher_is_riskier"), snapped).otherwise(1.0 - snapped)
    return j.select("run_id", "metric", "value", valid.alias("valid"), F.when(valid, risk).alias("risk"))


def melt_metrics(runs: DataFrame, names: list[str]) -> DataFrame:
    return runs.select("run_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["run_id"], names, "metric", "value").where("value is not null")


def privacy_score(auc: Column, dup: Column, drift: Column) -> Column:
    """0.40 membership + 0.35 copies + 0.25 drift, each 1 at its best; missing parts take neutral values."""
    a = F.coalesce(F.greatest(F.lit(0.0), 1.0 - 2.0 * F.abs(auc - 0.5)), F.lit(0.5))
    d = F.greatest(F.lit(0.0), 1.0 - F.coalesce(dup * 20.0, F.lit(0.1)))
    s = F.greatest(F.lit(0.0), 1.0 - F.coalesce(drift * 4.0, F.lit(0.2)))
    return F.round(0.40 * a + 0.35 * d + 0.25 * s, 4)


def privacy_level(score: Column) -> Column:
    return F.when(score >= 0.75, "low").when(score >= 0.50, "warning").when(score.isNotNull(), "critical").otherwise("unknown")


def privacy_components(auc: Column, dup: Column, drift: Column) -> dict[str, Column]:
    a = F.coalesce(auc, F.lit(0.5))
    return {
        "duplicates_risk": F.round(F.coalesce(dup, F.lit(0.0)), 4),
        "mi_attack_risk": F.round(F.greatest(F.lit(0.0), a - 0.5) * 2.0, 4),
        "distance_similarity_risk": F.round(F.greatest(F.lit(0.0), 0.5 - a) * 2.0, 4),
        "distribution_drift_risk": F.round(F.coalesce(drift, F.lit(0.0)), 4),
    }


def attack_indicators(auc: Column, drift: Column) -> dict[str, Column]:
    return {
        "membership_attack_success": F.round(clamp(2.0 * (auc - 0.5), 0.0, 1.0), 4),
        "reconstruction_risk": F.round(F.greatest(F.lit(0.0), 0.5 - F.coalesce(auc, F.lit(0.5))) * 2.0, 4),
        "nearest_neighbor_leakage": F.round(1.0 - F.least(drift * 5.0, F.lit(1.0)), 4),
    }


def dataset_risk_score(score: Column, auc: Column, dup: Column, drift: Column) -> Column:
    raw = (1.0 - F.coalesce(score, F.lit(0.5))) * 40.0 + F.coalesce(auc, F.lit(0.5)) * 30.0 + F.coalesce(dup, F.lit(0.0)) * 20.0 + F.coalesce(drift, F.lit(0.0)) * 10.0
    return F.round(clamp(raw, 0.0, 100.0), 2)


def reliability_score(rows: Column) -> Column:
    return F.when(rows >= 500, 1.0).when(rows >= 100, 0.85).when(rows >= 30, 0.65).when(rows >= 10, 0.40).otherwise(0.15)


def threats(runs: DataFrame) -> DataFrame:
    """(run_id, name, severity, confidence, property) from duplicates_rate, membership_inference_auc and avg_drift."""
    dup, auc, drift = F.col("duplicates_rate"), F.col("membership_inference_auc"), F.col("avg_drift")

    def threat(when, name, severity, confidence, what):
        return F.when(
            when, F.struct(F.lit(name).alias("name"), severity.alias("severity"), confidence.alias("confidence"), F.lit(what).alias("property"))
        )

    rules = [
        threat(dup > 0.01, "Exact Row Duplication", F.when(dup > 0.05, "high").otherwise("medium"), F.round(F.least(F.lit(1.0), dup * 10.0), 2), "uniqueness"),
        threat(auc > 0.6, "Membership Inference Risk", F.when(auc > 0.75, "high").otherwise("medium"), F.round(F.least(F.lit(1.0), (auc - 0.5) * 2.0), 2), "privacy"),
        threat(drift >= 0.15, "High Statistical Drift", F.lit("medium"), F.lit(0.7), "fidelity"),
        threat(auc < 0.45, "High Distance Similarity (Reconstruction Risk)", F.lit("high"), F.round(F.least(F.lit(1.0), (0.5 - auc) * 4.0), 2), "confidentiality"),
    ]
    return runs.select("run_id", F.explode(F.array_compact(F.array(*rules))).alias("t")).select("run_id", "t.*")


def intelligence_risk(dataset_risk: Column, max_reid: Column, density: Column, outlier: Column, score: Column) -> dict[str, Column]:
    """The 0-100 score, its label and the five contributions; a privacy score of exactly 0 counts as 0.5."""
    drs = clamp(F.coalesce(dataset_risk, F.lit(0.0)) / 100.0, 0.0, 1.0)
    ps = clamp(F.when(F.coalesce(score, F.lit(0.0)) == 0.0, 0.5).otherwise(score), 0.0, 1.0)
    pii = clamp(F.coalesce(density, F.lit(0.0)), 0.0, 1.0)
    reid, out = F.coalesce(max_reid, F.lit(0.0)), F.coalesce(outlier, F.lit(0.0))
    parts = {
        "dataset_risk_part": 0.30 * drs,
        "reidentification_part": 0.25 * reid,
        "pii_density_part": 0.20 * pii,
        "outlier_part": 0.15 * out,
        "privacy_part": 0.10 * (1.0 - ps),
    }
    raw = sum(parts.values(), F.lit(0.0))
    total = F.round(F.least(F.lit(100.0), raw * 100.0), 2)
    label = F.when(total >= 80, "CRITICAL").when(total >= 60, "HIGH").when(total >= 30, "MODERATE").otherwise("LOW")
    return {"score": total, "label": label, **{k: F.round(v * 100.0, 2) for k, v in parts.items()}}


def metric_gate(runs: DataFrame, high_risk: bool = False) -> DataFrame:
    """(run_id, check, value, passed): thresholds per metric, then four contradiction rules."""
    spark = runs.sparkSession
    limits = spark.createDataFrame(THRESHOLDS, "metric string, lo double, hi double, strict_lo double, strict_hi double")
    lo, hi = ("strict_lo", "strict_hi") if high_risk else ("lo", "hi")
    names = [m for m, *_ in THRESHOLDS if m in runs.columns]
    single = melt_metrics(runs, names).join(F.broadcast(limits), "metric").select(
        "run_id", F.col("metric").alias("check"), "value", (F.col("value").between(F.col(lo), F.col(hi)) & ~F.isnan("value")).alias("passed")
    )
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in runs.columns else F.lit(default)
    ps, dup, drift = get("privacy_score", 0.0), get("duplicates_rate", 0.0), get("statistical_drift_score", 1.0)
    rules = {
        "HIGH_PRIVACY_WITH_HIGH_DUPLICATES": (ps > 0.85) & (dup > 0.10),
        "HIGH_PRIVACY_WITH_NEAR_ZERO_DRIFT": (ps > 0.92) & (drift < 0.02) & (dup > 0.05),
        "ZERO_ROWS_ACCEPTED": get("acceptance_rate", 1.0) == 0.0,
        "INVERTED_ACCEPTANCE_REJECTION": F.abs(get("acceptance_rate", 0.5) + get("rejection_rate", 0.5) - 1.0) > 0.01,
    }
    rows = [F.struct(F.lit(n).alias("check"), F.lit(None).cast("double").alias("value"), (~c).alias("passed")) for n, c in rules.items()]
    crossed = runs.select("run_id", F.inline(F.array(*rows)))
    return single.unionByName(crossed)


def leakage_gate(runs: DataFrame, max_dup: float = 0.10, min_privacy: float = 0.30, max_auc: float = 0.75) -> DataFrame:
    """(run_id, passed, reasons): refused on too many copies, too low privacy or too good membership inference."""
    checks = [
        ("duplicates_rate", F.col("duplicates_rate") > max_dup),
        ("privacy_score", F.col("privacy_score") < min_privacy),
        ("membership_inference_auc", F.col("membership_inference_auc") > max_auc),
    ]
    bad = F.array_compact(F.array(*[F.when(c | F.isnan(n), F.lit(n)) for n, c in checks]))
    return runs.select("run_id", (F.size(bad) == 0).alias("passed"), F.array_join(bad, ",").alias("reasons"))


def release_decision(checks: DataFrame) -> DataFrame:
    """(run_id, clauses_met, released, reason) from one row per run.

    Needs invariants_passed, metrics_valid, no_contradictions, rows, min_rows, seed, config_hash, leakage_passed
    and verdict.
    """
    clauses = [
        ("INVARIANTS_PASSED", F.col("invariants_passed")),
        ("METRICS_VALID", F.col("metrics_valid")),
        ("NO_CONTRADICTIONS", F.col("no_contradictions")),
        ("ROW_COUNT_MET", F.coalesce(F.col("rows") >= F.col("min_rows"), F.lit(False))),
        ("SEED_RECORDED", F.col("seed").isNotNull()),
        ("CONFIG_HASH_PRESENT", F.coalesce(F.col("config_hash") != "", F.lit(False))),
    ]
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in clauses]))
    reason = (
        F.when(F.size(failed) > 0, F.concat(F.lit("contract: "), F.array_join(failed, ",")))
        .when(~F.col("leakage_passed"), "leakage")
        .when(~F.col("verdict").isin("PASS", "WARN"), F.concat(F.lit("evaluation: "), F.col("verdict")))
        .otherwise("")
    )
    return checks.select("run_id", (F.lit(len(clauses)) - F.size(failed)).alias("clauses_met"), (reason == "").alias("released"), reason.alias("reason"))
