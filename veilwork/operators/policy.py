"""Policy decisions: findings, patterns and risk numbers against rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import patterns as P


def finding_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        P.FINDING_RULES, "rule string, type string, category string, severity string, action string, description string"
    )


def live_rules(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """(rule, enabled, action, severity); ``overrides`` is the ``rules`` map of a policy file."""
    rows = []
    for rule, enabled, action, severity in P.LIVE_RULES:
        o = (overrides or {}).get(rule, {})
        rows.append((rule, bool(o.get("enabled", enabled)), o.get("action", action), o.get("severity", severity)))
    return spark.createDataFrame(rows, "rule string, enabled boolean, action string, severity string")


def load_policy(path: str) -> dict:
    """Read a small YAML policy file (rules, thresholds) on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def apply_policy(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(rule, severity, action, instances, column, message) of every violated rule.

    Findings are counted per (type, category) before they meet the static rule table.
    """
    rules = finding_rules(findings.sparkSession) if rules is None else rules
    counts = findings.groupBy("type", "category").agg(F.count("*").alias("instances"), F.min("column").alias("column"))
    hit = counts.join(F.broadcast(rules), ["type", "category"])
    message = F.concat(F.col("description"), F.lit(": "), F.col("instances").cast("string"), F.lit(" instance(s) found"))
    return hit.select("rule", "severity", "action", "instances", "column", message.alias("message"))


def risk_threshold(violations: DataFrame, risk: DataFrame, limit: float = 50.0) -> DataFrame:
    """Add a blocking violation when the scan score exceeds the limit."""
    over = risk.where(F.col("risk_score") > limit).select(
        F.lit("risk_score_threshold").alias("rule"),
        F.lit("high").alias("severity"),
        F.lit("block").alias("action"),
        F.lit(1).cast("long").alias("instances"),
        F.lit(None).cast("string").alias("column"),
        F.concat(
            F.lit("Risk score "), F.round("risk_score", 0).cast("int").cast("string"), F.lit(f" exceeds threshold {limit:g}")
        ).alias("message"),
    )
    return violations.unionByName(over)


def policy_action(violations: DataFrame) -> DataFrame:
    """One row: the strongest action, block above warn above pass."""
    rank = F.max(F.when(F.col("action") == "block", 2).when(F.col("action") == "warn", 1).otherwise(0))
    names = F.array(F.lit("pass"), F.lit("warn"), F.lit("block"))
    return violations.agg(F.count("*").alias("violations"), names[F.coalesce(rank, F.lit(0))].alias("action"))


def pattern_decision(alerts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Add rule, action and policy severity for the ``pattern`` of each row; disabled or unknown rules give null."""
    spark = alerts.sparkSession
    rules = live_rules(spark) if rules is None else rules
    names = spark.createDataFrame(P.PATTERN_RULE, "pattern string, rule string")
    active = names.join(rules.where("enabled"), "rule").select(
        "pattern", "rule", "action", F.col("severity").alias("policy_severity")
    )
    return alerts.join(F.broadcast(active), "pattern", "left")


def dataset_decision(density: Column, risk: Column) -> Column:
    return F.when(density >= P.DENSITY_BLOCK, "block").when((density >= P.DENSITY_WARN) | (risk >= P.RISK_WARN), "warn").otherwise("none")


def prompt_decision(has_critical: Column, has_high: Column, items: Column, max_items: int = P.PROMPT_MAX_ITEMS) -> Column:
    """block on critical, warn on high or on more than ``max_items`` items (0: any item counts)."""
    return F.when(has_critical, "block").when(has_high | (items > max_items), "warn").otherwise("none")


def alert_action(decision: Column) -> Column:
    return F.when(decision == "block", "blocked").when(decision == "warn", "warned").when(decision == "log", "logged")
