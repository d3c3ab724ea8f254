"""Commit and audit tables of generation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_rows(df: DataFrame, path: str) -> None:
    """Append accepted rows; ``df`` carries run_id and round, which partition the table.

    Each (run, round) is replaced as a whole, so a repeated commit after a failure does not double rows.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "round")
        .parquet(path)
    )


def run_status(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """(run_id, rounds, rows, requested, progress, complete) against (run_id, requested)."""
    committed = spark.read.parquet(path).groupBy("run_id").agg(F.count_distinct("round").alias("rounds"), F.count("*").alias("rows"))
    j = requested.join(committed, "run_id", "left")
    rows = F.coalesce("rows", F.lit(0))
    return j.select(
        "run_id",
        F.coalesce("rounds", F.lit(0)).alias("rounds"),
        rows.alias("rows"),
        "requested",
        F.least(F.lit(100.0), rows / F.greatest(F.col("requested"), F.lit(1)) * 100.0).alias("progress"),
        (rows >= F.col("requested")).alias("complete"),
    )


def audit_log(entries: DataFrame, path: str) -> None:
    """Append audit entries (run_id, stage, event, duration_ms, rows_in, rows_out, rejected)."""
    entries.write.mode("append").parquet(path)


def audit_summary(entries: DataFrame) -> DataFrame:
    """(run_id, stage, starts, successes, failures, duration_ms, rows_in, rows_out, rejected) per run and stage."""
    event = F.col("event")
    return entries.groupBy("run_id", "stage").agg(
        F.count(F.when(event == "START", 1)).alias("starts"),
        F.count(F.when(event == "SUCCESS", 1)).alias("successes"),
        F.count(F.when(event == "FAILURE", 1)).alias("failures"),
        F.coalesce(F.sum(F.when(event != "START", F.col("duration_ms"))), F.lit(0.0)).alias("duration_ms"),
        F.coalesce(F.sum(F.when(event == "START", F.col("rows_in"))), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.when(event == "SUCCESS", F.col("rows_out"))), F.lit(0)).alias("rows_out"),
        F.coalesce(F.sum(F.when(event == "SUCCESS", F.col("rejected"))), F.lit(0)).alias("rejected"),
    )
