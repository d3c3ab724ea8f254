"""Structured Streaming: text and row streams scanned into alert tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import patterns as P
from veilwork.functions.sizing import SPREAD_LIMIT, fits
from veilwork.operators import policy as L
from veilwork.operators import scan as S
from veilwork.session import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over one table, a parquet file or a folder of them; files that arrive later are picked up."""
    today = spark.read.parquet(f"{folder}/{name}.parquet")
    # a glob of the path, since a filter of file names passes none of a folder's part files
    stream = spark.readStream.schema(today.schema).parquet(f"{folder}/{name}*.parquet")
    # one small file would be scanned by one task
    return stream.repartition(spark.sparkContext.defaultParallelism) if fits(today, SPREAD_LIMIT) else stream


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table with exactly-once file commits, and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    out = f"{base}/table"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Batch-only logic per micro-batch. Every batch overwrites its own folder, so a repeated batch leaves no copy."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    # a stream without any rows runs no batch and leaves an empty table
    spark.createDataFrame([], schema).write.parquet(f"{base}/table/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/table").drop("batch")


def stream_scan(stream: DataFrame, text: str, key: str, ts: str, path: str | None = None) -> DataFrame:
    """Alerts (key, ts, line, type, category, severity, snippet, action) of a text stream.

    A projection and a join with the static rule table: no state, any output mode.
    """
    kept = stream if path is None else stream.where(~S.ignored_path(F.col(path)))
    found = kept.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.inline(S.line_hits(F.col(text))))
    lines = found.withColumnsRenamed({"category": "kind", "severity": "own_severity"})
    decided = L.pattern_decision(lines, L.live_rules(stream.sparkSession))
    return decided.select(
        "key", "ts", "line", F.col("pattern").alias("type"),
        F.when(F.col("kind") == "secret", "secret_exposure").otherwise("pii_detected").alias("category"),
        F.coalesce("policy_severity", "own_severity").alias("severity"), "snippet", L.alert_action(F.col("action")).alias("action"),
    )


def dedupe_alerts(alerts: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Once per key within the watermark; the time bound takes the place of a bounded set."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def alert_rate(alerts: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, keys.., n) over tumbling or sliding event-time windows; late rows are dropped."""
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = alerts.withWatermark(ts, delay).groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def alert_sessions(alerts: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, keys.., n): bursts of edits; the event-time form of a debounce."""
    counts = alerts.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def recent_alerts(table: DataFrame, n: int = 200, ts: str = "ts", ties: Sequence[str] = ("key", "line", "type")) -> DataFrame:
    """The newest n alerts of the sink table."""
    return table.orderBy(F.desc(ts), *ties).limit(n)


DATASET_ALERT = "file string, type string, severity string, category string, pattern string, action string"


def dataset_alerts(files: DataFrame, file: str, text: str) -> DataFrame:
    """One audit alert per file, and a second one when header words point to personal data."""
    s = S.header_signal(files, text, [file])
    audit = F.struct(
        F.lit("Dataset file opened").alias("type"), F.lit("low").alias("severity"), F.lit("dataset_risk").alias("category"),
        F.lit("dataset opened - logged for audit").alias("pattern"), F.lit("logged").alias("action"),
    )
    decision = L.alert_action(L.dataset_decision(F.col("pii_density"), F.col("risk")))
    signal = F.struct(
        F.lit("Dataset PII signal").alias("type"), F.when(F.col("risk") >= 70, "high").otherwise("medium").alias("severity"), F.lit("dataset_risk").alias("category"),
        F.concat(F.lit("Dataset Risk: "), "label", F.lit(" | PII Signals: "), F.col("signals").cast("string")).alias("pattern"),
        F.coalesce(decision, F.lit("warned")).alias("action"),
    )
    rows = F.array_compact(F.array(audit, F.when(F.col("signals") > 0, signal)))
    return s.select(F.col(file).cast("string").alias("file"), F.inline(rows))


def stream_dataset_monitor(stream: DataFrame, file: str, text: str, label: str = "datasets") -> DataFrame:
    """``dataset_alerts`` over a stream of arriving files."""
    return run_batches(stream, label, lambda batch: dataset_alerts(batch, file, text), DATASET_ALERT)


def prompt_alerts(turns: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys.., type, severity, category, pattern, action) for turns with findings; batch or stream."""
    r = S.redact_prompts(turns, text, keys).where("items > 0")
    severity = F.when(F.col("has_critical"), "critical").when(F.col("has_high"), "high").otherwise("medium")
    decision = L.prompt_decision(F.col("has_critical"), F.col("has_high"), F.col("items"))
    return r.select(
        *keys, F.lit("Prompt leakage detected").alias("type"), severity.alias("severity"), F.lit("prompt_leakage").alias("category"),
        F.concat(F.lit("Found "), F.col("items").cast("string"), F.lit(" sensitive item(s). Risk: "), F.upper("risk")).alias("pattern"),
        L.alert_action(decision).alias("action"),
    )


PATTERN_NAMES = [p[0] for p in P.LINE_PATTERNS]
