"""Streaming queries: file streams over the test tables, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.operators import graph as G
from veilwork.plans.fixtures import DOCS_SQL, _planted
from veilwork.plans.graph_queries import RULE_VALUES
from veilwork.plans.registry import query
from veilwork.plans.scan_queries import HEADER_SQL, SPANS_SQL, line_sql
from veilwork.streaming import alerts as Z

EPOCH = 1704067200


def document_stream(spark, folder):
    docs = _planted(Z.table_stream(spark, folder, "documents"), "doc_id")
    return docs.withColumn("ts", F.timestamp_seconds(F.col("doc_id") + EPOCH))


ALERTS_SQL = f"""WITH {DOCS_SQL}, {line_sql('docs', 'doc_id')}, {RULE_VALUES},
alerts AS (SELECT key, key + {EPOCH} AS at_s, line, pattern AS type, CASE category WHEN 'secret' THEN 'secret_exposure' ELSE 'pii_detected' END AS category, sev AS severity, left(m, 80) AS snippet,
  CASE action WHEN 'block' THEN 'blocked' ELSE 'warned' END AS action FROM placed JOIN names USING (pattern) JOIN rules USING (rule))"""


def shown(alerts):
    return alerts.select("key", F.unix_seconds("ts").alias("at_s"), "line", "type", "category", "severity", "snippet", "action")


@query("stream_scan", ALERTS_SQL + " SELECT * FROM alerts")
def _(spark, folder):
    return shown(Z.run_available(Z.stream_scan(document_stream(spark, folder), "text", "doc_id", "ts"), "scan"))


@query("stream_dedupe", ALERTS_SQL + " SELECT DISTINCT key, line, type FROM alerts")
def _(spark, folder):
    alerts = Z.stream_scan(document_stream(spark, folder), "text", "doc_id", "ts")
    return Z.run_available(Z.dedupe_alerts(alerts, ["key", "line", "type"]), "dedupe").select("key", "line", "type")


@query("recent_alerts", ALERTS_SQL + " SELECT key, at_s, line, type, category, severity, action FROM alerts ORDER BY at_s DESC, key, line, type LIMIT 200")
def _(spark, folder):
    sink = Z.run_available(Z.stream_scan(document_stream(spark, folder), "text", "doc_id", "ts"), "recent")
    return shown(Z.recent_alerts(sink)).drop("snippet")


@query("stream_alert_counts", ALERTS_SQL + " SELECT category, severity, action, count(*) AS n FROM alerts GROUP BY 1, 2, 3")
def _(spark, folder):
    alerts = Z.stream_scan(document_stream(spark, folder), "text", "doc_id", "ts").select("category", "severity", "action")
    # counts per micro-batch are summed at read time, so the table stays append-only
    parts = Z.run_batches(alerts, "counts", G.alert_counts, "category string, severity string, action string, n long")
    return parts.groupBy("category", "severity", "action").agg(F.sum("n").alias("n"))


def event_stream(spark, folder):
    return Z.table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_windows",
    """WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, n FROM w, m WHERE s + INTERVAL 1 HOUR <= wm""",
)
def _(spark, folder):
    out = Z.run_available(Z.alert_rate(event_stream(spark, folder), ["event_type"]), "windows")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query(
    "stream_sliding",
    """WITH e AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS s, event_type FROM events, range(2) t(k)), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, count(*) AS n FROM e, m WHERE s + INTERVAL 2 HOUR <= wm GROUP BY 1, 2""",
)
def _(spark, folder):
    out = Z.run_available(Z.alert_rate(event_stream(spark, folder), ["event_type"], width="2 hours", slide="1 hour"), "sliding")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query(
    "stream_sessions",
    """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS sid FROM g), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT event_type, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1200000000 AS session_end, count(*) AS n FROM s, m GROUP BY event_type, sid, wm HAVING max(ts) + INTERVAL 20 MINUTE <= wm""",
)
def _(spark, folder):
    out = Z.run_available(Z.alert_sessions(event_stream(spark, folder), ["event_type"], gap="20 minutes"), "sessions")
    return out.select("event_type", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query(
    "stream_dataset_monitor",
    HEADER_SQL
    + """ SELECT CAST(doc_id AS VARCHAR) AS file, 'Dataset file opened' AS type, 'low' AS severity, 'logged' AS action FROM d
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Dataset PII signal', CASE WHEN risk >= 70 THEN 'high' ELSE 'medium' END, CASE WHEN pii_density >= 0.7 THEN 'blocked' ELSE 'warned' END FROM d WHERE signals > 0""",
)
def _(spark, folder):
    out = Z.stream_dataset_monitor(document_stream(spark, folder), "doc_id", "text")
    return out.select("file", "type", "severity", "action")


@query(
    "prompt_alerts",
    SPANS_SQL
    + """ SELECT conv_id, turn, 'Prompt leakage detected' AS type, CASE WHEN has_critical THEN 'critical' WHEN has_high THEN 'high' ELSE 'medium' END AS severity,
  'prompt_leakage' AS category, 'Found ' || items || ' sensitive item(s). Risk: ' || upper(risk) AS pattern, CASE WHEN has_critical THEN 'blocked' ELSE 'warned' END AS action
FROM redacted WHERE items > 0""",
)
def _(spark, folder):
    turns = Z.table_stream(spark, folder, "conversations").withColumn("_k", F.col("conv_id") + F.col("turn"))
    alerts = Z.prompt_alerts(_planted(turns, "_k"), "text", ["conv_id", "turn"])
    return Z.run_available(alerts, "prompts")


