"""Source, sink, run table and edit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.numeric import rounded
from veilwork.operators import edit as E
from veilwork.plans.fixtures import ORDERS_SQL, RELEASE_SQL, orders_original, orders_release
from veilwork.plans.registry import query, table
from veilwork.session import scratch_path
from veilwork.sources import runs as U
from veilwork.sources import tables as B


@query("read_table", "SELECT * FROM orders")
def _(spark, folder):
    return B.read_table(spark, f"{folder}/orders.parquet")


@query("read_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(spark, folder):
    path = scratch_path(spark, "orders") + ".csv"
    B.write_table(table(spark, folder, "orders"), path, "csv")
    back = B.read_table(spark, path)
    return back.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority",
    )


@query("sniff_delimiter", "SELECT '|' AS delimiter, 5 AS fields, CAST(1.0 AS DOUBLE) AS share FROM customer LIMIT 1")
def _(spark, folder):
    path = scratch_path(spark, "customer")
    table(spark, folder, "customer").write.csv(path, header=True, sep="|")
    return B.sniff_delimiter(spark, path).limit(1)


@query(
    "read_json",
    "SELECT c_custkey, c_acctbal, c_mktsegment AS segment, c_nationkey % 3 AS slot FROM customer",
)
def _(spark, folder):
    path = scratch_path(spark, "nested") + ".jsonl"
    c = table(spark, folder, "customer")
    record = F.struct("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("slot"))
    lines = c.select(F.to_json(F.struct(F.struct(F.array(record).alias("rows")).alias("payload"))).alias("value"))
    lines = lines.unionByName(c.where("c_custkey = 0").select(F.lit('{"payload": ').alias("value")))
    lines.write.text(path)
    rows, _bad = B.read_json_records(spark, path, ["payload", "rows"])
    return rows


def mixed_lines(spark, folder):
    """Events as JSON lines: objects, numbers on their own, and lines cut off."""
    e = table(spark, folder, "events")
    path = scratch_path(spark, "mixed") + ".jsonl"
    whole = F.to_json(F.struct("event_id", "user_id"))
    line = F.when(F.col("event_id") % 7 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 11 == 2, F.concat(F.lit('{"event_id": '), "event_id")).otherwise(whole)
    e.select(line.alias("value")).write.text(path)
    return B.read_json_records(spark, path)


@query(
    "read_json_scalars",
    """SELECT CASE WHEN event_id % 7 = 1 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 7 = 1 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 7 = 1 THEN event_id END AS value FROM events WHERE event_id % 7 = 1 OR event_id % 11 <> 2""",
)
def _(spark, folder):
    return mixed_lines(spark, folder)[0]


@query("read_json_bad_lines", """SELECT '{"event_id": ' || event_id AS _bad_line FROM events WHERE event_id % 7 <> 1 AND event_id % 11 = 2""")
def _(spark, folder):
    return mixed_lines(spark, folder)[1]


@query(
    "flatten_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\", user_id AS \"who.user_id\", event_type AS \"who.kind\", '[' || event_id || ',' || user_id || ']' AS pair FROM events",
)
def _(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.from_json("props", "k long").alias("props"), F.struct("user_id", F.col("event_type").alias("kind")).alias("who"),
        F.array("event_id", "user_id").alias("pair"),
    )
    return B.flatten_struct(e)


@query(
    "stringify_nested",
    "SELECT event_id, '{\"user_id\":' || user_id || ',\"kind\":\"' || event_type || '\"}' AS who, '[' || event_id || ',' || user_id || ']' AS pair FROM events",
)
def _(spark, folder):
    e = table(spark, folder, "events").select(
        "event_id", F.struct("user_id", F.col("event_type").alias("kind")).alias("who"), F.array("event_id", "user_id").alias("pair")
    )
    return B.stringify_nested(e)


@query("head_rows", "SELECT * FROM events ORDER BY event_id LIMIT 100")
def _(spark, folder):
    return B.head_rows(table(spark, folder, "events"), 100, "event_id")


@query("write_table", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, folder):
    path = scratch_path(spark, "documents") + ".csv"
    docs = table(spark, folder, "documents")
    B.write_table(docs, path, "csv")
    return B.read_table(spark, path, schema=docs.schema, multiline=True)


@query(
    "fingerprint",
    """SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5('=' || c_custkey || '|' || '=' || c_name || '|' || '=' || c_nationkey || '|' || '=' || c_acctbal || '|' || coalesce('=' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '-')), 1, 12)) AS HUGEINT)) AS VARCHAR) AS hash_sum FROM customer""",
)
def _(spark, folder):
    c = table(spark, folder, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return B.content_fingerprint(c)


COMMIT_SQL = """r AS (SELECT l_returnflag AS run_id, count(DISTINCT l_linenumber) AS rounds, count(*) AS rows FROM lineitem GROUP BY 1),
q AS (SELECT 'A' AS run_id, 0 + 1000 AS requested UNION ALL SELECT 'N', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'Z', 10)"""


@query(
    "commit_status",
    f"""WITH {COMMIT_SQL} SELECT run_id, coalesce(rounds, 0) AS rounds, coalesce(rows, 0) AS rows, requested, round(least(100.0, coalesce(rows, 0) / requested * 100), 4) AS progress,
  coalesce(rows, 0) >= requested AS complete FROM q LEFT JOIN r USING (run_id)""",
)
def _(spark, folder):
    path = scratch_path(spark, "commits")
    li = table(spark, folder, "lineitem")
    U.commit_rows(li.withColumn("run_id", F.col("l_returnflag")).withColumn("round", F.col("l_linenumber")), path)
    total = li.agg(F.count("*")).scalar()
    wanted = spark.createDataFrame([("A", 1000), ("N", -1), ("Z", 10)], "run_id string, requested long")
    wanted = wanted.withColumn("requested", F.when(F.col("requested") < 0, total).otherwise(F.col("requested")))
    out = U.run_status(spark, path, wanted)
    return out.withColumn("progress", rounded(F.col("progress"), 4))


@query(
    "audit_summary",
    """WITH a AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS stage, CASE user_id % 3 WHEN 0 THEN 'START' WHEN 1 THEN 'SUCCESS' ELSE 'FAILURE' END AS event, value, event_id FROM events)
SELECT run_id, stage, count(*) FILTER (event = 'START') AS starts, count(*) FILTER (event = 'SUCCESS') AS successes, count(*) FILTER (event = 'FAILURE') AS failures,
  round(coalesce(sum(value) FILTER (event <> 'START'), 0), 4) AS duration_ms, CAST(coalesce(sum(event_id % 100) FILTER (event = 'START'), 0) AS BIGINT) AS rows_in,
  CAST(coalesce(sum(event_id % 90) FILTER (event = 'SUCCESS'), 0) AS BIGINT) AS rows_out, CAST(coalesce(sum(event_id % 10) FILTER (event = 'SUCCESS'), 0) AS BIGINT) AS rejected FROM a GROUP BY 1, 2""",
)
def _(spark, folder):
    path = scratch_path(spark, "audit")
    e = table(spark, folder, "events")
    u = F.col("user_id") % 3
    entries = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("stage"),
        F.when(u == 0, "START").when(u == 1, "SUCCESS").otherwise("FAILURE").alias("event"), F.col("value").alias("duration_ms"),
        (F.col("event_id") % 100).alias("rows_in"), (F.col("event_id") % 90).alias("rows_out"), (F.col("event_id") % 10).alias("rejected"),
    )
    U.audit_log(entries, path)
    out = U.audit_summary(spark.read.parquet(path))
    return out.withColumn("duration_ms", rounded(F.col("duration_ms"), 4))


# ---- edits


@query("edit_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, 'new' AS tag, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(spark, folder):
    df = E.drop_column(table(spark, folder, "customer"), "c_name")
    return E.add_column(E.add_column(df, "tag", "new"), "note")


@query("delete_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, folder):
    ids = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return E.delete_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")


@query("keep_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, folder):
    ids = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return E.keep_rows(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")


@query(
    "delete_where",
    "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE NOT coalesce(CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END > 1000 AND c_mktsegment <> 'MACHINERY', false)",
)
def _(spark, folder):
    df = table(spark, folder, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    return E.delete_where(df, "c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_acctbal")


@query(
    "merge_rows",
    "SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier",
)
def _(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return E.merge_rows(a, b)


@query("combine_tagged", f"WITH {ORDERS_SQL}, {RELEASE_SQL} SELECT *, 'original' AS _source FROM orig UNION ALL SELECT *, 'synthetic' FROM synth")
def _(spark, folder):
    return E.combine_tagged(orders_original(spark, folder), orders_release(spark, folder))


@query("sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, folder):
    return E.sort_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", ascending=False)
