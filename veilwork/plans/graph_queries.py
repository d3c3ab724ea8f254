"""Lineage, graph, card and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions import patterns as PT
from veilwork.functions.numeric import rounded
from veilwork.operators import association as A
from veilwork.operators import graph as G
from veilwork.operators import history as H
from veilwork.operators import policy as L
from veilwork.operators import profile as P
from veilwork.operators import scan as S
from veilwork.plans.compare_queries import SCORED_SQL, scored_runs
from veilwork.plans.fixtures import (
    DOCS_SQL,
    HOLES_SQL,
    LINKED_CATEGORIES,
    LINKED_NUMBERS,
    LINKED_SQL,
    documents_planted,
    lineitem_linked,
    orders_holes,
)
from veilwork.plans.profile_queries import cramers_sql, union_sql
from veilwork.plans.registry import query, table
from veilwork.plans.scan_queries import line_sql

SHORT = "substr(sha256({0}), 1, 16)"
ART_SQL = """art AS (SELECT 'orders/' || strftime(o_orderdate, '%Y-%m') AS source, 'rows=' || count(*) AS ast, 'keys=' || min(o_orderkey) || '..' || max(o_orderkey) AS baseline,
  CASE WHEN count(*) % 3 <> 0 THEN 'sum=' || sum(o_custkey) END AS result, 'low=' || min(o_custkey) AS leakage, 'high=' || max(o_custkey) AS scan FROM orders GROUP BY strftime(o_orderdate, '%Y-%m'))"""


def artifacts(spark, folder):
    text = lambda label, c: F.concat(F.lit(label), c.cast("string"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    return (
        table(spark, folder, "orders")
        .groupBy(month.alias("m"))
        .agg(F.count("*").alias("n"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"), F.sum("o_custkey").alias("s"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
        .select(
            F.concat(F.lit("orders/"), "m").alias("source"), text("rows=", F.col("n")).alias("ast"),
            F.concat(F.lit("keys="), F.col("a").cast("string"), F.lit(".."), F.col("b").cast("string")).alias("baseline"),
            F.when(F.col("n") % 3 != 0, text("sum=", F.col("s"))).alias("result"), text("low=", F.col("lo")).alias("leakage"), text("high=", F.col("hi")).alias("scan"),
        )
    )


STEPS_SQL = f"""{ART_SQL}, steps AS ({' UNION ALL '.join(
    f"SELECT {SHORT.format('source')} AS dataset_id, {i + 1} AS seq, '{s}' AS step, '{a}' AS action, coalesce({SHORT.format(x)}, '') AS input_hash, {SHORT.format(y)} AS output_hash FROM art WHERE {y} IS NOT NULL"
    for i, (s, a, x, y) in enumerate([('Parse', 'parse', 'source', 'ast'), ('Baseline', 'profile', 'ast', 'baseline'), ('Generate', 'generate', 'baseline', 'result'), ('Leakage Analysis', 'analyze', 'result', 'leakage'), ('PII Scan', 'scan', 'leakage', 'scan')])
)})"""


@query("lineage_steps", f"WITH {STEPS_SQL} SELECT * FROM steps")
def _(spark, folder):
    return G.lineage_steps(artifacts(spark, folder))


@query(
    "lineage_chain",
    f"""WITH {STEPS_SQL}, l AS (SELECT *, lag(output_hash) OVER (PARTITION BY dataset_id ORDER BY seq) AS b FROM steps)
SELECT dataset_id, count(*) AS steps, bool_and(b IS NULL OR b = input_hash) AS intact, arg_max(output_hash, seq) AS current_hash FROM l GROUP BY 1""",
)
def _(spark, folder):
    return G.lineage_chain(G.lineage_steps(artifacts(spark, folder)))


GRAPH_COLUMNS = LINKED_NUMBERS + LINKED_CATEGORIES
PEARSON_LINKED = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM linked" for i, a in enumerate(LINKED_NUMBERS) for b in LINKED_NUMBERS[i + 1 :])


@query(
    "column_graph",
    cramers_sql(LINKED_CATEGORIES, "linked", LINKED_SQL).replace("SELECT col_a, col_b, round(sqrt", ", v AS (SELECT col_a, col_b, round(sqrt")
    + f"""), p AS ({PEARSON_LINKED})
SELECT 'dataset' AS source, 'entity_l' AS target, 'contains' AS relationship, CAST(1.0 AS DOUBLE) AS weight UNION ALL SELECT 'dataset', 'entity_financial', 'contains', 1.0
UNION ALL SELECT CASE WHEN c LIKE 'l\\_%' ESCAPE '\\' THEN 'entity_l' WHEN c = 'price_band' THEN 'entity_financial' ELSE 'dataset' END, 'attr_' || c, 'has_attribute', 1.0 FROM (SELECT unnest({GRAPH_COLUMNS}) AS c)
UNION ALL SELECT 'dataset', 'pii_concern', 'contains', 1.0 UNION ALL SELECT 'attr_l_net', 'pii_concern', 'flagged_as', 1.0
UNION ALL SELECT 'attr_' || a, 'attr_' || b, 'correlates_with', round(abs(v), 3) FROM p WHERE abs(v) >= 0.25
UNION ALL SELECT 'attr_' || col_a, 'attr_' || col_b, 'associated_with', round(abs(value), 3) FROM v WHERE abs(value) >= 0.2""",
)
def _(spark, folder):
    df = lineitem_linked(spark, folder)
    return G.column_graph(GRAPH_COLUMNS, A.pearson_pairs(df, LINKED_NUMBERS), A.cramers_v(df, LINKED_CATEGORIES), ["l_net"])


FK_TABLES = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
FK_LIST = [
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
]


@query(
    "fk_candidates",
    "WITH f AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{o}' AS ref_table, '{k}' AS ref_column, count(*) AS distinct_values, count(*) FILTER (v NOT IN (SELECT {k} FROM {o})) AS missing FROM (SELECT DISTINCT {c} AS v FROM {t})"
        for t, c, o, k in FK_LIST
    )
    + ") SELECT *, round(1 - missing / greatest(distinct_values, 1), 6) AS containment, missing = 0 AS is_key FROM f",
)
def _(spark, folder):
    tables = {t: (table(spark, folder, t), k) for t, k in FK_TABLES.items()}
    tables["lineitem"] = (table(spark, folder, "lineitem"), "l_rowid")
    out = G.fk_candidates(tables)
    return out.withColumn("containment", rounded(F.col("containment"), 6))


HOLE_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"]
MISSING_SQL = f"""{HOLES_SQL}, ml AS ({union_sql(HOLE_COLUMNS, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM holes")}),
prof AS (SELECT "column", avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio, count(DISTINCT v) AS d FROM ml GROUP BY 1)"""


@query(
    "dataset_card",
    f"""WITH {MISSING_SQL} SELECT 'overview' AS section, 'rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM holes
UNION ALL SELECT 'overview', 'columns', '5' UNION ALL SELECT 'overview', 'numeric_features', '3' UNION ALL SELECT 'overview', 'categorical_features', '2'
UNION ALL SELECT 'schema', "column" || '.distinct', CAST(d AS VARCHAR) FROM prof
UNION ALL SELECT 'schema', 'o_orderkey.mean', CAST(round(avg(o_orderkey), 2) AS VARCHAR) FROM holes UNION ALL SELECT 'schema', 'o_totalprice.mean', CAST(round(avg(o_totalprice), 2) AS VARCHAR) FROM holes
UNION ALL SELECT 'schema', 'o_custkey.mean', CAST(round(avg(o_custkey), 2) AS VARCHAR) FROM holes
UNION ALL SELECT 'missing', "column", CAST(round(missing_ratio, 4) AS VARCHAR) FROM prof WHERE missing_ratio > 0.05""",
)
def _(spark, folder):
    df = orders_holes(spark, folder)
    return G.dataset_card(df, P.profile_light(df), A.pearson_pairs(df, ["o_totalprice", "o_custkey"]))


PII_TWO = [("o_custkey",), ("o_orderkey",)]


@query(
    "dashboard_metrics",
    f"""WITH {MISSING_SQL} SELECT count(*) AS columns, 2 AS pii_columns, round(2 / count(*), 6) AS pii_ratio, 'warning' AS level, round((1 - 2 / count(*)) * 100, 0) AS privacy_estimate,
  round(avg(missing_ratio), 6) AS mean_null FROM prof""",
)
def _(spark, folder):
    out = G.dashboard_metrics(P.profile_light(orders_holes(spark, folder)), spark.createDataFrame(PII_TWO, "column string"))
    return out.withColumn("pii_ratio", rounded(F.col("pii_ratio"), 6)).withColumn("mean_null", rounded(F.col("mean_null"), 6))


@query(
    "risk_radar",
    SCORED_SQL + " SELECT run_id, dataset_risk_score AS risk, round(privacy_score * 100, 4) AS privacy, round(max_reid * 100, 4) AS reidentification, round(least(avg_drift * 100, 100.0), 4) AS drift FROM risky",
)
def _(spark, folder):
    out = G.risk_radar(scored_runs(spark, folder))
    return out.select("run_id", "risk", *[rounded(F.col(c), 4).alias(c) for c in ("privacy", "reidentification", "drift")])


@query(
    "risk_estimate",
    f"""WITH {MISSING_SQL}, e AS (SELECT least(100.0, round(2 / count(*) * 60 + avg(missing_ratio) * 40, 0)) AS estimate FROM prof)
SELECT estimate, CASE WHEN estimate >= 70 THEN 'HIGH RISK' WHEN estimate >= 40 THEN 'MOD RISK' ELSE 'LOW RISK' END AS label FROM e""",
)
def _(spark, folder):
    return G.baseline_risk_estimate(P.profile_light(orders_holes(spark, folder)), spark.createDataFrame(PII_TWO, "column string"))


RULE_VALUES = "names(pattern, rule) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PT.PATTERN_RULE) + "), rules(rule, action, sev) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{s}')" for r, _, a, s in PT.LIVE_RULES) + ")"


@query(
    "alert_counts",
    f"""WITH {DOCS_SQL}, {line_sql('docs', 'doc_id')}, {RULE_VALUES}
SELECT CASE category WHEN 'secret' THEN 'secret_exposure' ELSE 'pii_detected' END AS category, sev AS severity, CASE action WHEN 'block' THEN 'blocked' ELSE 'warned' END AS action, count(*) AS n
FROM placed JOIN names USING (pattern) JOIN rules USING (rule) GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    hits = L.pattern_decision(S.scan_lines(documents_planted(spark, folder), "text", "doc_id"))
    alerts = hits.select(
        F.when(F.col("category") == "secret", "secret_exposure").otherwise("pii_detected").alias("category"),
        F.col("policy_severity").alias("severity"), L.alert_action(F.col("action")).alias("action"),
    )
    return G.alert_counts(alerts)


# ---- run history

SNAP_NUMBERS = ["l_quantity", "l_extendedprice"]
SNAP_TEXTS = ["l_returnflag", "l_linestatus"]


def monthly(spark, folder):
    return table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("run"), *SNAP_NUMBERS, *SNAP_TEXTS)


MONTHLY_SQL = f"""mon AS (SELECT strftime(l_shipdate, '%Y-%m') AS run_id, {', '.join(SNAP_NUMBERS + SNAP_TEXTS)} FROM lineitem),
nl AS ({union_sql(SNAP_NUMBERS, "SELECT run_id, '{c}' AS \"column\", {c} AS v FROM mon")}),
ns AS (SELECT run_id, "column", count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, [0.25, 0.5, 0.75]) AS q, min(v) AS lo, max(v) AS hi FROM nl GROUP BY 1, 2 HAVING count(*) >= 2),
tl AS ({union_sql(SNAP_TEXTS, "SELECT run_id, '{c}' AS \"column\", {c} AS v FROM mon")}),
tc AS (SELECT run_id, "column", v, count(*) AS k FROM tl GROUP BY 1, 2, 3), tr AS (SELECT *, sum(k) OVER w AS n, count(*) OVER w AS d FROM tc WINDOW w AS (PARTITION BY run_id, "column"))"""


@query(
    "snapshot",
    f"""WITH {MONTHLY_SQL} SELECT run_id, "column", 'numeric' AS kind, n, round(mean, 4) AS mean, round(std, 4) AS std, round(q[1], 4) AS q25, round(q[2], 4) AS q50, round(q[3], 4) AS q75, lo AS min, hi AS max, NULL AS freqs FROM ns
UNION ALL SELECT run_id, "column", 'categorical', CAST(any_value(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, string_agg(v || '=' || round(k / n, 4), ',' ORDER BY v) FROM tr WHERE d <= 100 AND d / n <= 0.8 GROUP BY 1, 2""",
)
def _(spark, folder):
    out = H.snapshot(monthly(spark, folder), "run")
    shown = F.transform("freqs", lambda x: F.concat(x["value"], F.lit("="), F.round(x["ratio"], 4).cast("string")))
    return out.select(
        "run_id", "column", "kind", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")], "min", "max",
        F.when(F.col("freqs").isNotNull(), F.array_join(shown, ",")).alias("freqs"),
    )


def cdf_sql(x):
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"((((1.330274429 * {t} - 1.821255978) * {t} + 1.781477937) * {t} - 0.356563782) * {t} + 0.319381530) * {t}"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * ({poly}))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query(
    "compare_runs",
    f"""WITH {MONTHLY_SQL}, np AS (SELECT *, lag(run_id) OVER w AS previous, lag(mean) OVER w AS m1, greatest(lag(std) OVER w, 1e-6) AS s1, greatest(std, 1e-6) AS s2 FROM ns WINDOW w AS (PARTITION BY "column" ORDER BY run_id)),
nr AS (SELECT *, least(m1 - 3 * s1, mean - 3 * s2) AS a, greatest(m1 + 3 * s1, mean + 3 * s2) AS b FROM np WHERE previous IS NOT NULL),
ne AS (SELECT run_id, previous, "column", i, a + (b - a) * i / 20.0::DOUBLE AS e, m1, s1, mean, s2 FROM nr, range(21) t(i)),
nf AS (SELECT *, (e - m1) / s1 AS z1, (e - mean) / s2 AS z2 FROM ne), nc AS (SELECT *, {cdf_sql('z1')} AS f1, {cdf_sql('z2')} AS f2 FROM nf),
nm AS (SELECT run_id, previous, "column", f1 - lag(f1) OVER w + 1e-10 AS p, f2 - lag(f2) OVER w + 1e-10 AS q FROM nc WINDOW w AS (PARTITION BY run_id, "column" ORDER BY i)),
runs AS (SELECT "column", run_id, lag(run_id) OVER (PARTITION BY "column" ORDER BY run_id) AS previous FROM (SELECT DISTINCT "column", run_id FROM tr WHERE d <= 100 AND d / n <= 0.8)),
ok AS (SELECT * FROM tr WHERE d <= 100 AND d / n <= 0.8),
cn AS (SELECT r."column", r.run_id, r.previous, o.v FROM runs r JOIN ok o ON o."column" = r."column" AND o.run_id = r.run_id WHERE r.previous IS NOT NULL
  UNION SELECT r."column", r.run_id, r.previous, o.v FROM runs r JOIN ok o ON o."column" = r."column" AND o.run_id = r.previous),
cm AS (SELECT c.run_id, c.previous, c."column", coalesce(x.k / x.n, 0) + 1e-10 AS p, coalesce(y.k / y.n, 0) + 1e-10 AS q FROM cn c
  LEFT JOIN ok x ON x."column" = c."column" AND x.run_id = c.previous AND x.v = c.v LEFT JOIN ok y ON y."column" = c."column" AND y.run_id = c.run_id AND y.v = c.v),
al AS (SELECT *, 'numeric' AS kind FROM nm WHERE p IS NOT NULL UNION ALL SELECT *, 'categorical' FROM cm),
nn AS (SELECT run_id, previous, "column", kind, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM al WINDOW w AS (PARTITION BY run_id, "column")),
js AS (SELECT run_id, previous, "column", kind, round(least(1.0, greatest(0.0, 0.5 * sum(p * ln(p / (0.5 * (p + q)))) + 0.5 * sum(q * ln(q / (0.5 * (p + q)))))), 4) + 0.0 AS js FROM nn GROUP BY 1, 2, 3, 4)
SELECT *, js > 0.25 AS drifted, js > 0.55 AS critical FROM js""",
)
def _(spark, folder):
    return H.compare_runs(H.snapshot(monthly(spark, folder), "run"))


@query(
    "run_history",
    """WITH r AS (SELECT l_returnflag AS dataset, strftime(l_shipdate, '%Y-%m') AS run_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY run_id DESC) AS INTEGER) AS age FROM r)
SELECT *, age = 1 AS latest FROM h WHERE age <= 50""",
)
def _(spark, folder):
    runs = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.date_format("l_shipdate", "yyyy-MM").alias("run_id")).agg(F.count("*").alias("n"))
    return H.run_history(runs, "dataset", "run_id")

