"""Queries comparing the orders with their perturbed release, and scores over run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.numeric import rounded
from veilwork.operators import audit as R
from veilwork.operators import compare as C
from veilwork.operators import metrics as M
from veilwork.operators import profile as P
from veilwork.plans.fixtures import (
    HOLES_SQL,
    PAIR_SQL,
    RUNS_SQL,
    order_runs,
    orders_holes,
    orders_original,
    orders_release,
)
from veilwork.plans.profile_queries import union_sql
from veilwork.plans.registry import ORACLES, query, table

NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
TEXTS = ["o_orderstatus", "o_orderpriority"]


def pair(spark, folder):
    return orders_original(spark, folder), orders_release(spark, folder)


def digits(df, n, *names):
    return df.select(*[rounded(F.col(c), n).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "exact_copy_rate",
    PAIR_SQL
    + """, o AS (SELECT DISTINCT o_orderkey, o_custkey, round(o_totalprice, 4) AS p, o_orderstatus, o_orderpriority FROM orig)
SELECT count(o.o_orderkey) AS copies, count(*) AS rows, round(count(o.o_orderkey) / count(*), 6) AS rate
FROM synth s LEFT JOIN o ON s.o_orderkey = o.o_orderkey AND s.o_custkey = o.o_custkey AND round(s.o_totalprice, 4) = o.p
  AND s.o_orderstatus = o.o_orderstatus AND s.o_orderpriority = o.o_orderpriority""",
)
def _(spark, folder):
    return digits(C.exact_copy_rate(*pair(spark, folder)), 6, "rate")


@query(
    "exact_copy_rate_nulls",
    f"""WITH {HOLES_SQL}, a AS (SELECT o_totalprice, o_orderpriority, o_orderstatus FROM holes),
b AS (SELECT o_totalprice, CASE WHEN o_orderkey % 4 = 1 THEN '9-OTHER' ELSE o_orderpriority END AS o_orderpriority, o_orderstatus FROM holes)
SELECT count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice
  AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus)) AS copies,
  count(*) AS rows FROM b""",
)
def _(spark, folder):
    h = orders_holes(spark, folder)
    a = h.select("o_totalprice", "o_orderpriority", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 4 == 1, "9-OTHER").otherwise(F.col("o_orderpriority"))
    b = h.withColumn("o_orderpriority", changed).select("o_totalprice", "o_orderpriority", "o_orderstatus")
    return C.exact_copy_rate(a, b).drop("rate")


@query(
    "drop_copies",
    PAIR_SQL + """ SELECT * FROM synth s WHERE NOT EXISTS (SELECT 1 FROM orig o WHERE s.o_orderkey = o.o_orderkey AND s.o_custkey = o.o_custkey
  AND round(s.o_totalprice, 4) = round(o.o_totalprice, 4) AND s.o_orderstatus = o.o_orderstatus AND s.o_orderpriority = o.o_orderpriority)""",
)
def _(spark, folder):
    return C.drop_copies(*pair(spark, folder))


def numeric_js_sql(columns, inner, clamp):
    long = union_sql(columns, "SELECT '{c}' AS \"column\", 0 AS s, CAST({c} AS DOUBLE) AS v FROM orig UNION ALL SELECT '{c}', 1, CAST({c} AS DOUBLE) FROM synth")
    value = "least(1.0, greatest(0.0, js))" if clamp else "js"
    return f"""nl AS ({long}), ne AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(*) FILTER (s = 0) AS t0, count(*) FILTER (s = 1) AS t1 FROM nl GROUP BY 1),
nb AS (SELECT "column", CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS b, count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1 FROM nl JOIN ne USING ("column") GROUP BY 1, 2),
ng AS (SELECT "column", b, lo, hi, t0, t1 FROM ne, range(20) t(b)),
nd AS (SELECT "column", coalesce(n0, 0) / t0 / ((hi - lo) / 20) + 1e-10 AS p, coalesce(n1, 0) / t1 / ((hi - lo) / 20) + 1e-10 AS q FROM ng LEFT JOIN nb USING ("column", b)),
nn AS (SELECT "column", p / sum(p) OVER (PARTITION BY "column") AS p, q / sum(q) OVER (PARTITION BY "column") AS q FROM nd),
njs0 AS (SELECT "column", 0.5 * sum(p * ln(p / (0.5 * (p + q)) + {inner})) + 0.5 * sum(q * ln(q / (0.5 * (p + q)) + {inner})) AS js FROM nn GROUP BY 1),
njs AS (SELECT "column", {value} AS js FROM njs0)"""


def text_js_sql(columns, on_counts):
    long = union_sql(columns, "SELECT '{c}' AS \"column\", 0 AS s, {c} AS v FROM orig UNION ALL SELECT '{c}', 1, {c} FROM synth")
    if on_counts:
        share = lambda n, t: f"({n} + 1e-10) / ({t} + k * 1e-10)"
        inner, value = "0", "least(1.0, greatest(0.0, js))"
    else:
        share = lambda n, t: f"({n} / {t} + 1e-10) / (1 + k * 1e-10)"
        inner, value = "1e-10", "js"
    return f"""tl AS ({long}), tc AS (SELECT "column", v, count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1 FROM tl GROUP BY 1, 2),
tt AS (SELECT *, sum(n0) OVER w AS t0, sum(n1) OVER w AS t1, count(*) OVER w AS k FROM tc WINDOW w AS (PARTITION BY "column")),
tp AS (SELECT "column", {share('n0', 't0')} AS p, {share('n1', 't1')} AS q FROM tt),
tjs0 AS (SELECT "column", 0.5 * sum(p * ln(p / (0.5 * (p + q)) + {inner})) + 0.5 * sum(q * ln(q / (0.5 * (p + q)) + {inner})) AS js FROM tp GROUP BY 1),
tjs AS (SELECT "column", {value} AS js FROM tjs0)"""


@query("js_numeric", f"{PAIR_SQL}, {numeric_js_sql(NUMBERS, 0, True)} SELECT \"column\", round(js, 6) + 0.0 AS js FROM njs")
def _(spark, folder):
    return digits(C.js_numeric(*pair(spark, folder)), 6, "js")


@query("js_categorical", f"{PAIR_SQL}, {text_js_sql(TEXTS, True)} SELECT \"column\", round(js, 6) + 0.0 AS js FROM tjs")
def _(spark, folder):
    return digits(C.js_categorical(*pair(spark, folder)), 6, "js")


DRIFT_SQL = f"""{PAIR_SQL}, {numeric_js_sql(NUMBERS, 1e-10, False)}, {text_js_sql(TEXTS, False)},
drift AS (SELECT "column", 'numeric' AS kind, round(js, 4) + 0.0 AS drift FROM njs UNION ALL SELECT "column", 'categorical', round(js, 4) + 0.0 FROM tjs)"""


@query("column_drift", DRIFT_SQL + " SELECT * FROM drift")
def _(spark, folder):
    return C.column_drift(*pair(spark, folder))


@query(
    "drift_summary",
    DRIFT_SQL + """ SELECT round(avg(drift), 6) AS avg_drift, max(drift) AS max_drift,
  CASE WHEN avg(drift) < 0.05 THEN 'low' WHEN avg(drift) < 0.15 THEN 'moderate' ELSE 'high' END AS level FROM drift""",
)
def _(spark, folder):
    return digits(C.drift_summary(C.column_drift(*pair(spark, folder))), 6, "avg_drift")


def ks_sql(columns):
    long = union_sql(columns, "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v, 1 AS a, 0 AS b FROM orig UNION ALL SELECT '{c}', CAST({c} AS DOUBLE), 0, 1 FROM synth")
    return f"""kl AS ({long}), kc AS (SELECT "column", v, sum(a) AS a, sum(b) AS b FROM kl GROUP BY 1, 2),
kr AS (SELECT "column", sum(a) OVER w / sum(a) OVER (PARTITION BY "column") AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY "column") AS fb
  FROM kc WINDOW w AS (PARTITION BY "column" ORDER BY v)), ks AS (SELECT "column", max(abs(fa - fb)) AS ks FROM kr GROUP BY 1)"""


@query("ks_statistic", f"{PAIR_SQL}, {ks_sql(NUMBERS)} SELECT \"column\", round(ks, 6) AS ks FROM ks")
def _(spark, folder):
    return digits(C.ks_statistic(*pair(spark, folder)), 6, "ks")


GAP_SQL = f"""gl AS ({union_sql(TEXTS, "SELECT '{c}' AS \"column\", {c} AS v, 1 AS a, 0 AS b FROM orig UNION ALL SELECT '{c}', {c}, 0, 1 FROM synth")}),
gc AS (SELECT "column", v, sum(a) AS a, sum(b) AS b FROM gl GROUP BY 1, 2),
gg AS (SELECT "column", abs(a / sum(a) OVER (PARTITION BY "column") - b / (SELECT count(*) FROM synth)) AS gap, a FROM gc),
gap AS (SELECT "column", max(gap) AS gap FROM gg WHERE a > 0 GROUP BY 1)"""
FIDELITY_SQL = f"""{PAIR_SQL}, {ks_sql(NUMBERS)}, {GAP_SQL}, fid AS (SELECT "column", 'numeric' AS kind, ks AS gap FROM ks UNION ALL SELECT "column", 'categorical', gap FROM gap)"""


@query("category_max_gap", f'{PAIR_SQL}, {GAP_SQL} SELECT "column", round(gap, 6) AS gap FROM gap')
def _(spark, folder):
    return digits(C.category_max_gap(*pair(spark, folder)), 6, "gap")


@query(
    "fidelity",
    FIDELITY_SQL + """ SELECT "column", kind, round(gap, 6) AS gap, CASE WHEN gap < 0.05 THEN 'PASS' WHEN gap < 0.15 THEN 'WARN' ELSE 'FAIL' END AS label FROM fid""",
)
def _(spark, folder):
    return digits(C.fidelity(*pair(spark, folder)), 6, "gap")


@query(
    "fidelity_pct",
    FIDELITY_SQL + " SELECT count(*) AS columns, round(avg(gap), 6) AS avg_gap, round((1 - least(1.0, avg(gap) * 2)) * 100, 0) AS fidelity_pct FROM fid",
)
def _(spark, folder):
    return digits(C.fidelity_pct(C.fidelity(*pair(spark, folder))), 6, "avg_gap")


RANGE_SQL = "rg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < (SELECT min({c}) FROM orig) OR {c} > (SELECT max({c}) FROM orig)) AS n_oob, count({c}) AS t FROM synth" for c in NUMBERS
) + '), ra AS (SELECT "column", n_oob, round(n_oob / greatest(t, 1), 4) AS oob_rate, n_oob / greatest(t, 1) < 0.01 AS passed FROM rg)'
CATEGORY_SQL = "cg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} NOT IN (SELECT {c} FROM orig)) AS n_invented, count({c}) AS t FROM synth" for c in TEXTS
) + '), ca AS (SELECT "column", n_invented, round(n_invented / greatest(t, 1), 4) AS inv_rate, n_invented = 0 AS passed FROM cg)'


@query("range_adherence", f"{PAIR_SQL}, {RANGE_SQL} SELECT * FROM ra")
def _(spark, folder):
    o, s = pair(spark, folder)
    return C.range_adherence(P.constraints(o), s)


@query("category_adherence", f"{PAIR_SQL}, {CATEGORY_SQL} SELECT * FROM ca")
def _(spark, folder):
    o, s = pair(spark, folder)
    return C.category_adherence(P.constraints(o), s)


@query(
    "tstr_r2",
    PAIR_SQL
    + """, f AS (SELECT count(*) AS n, avg(o_orderkey) AS ma, avg(o_custkey) AS mb, avg(o_totalprice) AS my, stddev_pop(o_orderkey) AS sa, stddev_pop(o_custkey) AS sb,
  covar_pop(o_orderkey, o_custkey) AS cab, covar_pop(o_orderkey, o_totalprice) AS cay, covar_pop(o_custkey, o_totalprice) AS cby FROM synth),
g AS (SELECT *, n + 1.0 AS d, n * cab / (sa * sb) AS o, n * cay / sa AS ra, n * cby / sb AS rb FROM f),
w AS (SELECT *, (d * ra - o * rb) / (d * d - o * o) / sa AS wa, (d * rb - o * ra) / (d * d - o * o) / sb AS wb FROM g)
SELECT 'o_totalprice' AS target, round(1 - sum(pow(o_totalprice - (my + wa * (o_orderkey - ma) + wb * (o_custkey - mb)), 2)) / (var_pop(o_totalprice) * count(*)), 6) + 0.0 AS r2 FROM orig, w""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return digits(C.tstr_r2(o, s, "o_totalprice"), 6, "r2")


COPY_SQL = """cp AS (SELECT count(*) FILTER (EXISTS (SELECT 1 FROM orig o WHERE s.o_orderkey = o.o_orderkey AND s.o_custkey = o.o_custkey AND round(s.o_totalprice, 4) = round(o.o_totalprice, 4)
  AND s.o_orderstatus = o.o_orderstatus AND s.o_orderpriority = o.o_orderpriority)) / count(*) AS rate FROM synth s)"""


@query(
    "evaluation_verdict",
    f"""{PAIR_SQL}, {numeric_js_sql(NUMBERS, 0, True)}, {text_js_sql(TEXTS, True)}, {RANGE_SQL}, {CATEGORY_SQL}, {COPY_SQL},
v AS (SELECT round(rate, 6) AS rate, (SELECT count(*) FROM njs WHERE js >= 0.25) + (SELECT count(*) FROM tjs WHERE js >= 0.20) AS js_fails,
  (SELECT count(*) FROM ra WHERE NOT passed) AS range_fails, (SELECT count(*) FROM ca WHERE NOT passed) AS invented FROM cp),
w AS (SELECT *, CAST(range_fails + CASE WHEN rate > 0.1 THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM v)
SELECT *, CASE WHEN invented > 0 OR rate > 0.4 THEN 'FAIL' WHEN js_fails > 0 OR range_fails > 0 OR warnings > 3 THEN 'WARN' ELSE 'PASS' END AS verdict FROM w""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    limits = P.constraints(o)
    js = C.js_numeric(o, s).withColumn("kind", F.lit("numeric")).unionByName(C.js_categorical(o, s).withColumn("kind", F.lit("categorical")))
    out = C.evaluation_verdict(js, C.range_adherence(limits, s), C.category_adherence(limits, s), C.exact_copy_rate(o, s))
    return digits(out, 6, "rate")


def corr_gap_sql():
    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    terms = " + ".join(f"abs((SELECT corr({a}, {b}) FROM orig) - (SELECT corr({a}, {b}) FROM synth))" for a, b in pairs)
    return f"2 * ({terms}) / 9"


@query("correlation_gap", f"{PAIR_SQL} SELECT round({corr_gap_sql()}, 6) AS gap")
def _(spark, folder):
    return digits(C.correlation_gap(*pair(spark, folder)), 6, "gap")


@query(
    "unique_rows",
    "SELECT (SELECT count(*) FROM lineitem) AS rows, count(*) AS distinct_rows, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS ratio "
    "FROM (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem)",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return digits(C.unique_row_ratio(df), 6, "ratio")


@query(
    "overfitting",
    f"""{PAIR_SQL}, {numeric_js_sql(NUMBERS, 0, True)}, s AS (SELECT avg(js) AS avg_js, max(js) AS max_js, {corr_gap_sql()} AS corr_gap,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM synth)) / (SELECT count(*) FROM synth) AS unique_ratio FROM njs),
t AS (SELECT *, (avg_js / 0.3 + corr_gap / 0.4 + greatest(0.0, (0.01 - unique_ratio) / 0.01)) / 3 AS score FROM s)
SELECT round(avg_js, 6) AS avg_js, round(max_js, 6) AS max_js, round(corr_gap, 6) AS corr_gap, round(unique_ratio, 6) AS unique_ratio, round(score, 6) AS score,
  max_js > 0.3 OR corr_gap > 0.4 OR unique_ratio < 0.01 OR score > 0.6 AS failed FROM t""",
)
def _(spark, folder):
    out = C.overfitting_score(*pair(spark, folder))
    return digits(out, 6, "avg_js", "max_js", "corr_gap", "unique_ratio", "score")


EVENT_MIX = """mix AS (SELECT event_id, user_id, value, event_type, CASE WHEN event_id % 2000 = 1 THEN 'rare' ELSE 'usual' END AS lopsided,
  CASE WHEN event_id % 2500 = 1 THEN 5.0 ELSE 1.0 END AS flat_number FROM events)"""


def event_mix(spark, folder):
    key = F.col("event_id")
    return table(spark, folder, "events").select(
        "event_id", "user_id", "value", "event_type",
        F.when(key % 2000 == 1, "rare").otherwise("usual").alias("lopsided"),
        F.when(key % 2500 == 1, 5.0).otherwise(1.0).alias("flat_number"),
    )


@query(
    "entropy_diversity",
    f"""WITH {EVENT_MIX}, n AS ({union_sql(['event_id', 'user_id', 'value', 'flat_number'], "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM mix")}),
e AS (SELECT "column", min(v) AS lo, max(v) AS hi, least(20, count(DISTINCT v)) AS b FROM n GROUP BY 1),
c AS (SELECT "column", CAST(least(floor((v - lo) / (hi - lo) * b), b - 1) AS VARCHAR) AS cell, count(*) AS n FROM n JOIN e USING ("column") GROUP BY 1, 2
  UNION ALL SELECT 'event_type', event_type, count(*) FROM mix GROUP BY 2 UNION ALL SELECT 'lopsided', lopsided, count(*) FROM mix GROUP BY 2),
p AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM c),
h AS (SELECT "column", -sum(p * log2(p + 1e-12)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END AS entropy FROM p GROUP BY 1)
SELECT "column", round(entropy, 6) AS entropy, entropy < 0.05 AS collapsed FROM h""",
)
def _(spark, folder):
    return digits(C.entropy_diversity(event_mix(spark, folder)), 6, "entropy")


@query(
    "entropy_vs_baseline",
    f"""WITH {EVENT_MIX}, q AS (SELECT 'value' AS "column", quantile_cont(value, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q, max(value) - min(value) AS span, stddev_samp(value) AS std FROM mix
  UNION ALL SELECT 'flat_number', quantile_cont(flat_number, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), max(flat_number) - min(flat_number), stddev_samp(flat_number) FROM mix),
w AS (SELECT "column", [q[i + 1] - q[i] for i in range(1, 7) if q[i + 1] - q[i] > 0] AS w, span, std FROM q
  UNION ALL SELECT 'event_type', list(n), 0, 0 FROM (SELECT count(*) AS n FROM mix GROUP BY event_type)
  UNION ALL SELECT 'lopsided', list(n), 0, 0 FROM (SELECT count(*) AS n FROM mix GROUP BY lopsided))
SELECT "column", round(CASE WHEN len(w) >= 2 THEN -list_sum([x / list_sum(w) * log2(x / list_sum(w) + 1e-12) for x in w]) / log2(len(w))
  WHEN span > 0 AND std / span >= 0.01 THEN 0.5 END, 6) AS entropy FROM w""",
)
def _(spark, folder):
    df = event_mix(spark, folder)
    profile = P.profile_numeric(df, ["value", "flat_number"])
    return digits(C.baseline_entropy(profile, P.top_values(df, ["event_type", "lopsided"])), 6, "entropy")


@query(
    "origin_purity",
    PAIR_SQL + " SELECT (SELECT count(*) FROM orig) + count(*) AS rows, count(*) AS generated, round(count(*) / ((SELECT count(*) FROM orig) + count(*)), 4) AS contamination_rate, false AS pure FROM synth",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return C.origin_purity(o.unionByName(C.tag_origin(s), allowMissingColumns=True))


# ---- nearest rows

SCALES = "sc AS (SELECT stddev_pop(o_custkey) AS sc, stddev_pop(o_totalprice) AS sp FROM orig)"
DISTANCE = "sqrt(pow((a.o_custkey - b.o_custkey) / sc, 2) + pow((a.o_totalprice - b.o_totalprice) / sp, 2))"
NEAR_COLUMNS = ["o_custkey", "o_totalprice"]


@query(
    "nearest_record",
    f"""{PAIR_SQL}, {SCALES}, d AS (SELECT a.o_orderkey, min({DISTANCE}) AS d FROM synth a, orig b, sc GROUP BY 1),
s AS (SELECT count(*) AS probes, count(*) FILTER (d < 0.01) AS close FROM d)
SELECT probes, close, close / probes AS rate, close / probes > 0.1 AS vulnerable, CASE WHEN close / probes > 0.3 THEN 'critical' WHEN close / probes > 0.1 THEN 'high' ELSE 'low' END AS severity FROM s""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return R.nearest_record_rate(o, s, NEAR_COLUMNS, "o_orderkey", "o_orderkey", threshold=0.01)


def close_sql(threshold: float) -> str:
    return f"""{PAIR_SQL}, {SCALES}, c AS (SELECT count(DISTINCT a.o_orderkey) AS close FROM synth a, orig b, sc
  WHERE b.o_custkey BETWEEN a.o_custkey - {threshold} * sc AND a.o_custkey + {threshold} * sc AND {DISTANCE} < {threshold}),
s AS (SELECT (SELECT count(*) FROM synth) AS probes, close FROM c)
SELECT probes, close, close / probes AS rate, close / probes > 0.1 AS vulnerable, CASE WHEN close / probes > 0.3 THEN 'critical' WHEN close / probes > 0.1 THEN 'high' ELSE 'low' END AS severity FROM s"""


@query("close_records", close_sql(0.01))
def _(spark, folder):
    o, s = pair(spark, folder)
    return R.close_record_rate(o, s, NEAR_COLUMNS, threshold=0.01)


MEMBERS = f"""{PAIR_SQL}, {SCALES}, mem AS (SELECT a.o_orderkey, min({DISTANCE}) AS d FROM orig a, orig b, sc WHERE a.o_orderkey <> b.o_orderkey GROUP BY 1),
oth AS (SELECT a.o_orderkey, min({DISTANCE}) AS d FROM synth a, orig b, sc GROUP BY 1), lim AS (SELECT median(d) AS t FROM mem)"""


@query(
    "membership_proximity",
    MEMBERS
    + """, s AS (SELECT (SELECT t FROM lim) AS t, count(*) FILTER (d > (SELECT t FROM lim)) / count(*) AS above FROM oth)
SELECT round(t, 6) AS threshold, above, greatest(0.0, least(1.0, 0.5 + 0.5 * (above - 0.5))) AS score FROM s""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return digits(R.membership_proximity(o, s, NEAR_COLUMNS, "o_orderkey", "o_orderkey"), 6, "threshold")


@query(
    "membership_accuracy",
    MEMBERS
    + """, s AS (SELECT (SELECT t FROM lim) AS t, ((SELECT avg(CAST(d <= (SELECT t FROM lim) AS INT)) FROM mem) + (SELECT avg(CAST(d > (SELECT t FROM lim) AS INT)) FROM oth)) / 2 AS a)
SELECT round(t, 6) AS threshold, round(a, 6) AS accuracy, a > 0.65 AS vulnerable, CASE WHEN a > 0.8 THEN 'critical' WHEN a > 0.65 THEN 'high' ELSE 'low' END AS severity FROM s""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return digits(R.membership_accuracy(o, s, NEAR_COLUMNS, "o_orderkey", "o_orderkey"), 6, "threshold", "accuracy")


@query(
    "attribute_inference",
    f"""{PAIR_SQL}, sc AS (SELECT stddev_pop(o_custkey) AS sc, stddev_pop(o_totalprice) AS sp FROM synth),
d AS (SELECT a.o_orderkey, any_value(a.o_orderstatus) AS truth, arg_min(b.o_orderstatus, (round({DISTANCE}, 12), b.o_orderkey)) AS label FROM orig a, synth b, sc GROUP BY 1),
s AS (SELECT count(*) AS probes, count(*) FILTER (truth = label) AS correct, 1.0 / (SELECT count(DISTINCT o_orderstatus) FROM orig) AS baseline FROM d)
SELECT probes, correct, round(baseline, 6) AS baseline, round(correct / probes, 6) AS accuracy, correct / probes > baseline * 2 AS vulnerable,
  CASE WHEN correct / probes > 0.7 THEN 'high' WHEN correct / probes > baseline * 2 THEN 'medium' ELSE 'low' END AS severity FROM s""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    out = R.attribute_inference(o, s, "o_orderstatus", NEAR_COLUMNS, "o_orderkey", "o_orderkey")
    return digits(out, 6, "baseline", "accuracy")


INVERSION_SQL = """, f AS (SELECT avg(o_orderkey) AS ma, avg(o_custkey) AS mb, avg(o_totalprice) AS my, var_pop(o_orderkey) AS va, var_pop(o_custkey) AS vb,
  covar_pop(o_orderkey, o_custkey) AS cab, covar_pop(o_orderkey, o_totalprice) AS cay, covar_pop(o_custkey, o_totalprice) AS cby FROM synth),
w AS (SELECT *, (vb * cay - cab * cby) / (va * vb - cab * cab) AS wa, (va * cby - cab * cay) / (va * vb - cab * cab) AS wb FROM f),
r AS (SELECT greatest(0.0, least(1.0, 1 - sum(pow(o_totalprice - (my + wa * (o_orderkey - ma) + wb * (o_custkey - mb)), 2)) / (var_pop(o_totalprice) * count(*)))) AS r2 FROM orig, w)"""


@query(
    "inversion_r2",
    PAIR_SQL + INVERSION_SQL + " SELECT 'o_totalprice' AS target, round(r2, 6) + 0.0 AS r2, r2 > 0.5 AS vulnerable, CASE WHEN r2 > 0.7 THEN 'high' WHEN r2 > 0.5 THEN 'medium' ELSE 'low' END AS severity FROM r",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return digits(R.linear_inversion_r2(o, s, ["o_orderkey", "o_custkey"], "o_totalprice"), 6, "r2")


CUT = "(" + " + ".join(f"CASE WHEN o_totalprice > lo + {b} * (hi - lo) / 10 THEN 1 ELSE 0 END" for b in range(1, 10)) + ")"
K_SQL = f"""kb AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM synth),
kg AS (SELECT o_orderstatus, o_orderpriority, {CUT} AS b, count(*) AS n FROM synth, kb GROUP BY ALL),
kk AS (SELECT min(n) AS min_k, avg(n) AS mean_k, count(*) FILTER (n = 1) AS unique_groups, count(*) AS total_groups FROM kg)"""


@query(
    "k_anonymity",
    f"""{PAIR_SQL}, {K_SQL} SELECT min_k, round(mean_k, 4) AS mean_k, unique_groups, total_groups, round(unique_groups / total_groups, 6) AS unique_share,
  min_k < 3 AS vulnerable, CASE WHEN min_k = 1 THEN 'critical' WHEN min_k < 3 THEN 'high' WHEN min_k < 5 THEN 'medium' ELSE 'low' END AS severity FROM kk""",
)
def _(spark, folder):
    out = R.k_anonymity(orders_release(spark, folder), TEXTS, ["o_totalprice"])
    return digits(digits(out, 4, "mean_k"), 6, "unique_share")


def audit_sql(*names: tuple[str, str]) -> str:
    """The summary of the verdicts of the named queries, from their own SQL, with the advice for each."""
    sql = {**ORACLES, "close": close_sql(0.5)}
    rows = " UNION ALL ".join(f"SELECT '{tip}' AS tip, vulnerable FROM ({sql[name]})" for name, tip in names)
    return f"""WITH verdicts AS ({rows}), s AS (SELECT count(*) AS run, count(*) FILTER (vulnerable) AS succeeded,
  coalesce(array_to_string(list_sort(list(DISTINCT tip) FILTER (vulnerable AND tip <> '')), ' '), '') AS recommendations FROM verdicts)
SELECT run, succeeded, recommendations, CASE WHEN succeeded = 0 THEN 'safe' WHEN succeeded <= 1 THEN 'moderate' WHEN succeeded <= 3 THEN 'vulnerable' ELSE 'critical' END AS vulnerability,
  CASE WHEN succeeded = 0 THEN 10.0 WHEN succeeded <= 1 THEN 40.0 WHEN succeeded <= 3 THEN 70.0 ELSE 90.0 END::DOUBLE AS risk_score FROM s"""


@query(
    "privacy_audit",
    audit_sql(
        ("membership_accuracy", "Add differential privacy noise to reduce membership inference risk."),
        ("inversion_r2", "Add feature perturbation to prevent attribute reconstruction."),
        ("close", "Increase synthetic data diversity; reduce exact-row similarity."),
        ("attribute_inference", ""),
        ("k_anonymity", "Ensure quasi-identifiers have k>=5 equivalence classes."),
    ),
)
def _(spark, folder):
    o, s = pair(spark, folder)
    key = "o_orderkey"
    parts = [
        ("Membership Inference", R.membership_accuracy(o, s, NEAR_COLUMNS, key, key)),
        ("Model Inversion", R.linear_inversion_r2(o, s, [key, "o_custkey"], "o_totalprice")),
        ("Data Reconstruction", R.close_record_rate(o, s, NEAR_COLUMNS)),
        ("Attribute Inference", R.attribute_inference(o, s, "o_orderstatus", NEAR_COLUMNS, key, key)),
        ("k-Anonymity Check", R.k_anonymity(s, TEXTS, ["o_totalprice"])),
    ]
    rows = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("name"), "vulnerable", "severity")
        rows = row if rows is None else rows.unionByName(row)
    return R.audit_summary(rows)


REID_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
REID_SQL = f"""rl AS ({union_sql(REID_COLUMNS, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM orig")}),
rc AS (SELECT "column", v, count(*) AS n FROM rl WHERE v IS NOT NULL GROUP BY 1, 2),
rp AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM rc),
reid AS (SELECT "column", round(least(1.0, 0.6 * count(*) / (SELECT count(*) FROM orig) + 0.4 * -sum(p * log2(p + 1e-10)) / log2(count(*) + 1)), 4) AS risk FROM rp GROUP BY 1)"""


@query("reid_risk", f"{PAIR_SQL}, {REID_SQL} SELECT * FROM reid")
def _(spark, folder):
    return R.reidentification_risk(orders_original(spark, folder))


SEVERITIES = [("o_orderkey", "critical"), ("o_custkey", "high"), ("o_custkey", "medium"), ("o_orderpriority", "low")]
SEVERITY_SQL = "pf(\"column\", severity) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SEVERITIES) + ")"
RANK_SQL = f"""{DRIFT_SQL}, {REID_SQL}, {SEVERITY_SQL},
ps AS (SELECT "column", max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END) AS pii FROM pf GROUP BY 1),
cr AS (SELECT 'o_orderkey' AS "column", greatest(abs(corr(o_orderkey, o_custkey)), abs(corr(o_orderkey, o_totalprice))) AS corr FROM orig
  UNION ALL SELECT 'o_custkey', greatest(abs(corr(o_orderkey, o_custkey)), abs(corr(o_custkey, o_totalprice))) FROM orig
  UNION ALL SELECT 'o_totalprice', greatest(abs(corr(o_orderkey, o_totalprice)), abs(corr(o_custkey, o_totalprice))) FROM orig),
ranked AS (SELECT "column", coalesce(pii, 0) AS pii_score, risk AS reid, coalesce(drift, 0) / greatest((SELECT max(drift) FROM drift), 0.001) AS drift, coalesce(corr, 0) AS corr
  FROM reid LEFT JOIN ps USING ("column") LEFT JOIN drift USING ("column") LEFT JOIN cr USING ("column")),
rank AS (SELECT "column", round(0.4 * pii_score + 0.3 * reid + 0.2 * drift + 0.1 * corr, 4) AS score, round(pii_score, 4) AS pii_score, round(reid, 4) AS reid, round(drift, 4) AS drift, round(corr, 4) AS corr FROM ranked)"""


def ranking(spark, folder):
    o, s = pair(spark, folder)
    pii = spark.createDataFrame(SEVERITIES, "column string, severity string")
    return R.rank_sensitive(o, pii, C.column_drift(o, s).select("column", "drift"))


@query("rank_sensitive", RANK_SQL + " SELECT * FROM rank")
def _(spark, folder):
    return digits(ranking(spark, folder), 4, "score", "pii_score", "reid", "drift", "corr")


SPIKE_SQL = """spikes AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5000 = 7 THEN o_totalprice * 1000 WHEN o_orderkey % 5000 = 9 THEN -8 * o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders)"""


def order_spikes(spark, folder):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    spiked = F.when(key % 5000 == 7, price * 1000).when(key % 5000 == 9, -8 * price).otherwise(price)
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", spiked.alias("o_totalprice"))


OUTLIER_SQL = f"""ol AS ({union_sql(['o_orderkey', 'o_custkey', 'o_totalprice'], "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM spikes")}),
oq AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM ol GROUP BY 1),
oo AS (SELECT "column", CASE WHEN v > q3 + 3 * (q3 - q1) THEN 'high' ELSE 'low' END AS direction, v, abs(v - CASE WHEN v > q3 + 3 * (q3 - q1) THEN q3 ELSE q1 END) / (q3 - q1) AS r,
  CASE WHEN v > q3 + 3 * (q3 - q1) THEN q3 + 3 * (q3 - q1) ELSE q1 - 3 * (q3 - q1) END AS fence FROM ol JOIN oq USING ("column") WHERE v > q3 + 3 * (q3 - q1) OR v < q1 - 3 * (q3 - q1)),
outl AS (SELECT "column", direction, arg_max(v, r) AS value, max(r) AS extreme_ratio, any_value(fence) AS fence,
  CASE WHEN max(r) > 20 THEN 'critical' WHEN max(r) > 5 THEN 'high' ELSE 'medium' END AS severity FROM oo GROUP BY 1, 2)"""


@query("outlier_exposure", f"WITH {SPIKE_SQL}, {OUTLIER_SQL} SELECT \"column\", direction, round(value, 4) AS value, round(extreme_ratio, 4) AS extreme_ratio, round(fence, 4) AS fence, severity FROM outl")
def _(spark, folder):
    return digits(R.outlier_exposure(order_spikes(spark, folder)), 4, "value", "extreme_ratio", "fence")


# ---- run metrics

SCORED_SQL = f"""WITH {RUNS_SQL}, scored AS (SELECT *, round(0.4 * greatest(0.0, 1 - 2 * abs(membership_inference_auc - 0.5)) + 0.35 * greatest(0.0, 1 - duplicates_rate * 20)
  + 0.25 * greatest(0.0, 1 - avg_drift * 4), 4) AS privacy_score, avg_drift AS statistical_drift_score FROM runs),
risky AS (SELECT *, round(greatest(0.0, least(100.0, (1 - privacy_score) * 40 + membership_inference_auc * 30 + duplicates_rate * 20 + avg_drift * 10)), 2) AS dataset_risk_score FROM scored)"""


def scored_runs(spark, folder):
    runs = order_runs(spark, folder)
    auc, dup, drift = F.col("membership_inference_auc"), F.col("duplicates_rate"), F.col("avg_drift")
    scored = runs.withColumn("privacy_score", M.privacy_score(auc, dup, drift)).withColumn("statistical_drift_score", drift)
    return scored.withColumn("dataset_risk_score", M.dataset_risk_score(F.col("privacy_score"), auc, dup, drift))


@query(
    "privacy_score",
    SCORED_SQL + " SELECT run_id, privacy_score, CASE WHEN privacy_score >= 0.75 THEN 'low' WHEN privacy_score >= 0.5 THEN 'warning' ELSE 'critical' END AS level FROM risky",
)
def _(spark, folder):
    return scored_runs(spark, folder).select("run_id", "privacy_score", M.privacy_level(F.col("privacy_score")).alias("level"))


@query(
    "privacy_components",
    SCORED_SQL
    + """ SELECT run_id, round(duplicates_rate, 4) AS duplicates_risk, round(greatest(0.0, membership_inference_auc - 0.5) * 2, 4) AS mi_attack_risk,
  round(greatest(0.0, 0.5 - membership_inference_auc) * 2, 4) AS distance_similarity_risk, round(avg_drift, 4) AS distribution_drift_risk,
  round(greatest(0.0, least(1.0, 2 * (membership_inference_auc - 0.5))), 4) AS membership_attack_success, round(greatest(0.0, 0.5 - membership_inference_auc) * 2, 4) AS reconstruction_risk,
  round(1 - least(avg_drift * 5, 1.0), 4) AS nearest_neighbor_leakage FROM risky""",
)
def _(spark, folder):
    auc, dup, drift = F.col("membership_inference_auc"), F.col("duplicates_rate"), F.col("avg_drift")
    cols = {**M.privacy_components(auc, dup, drift), **M.attack_indicators(auc, drift)}
    return scored_runs(spark, folder).select("run_id", *[(c + F.lit(0.0)).alias(n) for n, c in cols.items()])


@query("dataset_risk", SCORED_SQL + " SELECT run_id, dataset_risk_score FROM risky")
def _(spark, folder):
    return scored_runs(spark, folder).select("run_id", "dataset_risk_score")


@query(
    "reliability",
    SCORED_SQL + " SELECT run_id, n_rows, CAST(CASE WHEN n_rows >= 500 THEN 1.0 WHEN n_rows >= 100 THEN 0.85 WHEN n_rows >= 30 THEN 0.65 WHEN n_rows >= 10 THEN 0.4 ELSE 0.15 END AS DOUBLE) AS reliability FROM risky",
)
def _(spark, folder):
    return scored_runs(spark, folder).select("run_id", "n_rows", M.reliability_score(F.col("n_rows")).alias("reliability"))


@query(
    "threats",
    SCORED_SQL
    + """ SELECT run_id, 'Exact Row Duplication' AS name, CASE WHEN duplicates_rate > 0.05 THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, duplicates_rate * 10), 2) AS confidence FROM risky WHERE duplicates_rate > 0.01
UNION ALL SELECT run_id, 'Membership Inference Risk', CASE WHEN membership_inference_auc > 0.75 THEN 'high' ELSE 'medium' END, round(least(1.0, (membership_inference_auc - 0.5) * 2), 2) FROM risky WHERE membership_inference_auc > 0.6
UNION ALL SELECT run_id, 'High Statistical Drift', 'medium', 0.7 FROM risky WHERE avg_drift >= 0.15
UNION ALL SELECT run_id, 'High Distance Similarity (Reconstruction Risk)', 'high', round(least(1.0, (0.5 - membership_inference_auc) * 4), 2) FROM risky WHERE membership_inference_auc < 0.45""",
)
def _(spark, folder):
    return M.threats(scored_runs(spark, folder)).drop("property")


INTEL_SQL = f"""{SCORED_SQL}, parts AS (SELECT run_id, 0.3 * (dataset_risk_score / 100) AS a, 0.25 * max_reid AS b, 0.2 * pii_density AS c, 0.15 * least(1.0, avg_drift) AS d,
  0.1 * (1 - CASE WHEN privacy_score = 0 THEN 0.5 ELSE privacy_score END) AS e FROM risky),
intel AS (SELECT *, round(least(100.0, (a + b + c + d + e) * 100), 2) AS score FROM parts)"""


@query(
    "intelligence_risk",
    INTEL_SQL + """ SELECT run_id, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MODERATE' ELSE 'LOW' END AS label,
  round(a * 100, 2) AS dataset_risk_part, round(b * 100, 2) AS reidentification_part, round(c * 100, 2) AS pii_density_part, round(d * 100, 2) AS outlier_part, round(e * 100, 2) AS privacy_part FROM intel""",
)
def _(spark, folder):
    cols = M.intelligence_risk(F.col("dataset_risk_score"), F.col("max_reid"), F.col("pii_density"), F.col("avg_drift"), F.col("privacy_score"))
    return scored_runs(spark, folder).select("run_id", *[c.alias(n) for n, c in cols.items()])


GATE_NAMES = ["privacy_score", "duplicates_rate", "statistical_drift_score", "membership_inference_auc", "dataset_risk_score", "acceptance_rate", "rejection_rate"]


@query(
    "metric_gate",
    SCORED_SQL
    + ", lim(name, lo, hi) AS (VALUES "
    + ", ".join(f"('{m}', {a}, {b})" for m, _, _, a, b in M.THRESHOLDS)
    + "), l AS ("
    + " UNION ALL ".join(f"SELECT run_id, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM risky" for c in GATE_NAMES)
    + """) SELECT run_id, name AS "check", round(value, 6) AS value, value BETWEEN lo AND hi AS passed FROM l JOIN lim USING (name)
UNION ALL SELECT run_id, 'HIGH_PRIVACY_WITH_HIGH_DUPLICATES', NULL, NOT (privacy_score > 0.85 AND duplicates_rate > 0.10) FROM risky
UNION ALL SELECT run_id, 'HIGH_PRIVACY_WITH_NEAR_ZERO_DRIFT', NULL, NOT (privacy_score > 0.92 AND statistical_drift_score < 0.02 AND duplicates_rate > 0.05) FROM risky
UNION ALL SELECT run_id, 'ZERO_ROWS_ACCEPTED', NULL, acceptance_rate <> 0 FROM risky
UNION ALL SELECT run_id, 'INVERTED_ACCEPTANCE_REJECTION', NULL, NOT (abs(acceptance_rate + rejection_rate - 1) > 0.01) FROM risky""",
)
def _(spark, folder):
    return digits(M.metric_gate(scored_runs(spark, folder), high_risk=True), 6, "value")


@query(
    "metric_catalog",
    SCORED_SQL
    + ", cat(metric, riskier) AS (VALUES "
    + ", ".join(f"('{m}', {str(r).lower()})" for m, _, _, r in M.CATALOG)
    + "), l AS ("
    + " UNION ALL ".join(f"SELECT run_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM risky" for c in GATE_NAMES)
    + ") SELECT run_id, metric, round(CASE WHEN riskier THEN value ELSE 1 - value END, 6) + 0.0 AS risk FROM l JOIN cat USING (metric)",
)
def _(spark, folder):
    long = M.melt_metrics(scored_runs(spark, folder), GATE_NAMES)
    return digits(M.riskier_is_higher(long).select("run_id", "metric", "risk"), 6, "risk")


LEAK_SQL = """, bad AS (SELECT run_id, [x for x in [CASE WHEN duplicates_rate > 0.1 THEN 'duplicates_rate' END, CASE WHEN privacy_score < 0.3 THEN 'privacy_score' END,
  CASE WHEN membership_inference_auc > 0.75 THEN 'membership_inference_auc' END] if x IS NOT NULL] AS b FROM risky)"""


@query("leakage_gate", SCORED_SQL + LEAK_SQL + " SELECT run_id, len(b) = 0 AS passed, array_to_string(b, ',') AS reasons FROM bad")
def _(spark, folder):
    return M.leakage_gate(scored_runs(spark, folder))


@query(
    "release_decision",
    SCORED_SQL
    + LEAK_SQL
    + """, c AS (SELECT run_id, m % 7 <> 0 AS a, abs(acceptance_rate + rejection_rate - 1) <= 0.01 AS b, m % 9 <> 0 AS c, n_rows >= 150 AS d, m <> 5 AS e, len(bad.b) = 0 AS leak,
  CASE m % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM risky JOIN bad USING (run_id)),
f AS (SELECT *, [x for x in [CASE WHEN NOT a THEN 'INVARIANTS_PASSED' END, CASE WHEN NOT b THEN 'METRICS_VALID' END, CASE WHEN NOT c THEN 'NO_CONTRADICTIONS' END,
  CASE WHEN NOT d THEN 'ROW_COUNT_MET' END, CASE WHEN NOT e THEN 'SEED_RECORDED' END] if x IS NOT NULL] AS failed FROM c),
g AS (SELECT *, CASE WHEN len(failed) > 0 THEN 'contract: ' || array_to_string(failed, ',') WHEN NOT leak THEN 'leakage' WHEN verdict = 'FAIL' THEN 'evaluation: FAIL' ELSE '' END AS reason FROM f)
SELECT run_id, CAST(6 - len(failed) AS INTEGER) AS clauses_met, reason = '' AS released, reason FROM g""",
)
def _(spark, folder):
    runs = scored_runs(spark, folder)
    gate = M.leakage_gate(runs).select("run_id", F.col("passed").alias("leakage_passed"))
    m = F.col("m")
    checks = runs.join(gate, "run_id").select(
        "run_id",
        (m % 7 != 0).alias("invariants_passed"),
        (F.abs(F.col("acceptance_rate") + F.col("rejection_rate") - 1) <= 0.01).alias("metrics_valid"),
        (m % 9 != 0).alias("no_contradictions"),
        F.col("n_rows").alias("rows"),
        F.lit(150).alias("min_rows"),
        F.when(m != 5, m).alias("seed"),
        F.md5("run_id").alias("config_hash"),
        "leakage_passed",
        F.when(m % 3 == 0, "PASS").when(m % 3 == 1, "WARN").otherwise("FAIL").alias("verdict"),
    )
    return M.release_decision(checks)


# ---- advice

ADVICE_PII = [("o_orderkey", "quasi_identifier"), ("o_custkey", "email"), ("o_custkey", "ssn"), ("o_totalprice", "other")]


@query(
    "recommend",
    f"""WITH orig AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders), {REID_SQL}, {SPIKE_SQL}, {OUTLIER_SQL},
worst AS (SELECT "column", arg_max(severity, extreme_ratio) AS s FROM outl GROUP BY 1)
SELECT DISTINCT recommendation FROM (
SELECT CASE WHEN risk > 0.8 THEN 'Hash or tokenize ''' || "column" || ''' - re-identification risk ' || CAST(round(risk * 100, 0) AS INTEGER) || '%'
  ELSE 'Consider pseudonymization for ''' || "column" || ''' (risk ' || CAST(round(risk * 100, 0) AS INTEGER) || '%)' END AS recommendation FROM reid WHERE risk > 0.6
UNION ALL SELECT unnest(['Apply dataset-level anonymization - PII density exceeds 50% of columns', 'Remove or mask direct identifiers before sharing or training'])
UNION ALL SELECT unnest(['Mask email addresses (retain domain only)', 'Remove SSN data - replace with anonymised ID', 'Apply k-anonymity to quasi-identifier columns'])
UNION ALL SELECT unnest(CASE WHEN s IN ('critical', 'high') THEN ['Clip or cap extreme values in ''' || "column" || ''' - ' || s || ' outlier exposure',
  'Consider noise injection (Laplace/Gaussian) for ''' || "column" || ''' before release'] ELSE ['Review outlier values in ''' || "column" || ''' before dataset sharing'] END) FROM worst)""",
)
def _(spark, folder):
    pii = spark.createDataFrame(ADVICE_PII, "column string, category string")
    density = F.lit(len({c for c, _ in ADVICE_PII}) / 5.0)
    return R.recommend(
        R.reidentification_risk(orders_original(spark, folder)), density, R.outlier_exposure(order_spikes(spark, folder)), pii
    )


ANOMALY_SQL = f"""{DRIFT_SQL}, {SPIKE_SQL}, {OUTLIER_SQL}, {HOLES_SQL},
prof AS (SELECT 'o_totalprice' AS "column", 'numeric' AS kind, avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio, (SELECT avg(o_totalprice) FROM spikes) AS mean, (SELECT stddev_samp(o_totalprice) FROM spikes) AS std FROM holes
  UNION ALL SELECT 'o_custkey', 'numeric', avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END), avg(o_custkey), stddev_samp(o_custkey) FROM holes
  UNION ALL SELECT 'o_orderstatus', 'categorical', avg(CASE WHEN o_orderstatus IS NULL THEN 1.0 ELSE 0.0 END), NULL, NULL FROM holes
  UNION ALL SELECT 'o_orderpriority', 'categorical', avg(CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0.0 END), NULL, NULL FROM holes),
anom AS (SELECT "column", 'Distribution drift' AS issue, CASE WHEN drift > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT "column", drift * 10 AS drift FROM drift) WHERE drift > 0.15
  UNION ALL SELECT "column", 'High missing rate', CASE WHEN null_ratio > 0.6 THEN 'high' ELSE 'medium' END FROM prof WHERE null_ratio > 0.3
  UNION ALL SELECT "column", 'High variance / skewed distribution', 'medium' FROM prof WHERE kind = 'numeric' AND mean <> 0 AND abs(std / mean) > 3
  UNION ALL SELECT "column", 'Outlier exposure risk', CASE WHEN severity IN ('critical', 'high') THEN 'high' ELSE 'medium' END FROM outl)"""


def anomaly_inputs(spark, folder):
    o, s = pair(spark, folder)
    holes, spikes = orders_holes(spark, folder), order_spikes(spark, folder)
    drift = C.column_drift(o, s).select("column", (F.col("drift") * 10).alias("drift"))
    light = P.profile_light(holes, ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"])
    spread = P.profile_light(spikes, ["o_totalprice"]).select("column", F.col("mean").alias("m2"), F.col("std").alias("s2"))
    profile = light.join(spread, "column", "left").select(
        "column",
        F.when(F.col("mean").isNull(), "categorical").otherwise("numeric").alias("kind"),
        F.col("missing_ratio").alias("null_ratio"),
        F.coalesce("m2", "mean").alias("mean"),
        F.coalesce("s2", "std").alias("std"),
    )
    return profile, drift, R.outlier_exposure(spikes)


@query("anomalies", ANOMALY_SQL + " SELECT * FROM anom")
def _(spark, folder):
    return R.anomaly_signals(*anomaly_inputs(spark, folder))


@query(
    "cleaning_actions",
    ANOMALY_SQL
    + f""", {REID_SQL} SELECT "column", CASE WHEN null_ratio > 0.6 THEN 'Consider dropping this column' WHEN kind = 'numeric' THEN 'Impute with median or model-based imputation' ELSE 'Impute with mode or Unknown category' END AS action,
  CASE WHEN null_ratio > 0.6 THEN 'high' ELSE 'medium' END AS priority FROM prof WHERE null_ratio > 0.3
UNION ALL SELECT "column", 'Apply log1p transform or IQR-based clipping', 'medium' FROM anom WHERE issue = 'High variance / skewed distribution'
UNION ALL SELECT "column", 'Clip to 99th percentile or add Laplace noise', 'high' FROM anom WHERE issue = 'Outlier exposure risk'
UNION ALL SELECT "column", CASE WHEN risk > 0.6 THEN 'Apply k-anonymity generalisation or replace with a surrogate' ELSE 'Mask with format-preserving pseudonymisation or remove' END,
  CASE WHEN risk > 0.6 THEN 'high' ELSE 'medium' END FROM reid WHERE "column" IN ('o_orderkey', 'o_custkey', 'o_totalprice')""",
)
def _(spark, folder):
    profile, drift, outliers = anomaly_inputs(spark, folder)
    pii = spark.createDataFrame(ADVICE_PII, "column string, category string")
    anomalies = R.anomaly_signals(profile, drift, outliers)
    return R.cleaning_actions(profile, anomalies, pii, R.reidentification_risk(orders_original(spark, folder)))


@query(
    "governance_actions",
    RANK_SQL
    + """ SELECT "column", 'Mask or tokenise' AS action, 'high' AS urgency FROM rank WHERE pii_score > 0.7
UNION SELECT "column", 'Apply k-anonymity or suppress', 'critical' FROM rank WHERE reid > 0.7""",
)
def _(spark, folder):
    return R.governance_actions(ranking(spark, folder))
