"""Validation, repair and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.curves import LEVELS
from veilwork.functions.draws import uniform_sql
from veilwork.functions.numeric import PROBS, rounded
from veilwork.operators import association as A
from veilwork.operators import conditional as C
from veilwork.operators import profile as P
from veilwork.operators import validate as V
from veilwork.plans.compare_queries import TEXTS, order_spikes, pair
from veilwork.plans.compare_queries import SPIKE_SQL
from veilwork.plans.fixtures import LINKED_NUMBERS, LINKED_SQL, PAIR_SQL, lineitem_linked, orders_original
from veilwork.plans.registry import query, table

PROB_LIST = "[" + ",".join(str(p) for p in PROBS) + "]::DOUBLE[]"
LEVEL_LIST = "([" + ",".join(str(p) for p in LEVELS) + "]::DOUBLE[])"


def knots_sql(column, source):
    return f"(SELECT list_concat(list_concat([CAST(min({column}) AS DOUBLE)], quantile_cont(CAST({column} AS DOUBLE), {PROB_LIST})), [CAST(max({column}) AS DOUBLE)]) FROM {source})"


def curve_sql(k, u):
    """Interpolation of the knots ``k`` at ``u`` (both column names)."""
    s = f"len([l for l in {PROB_LIST} if l <= {u}])"
    return f"{k}[{s} + 1] + ({k}[{s} + 2] - {k}[{s} + 1]) * ({u} - {LEVEL_LIST}[{s} + 1]) / ({LEVEL_LIST}[{s} + 2] - {LEVEL_LIST}[{s} + 1])"


def draw_sql(k, u, j):
    s = f"len([l for l in {PROB_LIST} if l <= {u}])"
    return f"greatest({k}[1], least({k}[17], {curve_sql(k, u)} + ({j} - 0.5) * ({k}[{s} + 2] - {k}[{s} + 1]) * 0.1))"


ORIG_LIMITS = "lim AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orig)"


@query(
    "repair_ranges",
    f"""{PAIR_SQL}, {ORIG_LIMITS}, c AS (SELECT {knots_sql('o_totalprice', 'orig')} AS k),
d AS (SELECT s.*, {uniform_sql('o_orderkey', 42, 'repair/o_totalprice')} AS u FROM synth s)
SELECT o_orderkey, round(CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN {curve_sql('k', 'u')} ELSE o_totalprice END, 4) AS o_totalprice FROM d, c, lim""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    out = V.repair_ranges(s, P.constraints(o), P.profile_numeric(o, ["o_totalprice"]), "o_orderkey")
    return out.select("o_orderkey", rounded(F.col("o_totalprice"), 4).alias("o_totalprice"))


@query(
    "repair_range_counts",
    f"{PAIR_SQL} SELECT 'o_totalprice' AS \"column\", count(*) FILTER (o_totalprice < (SELECT min(o_totalprice) FROM orig) OR o_totalprice > (SELECT max(o_totalprice) FROM orig)) AS repaired FROM synth "
    "UNION ALL SELECT 'o_orderkey', 0 UNION ALL SELECT 'o_custkey', 0",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    return V.count_out_of_range(s, P.constraints(o))


@query(
    "repair_categories",
    f"""{PAIR_SQL}, f AS (SELECT o_orderstatus AS v, count(*) / sum(count(*)) OVER () AS p FROM orig GROUP BY 1),
w AS (SELECT list(v ORDER BY v) AS vals, list(e ORDER BY v) AS ends FROM (SELECT v, sum(p) OVER (ORDER BY v) AS e FROM f)),
d AS (SELECT s.*, {uniform_sql('o_orderkey', 42, 'repair/o_orderstatus')} AS u FROM synth s)
SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN (SELECT v FROM f) THEN vals[least(len(vals), len([e for e in ends if e <= u]) + 1)] ELSE o_orderstatus END AS o_orderstatus FROM d, w""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    out = V.repair_categories(s, P.full_value_distribution(o, TEXTS), P.constraints(o), "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus")


@query(
    "complete_schema",
    f"""{PAIR_SQL}, c AS (SELECT {knots_sql('o_totalprice', 'orig')} AS k), d AS (SELECT *, {uniform_sql('o_orderkey', 42, 'fill/o_totalprice')} AS u FROM synth)
SELECT o_orderkey, o_custkey, round({curve_sql('k', 'u')}, 4) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus, o_orderpriority FROM d, c""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    part = s.drop("o_totalprice", "o_orderstatus").withColumn("extra", F.lit(1))
    out = V.complete_schema(part, o.columns, P.profile_numeric(o, ["o_totalprice"]), "o_orderkey")
    return out.withColumn("o_totalprice", rounded(F.col("o_totalprice"), 4))


IQR_SQL = "q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)"


@query(
    "iqr_rows",
    f"WITH {SPIKE_SQL}, {IQR_SQL} SELECT o_orderkey, o_totalprice < a - 3 * (b - a) OR o_totalprice > b + 3 * (b - a) AS iqr_outlier FROM spikes, q",
)
def _(spark, folder):
    df = order_spikes(spark, folder)
    profile = P.profile_numeric(orders_original(spark, folder), ["o_totalprice"])
    return df.select("o_orderkey", V.iqr_outlier_flag(df, profile).alias("iqr_outlier"))


BENT_SQL = f"""{LINKED_SQL}, bent AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 97 = 3 THEN 90000.0 - l_net ELSE l_net END AS l_net, ship_mode FROM linked)"""


def bent(spark, folder):
    df = lineitem_linked(spark, folder)
    return df.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 97 == 3, 90000.0 - F.col("l_net")).otherwise(F.col("l_net")).alias("l_net"), "ship_mode",
    )


MAHAL_SQL = """t AS (SELECT avg(l_extendedprice) AS ma, stddev_samp(l_extendedprice) AS sa, avg(l_net) AS mb, stddev_samp(l_net) AS sb, corr(l_extendedprice, l_net) AS r FROM linked),
z AS (SELECT bent.*, (l_extendedprice - ma) / sa AS za, (l_net - mb) / sb AS zb, r FROM bent, t),
j AS (SELECT *, (za * za - 2 * r * za * zb + zb * zb) / (1 - r * r) > 9.21 AS joint_outlier FROM z)"""


@query(
    "mahalanobis",
    f"WITH {BENT_SQL}, {MAHAL_SQL} SELECT joint_outlier, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM j GROUP BY 1",
)
def _(spark, folder):
    base, df = lineitem_linked(spark, folder), bent(spark, folder)
    names = ["l_extendedprice", "l_net"]
    flag = V.mahalanobis_flag(df, P.profile_numeric(base, names), A.pearson_pairs(base, names))
    return df.withColumn("joint_outlier", flag).groupBy("joint_outlier").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


CLASS_SQL = "cs AS (SELECT ship_mode, " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in LINKED_NUMBERS) + " FROM linked GROUP BY 1)"
CLASS_FLAG = " OR ".join(f"abs({c} - m_{c}) > 4 * s_{c}" for c in LINKED_NUMBERS)


@query(
    "class_zscore",
    f"WITH {BENT_SQL}, {CLASS_SQL} SELECT ship_mode, {CLASS_FLAG} AS class_outlier, count(*) AS n FROM (SELECT bent.* REPLACE (l_quantity * CASE WHEN l_orderkey % 1000 = 5 THEN 30 ELSE 1 END AS l_quantity) FROM bent) JOIN cs USING (ship_mode) GROUP BY 1, 2",
)
def _(spark, folder):
    stats = C.class_stats(lineitem_linked(spark, folder), "ship_mode", LINKED_NUMBERS)
    df = bent(spark, folder)
    df = df.withColumn("l_quantity", F.col("l_quantity") * F.when(F.col("l_orderkey") % 1000 == 5, 30).otherwise(1)).drop("l_orderkey")
    return V.class_zscore(df, "ship_mode", stats).groupBy("ship_mode", "class_outlier").agg(F.count("*").alias("n"))


IQR_ALL = "iq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in ["l_quantity", "l_extendedprice", "l_net"]) + " FROM linked)"
IQR_ANY = " OR ".join(f"{c} < a_{c} - 3 * (b_{c} - a_{c}) OR {c} > b_{c} + 3 * (b_{c} - a_{c})" for c in ["l_quantity", "l_extendedprice", "l_net"])


@query(
    "accept_rows",
    f"""WITH {LINKED_SQL}, bent AS (SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_orderkey % 1000 = 5 THEN 30 ELSE 1 END AS l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 97 = 3 THEN 90000.0 - l_net WHEN l_orderkey % 89 = 4 THEN l_net * 20 ELSE l_net END AS l_net, ship_mode FROM linked), {MAHAL_SQL}, {CLASS_SQL}, {IQR_ALL},
f AS (SELECT CAST(joint_outlier AS INTEGER) + CAST(({CLASS_FLAG}) AS INTEGER) + CAST(({IQR_ANY}) AS INTEGER) AS failed FROM j JOIN cs USING (ship_mode), iq)
SELECT failed <= 1 AS accepted, count(*) AS n FROM f GROUP BY 1""",
)
def _(spark, folder):
    base = lineitem_linked(spark, folder)
    stats = C.class_stats(base, "ship_mode", LINKED_NUMBERS)
    names = ["l_extendedprice", "l_net"]
    df = base.select(
        "l_linenumber",
        (F.col("l_quantity") * F.when(F.col("l_orderkey") % 1000 == 5, 30).otherwise(1)).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_orderkey") % 97 == 3, 90000.0 - F.col("l_net")).when(F.col("l_orderkey") % 89 == 4, F.col("l_net") * 20).otherwise(F.col("l_net")).alias("l_net"),
        "ship_mode",
    )
    profile = P.profile_numeric(base, ["l_quantity", "l_extendedprice", "l_net"])
    pairs = A.pearson_pairs(base, names)
    flagged = V.quality_flags(df, profile, pairs, "ship_mode", stats)
    return V.accept_rows(flagged).groupBy("accepted").agg(F.count("*").alias("n"))


@query(
    "validate",
    f"""{PAIR_SQL}, {ORIG_LIMITS}, o AS (SELECT DISTINCT o_custkey, round(o_totalprice, 4) AS p, o_orderstatus, o_orderpriority FROM orig),
r AS (SELECT count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS repaired, count(*) AS evaluated FROM synth, lim),
c AS (SELECT count(*) AS copies FROM synth s JOIN o ON s.o_custkey = o.o_custkey AND round(s.o_totalprice, 4) = p AND s.o_orderstatus = o.o_orderstatus AND s.o_orderpriority = o.o_orderpriority)
SELECT evaluated, repaired, 0 AS rejected_quality, copies AS rejected_copies, evaluated - copies AS accepted FROM r, c""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    compared = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    return V.validation_counts(s, o, P.constraints(o), P.profile_numeric(o, ["o_totalprice"]), "o_orderkey", compared=compared)


FOLDED_SQL = f"""{LINKED_SQL}, lim AS (SELECT min(l_net) AS lo, max(l_net) AS hi FROM linked),
bent AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 97 = 3 THEN greatest(lo, least(hi, lo + hi - l_net)) ELSE l_net END AS l_net,
  CASE WHEN l_orderkey % 50 = 1 THEN 'none' ELSE ship_mode END AS ship_mode FROM linked, lim)"""


@query(
    "validate_gate",
    f"""WITH {FOLDED_SQL}, {MAHAL_SQL}, {IQR_ALL}, o AS (SELECT DISTINCT l_linenumber, round(l_net, 4) AS p FROM linked),
f AS (SELECT j.*, joint_outlier OR {IQR_ANY} AS failed, p IS NOT NULL AS copied FROM iq, j LEFT JOIN o ON j.l_linenumber = o.l_linenumber AND round(j.l_net, 4) = p)
SELECT count(*) AS evaluated, count(*) FILTER (ship_mode = 'none') AS repaired, count(*) FILTER (failed) AS rejected_quality,
  count(*) FILTER (NOT failed AND copied) AS rejected_copies, count(*) FILTER (NOT failed AND NOT copied) AS accepted FROM f""",
)
def _(spark, folder):
    base = lineitem_linked(spark, folder)
    ends = base.agg(F.min("l_net").alias("lo"), F.max("l_net").alias("hi"))
    folded = F.greatest("lo", F.least("hi", F.col("lo") + F.col("hi") - F.col("l_net")))
    df = base.join(F.broadcast(ends)).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 97 == 3, folded).otherwise(F.col("l_net")).alias("l_net"),
        F.when(F.col("l_orderkey") % 50 == 1, "none").otherwise(F.col("ship_mode")).alias("ship_mode"),
    )
    return V.validation_counts(
        df, base, P.constraints(base), P.profile_numeric(base, ["l_quantity", "l_extendedprice", "l_net"]), "l_orderkey", compared=["l_linenumber", "l_net"],
        pairs=A.pearson_pairs(base, ["l_extendedprice", "l_net"]), distribution=P.full_value_distribution(base, ["ship_mode"]), max_failures=0,
    )


@query(
    "enforce_comparison",
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_suppkey < l_partkey) THEN l_partkey - 1 ELSE l_suppkey END AS l_suppkey, l_partkey,
  CASE WHEN NOT (l_discount <= l_tax) THEN l_tax ELSE l_discount END AS l_discount FROM lineitem""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_tax")
    out = V.enforce_comparison(V.enforce_comparison(df, "l_suppkey", "<", "l_partkey"), "l_discount", "<=", "l_tax")
    return out.drop("l_tax")


@query(
    "enforce_comparison_dates",
    """SELECT o_orderkey, CASE WHEN NOT (due > o_orderdate) THEN o_orderdate + INTERVAL 1 DAY ELSE due END AS due
FROM (SELECT o_orderkey, o_orderdate, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 2) AS due FROM orders)""",
)
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + make_dt_interval(int(o_orderkey % 5 - 2))").alias("due"))
    return V.enforce_comparison(df, "due", ">", "o_orderdate").select("o_orderkey", "due")


@query(
    "enforce_conditional",
    """SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'R' THEN greatest(10.0, least(40.0, l_quantity)) ELSE l_quantity END AS l_quantity FROM lineitem""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return V.enforce_conditional(df, "l_returnflag", "R", "l_quantity", 10, 40)


RULES = [
    {"type": "comparison", "left": "l_suppkey", "op": "<", "right": "l_partkey"},
    {"type": "comparison", "left": "l_discount", "op": "<=", "right": "l_tax"},
    {"type": "conditional", "when": {"column": "l_returnflag", "equals": "R"}, "then": {"column": "l_quantity", "min": 10, "max": 40}},
    {"type": "conditional", "when": {"column": "absent", "equals": "R"}, "then": {"column": "l_quantity", "min": 10}},
]


@query(
    "violations",
    """SELECT 0 AS rule, count(*) FILTER (NOT l_suppkey < l_partkey) AS violations FROM lineitem
UNION ALL SELECT 1, count(*) FILTER (NOT l_discount <= l_tax) FROM lineitem
UNION ALL SELECT 2, count(*) FILTER (l_returnflag = 'R' AND (l_quantity < 10 OR l_quantity > 40)) FROM lineitem""",
)
def _(spark, folder):
    return V.count_violations(table(spark, folder, "lineitem"), RULES)


@query(
    "enforce_rules",
    """SELECT CAST(sum(CASE WHEN NOT (l_suppkey < l_partkey) THEN l_partkey - 1 ELSE l_suppkey END) AS BIGINT) AS suppkeys,
  round(sum(CASE WHEN NOT (l_discount <= l_tax) THEN l_tax ELSE l_discount END), 4) AS discounts,
  sum(CASE WHEN l_returnflag = 'R' THEN greatest(10.0, least(40.0, l_quantity)) ELSE l_quantity END) AS quantities, count(*) AS n FROM lineitem""",
)
def _(spark, folder):
    out = V.enforce_rules(table(spark, folder, "lineitem"), RULES)
    return out.agg(
        F.sum("l_suppkey").alias("suppkeys"), rounded(F.sum("l_discount"), 4).alias("discounts"), F.sum("l_quantity").alias("quantities"), F.count("*").alias("n")
    )


@query(
    "invariants",
    f"""{PAIR_SQL}, base AS (SELECT * FROM (VALUES ('SCHEMA_MATCH', 'o_comment'), ('SCHEMA_MATCH', 'o_clerk')) t("check", "column"))
SELECT "check", "column", 1 AS n_bad, false AS passed FROM base
UNION ALL SELECT 'COL_ORDER', '', 1, false UNION ALL SELECT 'NO_EMPTY', '', 0, true UNION ALL SELECT 'ROW_COUNT', '', 7, false
UNION ALL SELECT 'NO_NAN', 'o_orderkey', 0, true UNION ALL SELECT 'NO_INF', 'o_orderkey', 0, true UNION ALL SELECT 'NO_NAN', 'o_custkey', 0, true UNION ALL SELECT 'NO_INF', 'o_custkey', 0, true
UNION ALL SELECT 'TYPE_SAFETY', 'o_totalprice', count(*) FILTER (o_orderkey % 50 = 3), false FROM synth
UNION ALL SELECT 'NO_NAN', 'o_totalprice', count(*) FILTER (o_orderkey % 50 = 3 OR o_orderkey % 50 = 4), false FROM synth
UNION ALL SELECT 'NO_INF', 'o_totalprice', count(*) FILTER (o_orderkey % 50 = 5), false FROM synth
UNION ALL SELECT 'CAT_VALIDITY', 'o_orderstatus', count(*) FILTER (o_orderstatus = 'X'), false FROM synth
UNION ALL SELECT 'CAT_VALIDITY', 'o_orderpriority', 0, true""",
)
def _(spark, folder):
    o, s = pair(spark, folder)
    key = F.col("o_orderkey")
    price = F.when(key % 50 == 3, "n/a").when(key % 50 == 4, "NaN").when(key % 50 == 5, "Infinity").otherwise(F.col("o_totalprice").cast("string"))
    broken = s.select("o_custkey", "o_orderkey", price.alias("o_totalprice"), "o_orderstatus", "o_orderpriority", F.lit("x").alias("o_clerk"))
    return V.check_invariants(broken, [*o.columns, "o_comment"], P.constraints(o), s.count() + 7)


@query(
    "sanity",
    """WITH flat AS (SELECT * FROM events) SELECT 'NUMERIC_COLLAPSE' AS "check", 'value' AS "column" UNION ALL SELECT 'CATEGORICAL_DOMINANCE', 'event_type'
UNION ALL SELECT 'INVENTED_CATEGORIES', 'event_type' FROM flat WHERE event_id = 1""",
)
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value")
    broken = e.select("event_id", F.when(F.col("event_id") % 500 == 1, "odd").otherwise("click").alias("event_type"), F.lit(3.5).alias("value"))
    found = V.sanity_checks(broken, P.profile_numeric(e, ["value"]), P.top_values(e, ["event_type"]), P.constraints(e))
    return found.select("check", "column")
