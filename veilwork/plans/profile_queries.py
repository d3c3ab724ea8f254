"""Profiling and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES, PROBS, rounded
from veilwork.operators import association as A
from veilwork.operators import profile as P
from veilwork.plans.fixtures import (
    HOLES_SQL,
    PAIR_SQL,
    WIDE_NUMBERS,
    WIDE_SQL,
    lineitem_wide,
    orders_holes,
    orders_original,
    orders_release,
)
from veilwork.plans.registry import query, table

LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", *LINE_NUMBERS]
CUSTOMER_TEXTS = ["c_name", "c_mktsegment"]


def union_sql(columns, template):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def long_sql(columns, source, cast):
    return union_sql(columns, "SELECT '{c}' AS \"column\", CAST({c} AS %s) AS value FROM %s" % (cast, source))


def profile_sql(columns, source, prefix=""):
    levels = "[" + ",".join(str(p) for p in PROBS) + "]"
    picks = ", ".join(f"round(q[{i + 1}], 4) + 0.0 AS {n}" for i, n in enumerate(PROB_NAMES))
    return f"""
WITH {prefix} long AS ({long_sql(columns, source, 'DOUBLE')}),
s AS (SELECT "column", avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio,
  count(DISTINCT value) AS unique_count, min(value) AS min, max(value) AS max, avg(value) AS mean,
  stddev_samp(value) AS std, quantile_cont(value, {levels}) AS q, bool_and(value % 1 = 0) AS is_integer
  FROM long GROUP BY 1)
SELECT "column", round(null_ratio, 6) AS null_ratio, unique_count, min, max, round(mean, 4) AS mean,
  round(std, 4) AS std, {picks}, round(q[10] - q[6], 4) AS iqr,
  round(q[6] - 1.5 * (q[10] - q[6]), 4) + 0.0 AS lo_fence, round(q[10] + 1.5 * (q[10] - q[6]), 4) AS hi_fence, is_integer
FROM s"""


def round_profile(df):
    exact = {"column", "unique_count", "min", "max", "is_integer"}
    return df.select(
        *[
            F.col(c) if c in exact else rounded(F.col(c), 6 if c == "null_ratio" else 4).alias(c)
            for c in df.columns
        ]
    )


@query("profile_numeric", profile_sql(ALL_LINE_NUMBERS, "lineitem"))
def _(spark, folder):
    return round_profile(P.profile_numeric(table(spark, folder, "lineitem")))


@query("profile_numeric_nulls", profile_sql(["o_totalprice", "o_custkey"], "holes", HOLES_SQL + ","))
def _(spark, folder):
    return round_profile(P.profile_numeric(orders_holes(spark, folder), ["o_totalprice", "o_custkey"]))


@query(
    "profile_light",
    f"""
WITH {HOLES_SQL}, texts AS ({long_sql(['o_orderkey', 'o_totalprice', 'o_orderpriority', 'o_orderstatus', 'o_custkey'], 'holes', 'VARCHAR')}),
numbers AS ({long_sql(['o_orderkey', 'o_totalprice', 'o_custkey'], 'holes', 'DOUBLE')}),
a AS (SELECT "column", avg(CASE WHEN value IS NULL OR value = '' THEN 1.0 ELSE 0.0 END) AS missing_ratio,
  count(DISTINCT value) AS distinct_n FROM texts GROUP BY 1),
b AS (SELECT "column", min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std FROM numbers GROUP BY 1)
SELECT "column", round(missing_ratio, 6) AS missing_ratio, distinct_n AS "distinct", min, max,
  round(mean, 4) AS mean, round(std, 4) AS std FROM a LEFT JOIN b USING ("column")""",
)
def _(spark, folder):
    df = P.profile_light(orders_holes(spark, folder))
    return df.select(
        "column",
        rounded(F.col("missing_ratio"), 6).alias("missing_ratio"),
        "distinct",
        "min",
        "max",
        rounded(F.col("mean"), 4).alias("mean"),
        rounded(F.col("std"), 4).alias("std"),
    )


@query(
    "iqr_bounds",
    f"""
WITH long AS ({long_sql(LINE_NUMBERS, 'lineitem', 'DOUBLE')}),
q AS (SELECT "column", quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM long GROUP BY 1)
SELECT "column", round(b - a, 4) AS iqr, round(a - 1.5 * (b - a), 4) + 0.0 AS lo, round(b + 1.5 * (b - a), 4) AS hi FROM q""",
)
def _(spark, folder):
    b = P.iqr_bounds(P.profile_numeric(table(spark, folder, "lineitem"), LINE_NUMBERS))
    return b.select("column", *[rounded(F.col(c), 4).alias(c) for c in ("iqr", "lo", "hi")])


@query(
    "is_integer",
    f"""
WITH {WIDE_SQL}, long AS ({long_sql(WIDE_NUMBERS, 'wide', 'DOUBLE')})
SELECT "column", bool_and(value % 1 = 0) AS is_integer FROM long GROUP BY 1""",
)
def _(spark, folder):
    return P.is_integer_column(lineitem_wide(spark, folder), WIDE_NUMBERS)


@query(
    "value_ratios",
    f"""
WITH {WIDE_SQL}, long AS ({long_sql(WIDE_NUMBERS, 'wide', 'DOUBLE')}),
s AS (SELECT "column", count(value) AS total, count(DISTINCT value) AS d, bool_and(value % 1 = 0) AS w FROM long GROUP BY 1)
SELECT "column", CAST(value AS BIGINT) AS value, count(*) AS n, round(count(*) / any_value(total), 6) AS ratio
FROM long JOIN s USING ("column") WHERE w AND d BETWEEN 2 AND 50 GROUP BY 1, 2""",
)
def _(spark, folder):
    df = P.value_ratios(lineitem_wide(spark, folder), WIDE_NUMBERS)
    return df.withColumn("ratio", rounded(F.col("ratio"), 6))


@query(
    "top_values",
    f"""
WITH long AS ({long_sql(['p_name', 'p_brand', 'p_type'], 'part', 'VARCHAR')}),
c AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total,
  row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c)
SELECT "column", value, n, round(n / total, 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def _(spark, folder):
    df = P.top_values(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])
    return df.withColumn("ratio", rounded(F.col("ratio"), 6))


@query(
    "value_distribution",
    f"""
WITH long AS ({long_sql(['c_name', 'c_mktsegment'], 'customer', 'VARCHAR')}),
c AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS d FROM c)
SELECT "column", value, n, round(n / total, 6) AS ratio FROM r WHERE d <= 200""",
)
def _(spark, folder):
    df = P.full_value_distribution(table(spark, folder, "customer"), CUSTOMER_TEXTS)
    return df.withColumn("ratio", rounded(F.col("ratio"), 6))


@query(
    "constraints",
    f"""
WITH {HOLES_SQL}, num AS ({long_sql(['o_orderkey', 'o_totalprice', 'o_custkey'], 'holes', 'DOUBLE')}),
cat AS ({long_sql(['o_orderpriority', 'o_orderstatus'], 'holes', 'VARCHAR')}),
c AS (
SELECT "column", 'range' AS kind, min(value) AS lo, max(value) AS hi, NULL AS allowed,
  avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio FROM num GROUP BY 1
UNION ALL
SELECT "column", CASE WHEN count(DISTINCT value) BETWEEN 1 AND 50 THEN 'allowed' ELSE 'open' END, NULL, NULL,
  CASE WHEN count(DISTINCT value) BETWEEN 1 AND 50 THEN string_agg(DISTINCT value, '|' ORDER BY value) END,
  avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM cat GROUP BY 1)
SELECT "column", kind, lo, hi, allowed, round(null_ratio, 6) AS null_ratio, null_ratio <= 0.2 AS null_ok FROM c""",
)
def _(spark, folder):
    df = P.constraints(orders_holes(spark, folder), 0.2)
    return df.withColumn("allowed", F.concat_ws("|", "allowed")).select(
        "column",
        "kind",
        "lo",
        "hi",
        F.when(F.col("kind") == "allowed", F.col("allowed")).alias("allowed"),
        rounded(F.col("null_ratio"), 6).alias("null_ratio"),
        "null_ok",
    )


@query(
    "pearson_pairs",
    "WITH "
    + WIDE_SQL
    + ", p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS value FROM wide"
        for i, a in enumerate(WIDE_NUMBERS)
        for b in WIDE_NUMBERS[i + 1 :]
    )
    + """) SELECT col_a, col_b, round(value, 6) + 0.0 AS value, CASE WHEN abs(value) >= 0.9 THEN 'very_strong'
  WHEN abs(value) >= 0.7 THEN 'strong' WHEN abs(value) >= 0.4 THEN 'medium' WHEN abs(value) >= 0.2 THEN 'weak'
  ELSE 'very_weak' END AS strength FROM p WHERE value IS NOT NULL""",
)
def _(spark, folder):
    df = A.pearson_pairs(lineitem_wide(spark, folder), WIDE_NUMBERS)
    return df.withColumn("value", rounded(F.col("value"), 6))


def cramers_sql(columns, source, prefix):
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, count(*) AS o "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )
    return f"""
WITH {prefix}, cells AS ({cells}),
xs AS (SELECT col_a, col_b, x, sum(o) AS rx FROM cells GROUP BY ALL),
ys AS (SELECT col_a, col_b, y, sum(o) AS cy FROM cells GROUP BY ALL),
t AS (SELECT col_a, col_b, sum(o) AS n, count(DISTINCT x) AS k, count(DISTINCT y) AS r FROM cells GROUP BY 1, 2),
grid AS (SELECT xs.col_a, xs.col_b, x, y, rx, cy, n, k, r, coalesce(o, 0) AS o, rx * cy / n AS e
  FROM xs JOIN ys USING (col_a, col_b) JOIN t USING (col_a, col_b) LEFT JOIN cells USING (col_a, col_b, x, y)),
chi AS (SELECT col_a, col_b, any_value(n) AS n, any_value(k) AS k, any_value(r) AS r, sum((o - e) * (o - e) / e) AS chi2
  FROM grid GROUP BY 1, 2)
SELECT col_a, col_b, round(sqrt(greatest(0, chi2 / n / least(k - (k - 1) * (k - 1) / (n - 1) - 1,
  r - (r - 1) * (r - 1) / (n - 1) - 1))), 6) AS value, CAST(n AS BIGINT) AS n, k, r FROM chi"""


CRAMER_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "discount_pct"]


@query("cramers_v", cramers_sql(CRAMER_COLUMNS, "wide", WIDE_SQL))
def _(spark, folder):
    df = lineitem_wide(spark, folder).drop("l_orderkey")
    rows = A.cramers_v(df, A.association_columns(df))
    return rows.select("col_a", "col_b", rounded(F.col("value"), 6).alias("value"), "n", "k", "r")


def cat_num_sql(cats, numbers, source, prefix, exact=False):
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS col_a, '{x}' AS col_b, CAST({c} AS VARCHAR) AS v, CAST({x} AS DOUBLE) AS x FROM {source} "
        f"WHERE {c} IS NOT NULL AND {x} IS NOT NULL"
        for c in cats
        for x in numbers
        if c != x
    )
    scale = "stddev_pop(x)" if exact else "sqrt(var_samp(x) * count(*) / (count(*) - 1))"
    return f"""
WITH {prefix}, l AS ({rows}),
g AS (SELECT col_a, col_b, v, count(*) AS n, avg(x) AS m FROM l GROUP BY 1, 2, 3),
t AS (SELECT col_a, col_b, avg(x) AS gm, var_pop(x) * count(*) AS st, {scale} AS s, count(*) AS n FROM l GROUP BY 1, 2),
j AS (SELECT col_a, col_b, count(*) AS classes, sum(g.n * (m - gm) * (m - gm)) AS sb, any_value(st) AS st, any_value(s) AS s,
  any_value(t.n) AS n, arg_min(m, v) AS m0, arg_max(m, v) AS m1, arg_min(g.n, v) AS n0, arg_max(g.n, v) AS n1
  FROM g JOIN t USING (col_a, col_b) GROUP BY 1, 2)
SELECT col_a, col_b, round(CASE WHEN classes = 2 THEN (m1 - m0) / s * sqrt(n0 * n1 / (n * CAST(n AS DOUBLE)))
  ELSE sqrt(sb / st) END, 6) + 0.0 AS value, classes FROM j WHERE classes >= 2 AND st > 0"""


@query("cat_num_assoc", cat_num_sql(CRAMER_COLUMNS, WIDE_NUMBERS, "wide", WIDE_SQL))
def _(spark, folder):
    df = lineitem_wide(spark, folder)
    rows = A.cat_num_association(df, CRAMER_COLUMNS, WIDE_NUMBERS)
    return rows.withColumn("value", rounded(F.col("value"), 6))


@query("cat_num_assoc_exact", cat_num_sql(["o_orderstatus", "o_orderpriority"], ["o_totalprice"], "holes", HOLES_SQL, True))
def _(spark, folder):
    rows = A.cat_num_association(
        orders_holes(spark, folder), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], exact=True
    )
    return rows.withColumn("value", rounded(F.col("value"), 6))


EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


@query(
    "column_entropy",
    f"""
WITH long AS ({long_sql(EVENT_COLUMNS, 'events', 'VARCHAR')}),
c AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
p AS (SELECT "column", n, n / sum(n) OVER (PARTITION BY "column") AS p FROM c)
SELECT "column", CAST(sum(n) AS BIGINT) AS total, count(*) AS "distinct",
  round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM p GROUP BY 1""",
)
def _(spark, folder):
    from veilwork.operators.frames import melt_text, value_counts

    df = P.value_entropy(value_counts(melt_text(table(spark, folder, "events"), EVENT_COLUMNS)))
    return df.withColumn("entropy", rounded(F.col("entropy"), 6))


@query(
    "histogram",
    PAIR_SQL
    + """, l AS (SELECT 'original' AS side, o_totalprice AS v FROM orig UNION ALL SELECT 'release', o_totalprice FROM synth),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM l)
SELECT 'o_totalprice' AS "column", side, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n
FROM l, e GROUP BY 2, 3""",
)
def _(spark, folder):
    sides = {"original": orders_original(spark, folder), "release": orders_release(spark, folder)}
    return P.histogram(sides, ["o_totalprice"], 20)


@query(
    "null_corr",
    f"WITH {HOLES_SQL}, f AS (SELECT "
    + ", ".join(
        f"CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS {c}"
        for c in ["o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"]
    )
    + " FROM holes), p AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS value FROM f"
        for a, b in [
            ("o_totalprice", "o_orderpriority"),
            ("o_totalprice", "o_orderstatus"),
            ("o_totalprice", "o_custkey"),
            ("o_orderpriority", "o_orderstatus"),
            ("o_orderpriority", "o_custkey"),
            ("o_orderstatus", "o_custkey"),
        ]
    )
    + ") SELECT col_a, col_b, round(value, 6) + 0.0 AS value FROM p",
)
def _(spark, folder):
    df = A.null_correlation(orders_holes(spark, folder))
    return df.withColumn("value", rounded(F.col("value"), 6))


SUMMARY_SQL = """
SELECT "column", min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std,
  list_sort(list(v))[CAST(floor(count(v) / 2) AS BIGINT) + 1] AS median, count(v) AS count FROM long GROUP BY 1"""


@query(
    "stat_summary",
    "WITH long AS ("
    + union_sql(LINE_NUMBERS, "SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem")
    + ")"
    + SUMMARY_SQL,
)
def _(spark, folder):
    df = P.stat_summary(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return df.withColumn("mean", rounded(F.col("mean"), 4)).withColumn("std", rounded(F.col("std"), 4))


@query(
    "compare_means",
    PAIR_SQL
    + """, m AS (SELECT 'o_totalprice' AS "column", (SELECT avg(o_totalprice) FROM orig) AS a, (SELECT avg(o_totalprice) FROM synth) AS b
UNION ALL SELECT 'o_custkey', (SELECT avg(o_custkey) FROM orig), (SELECT avg(o_custkey) FROM synth))
SELECT "column", round(a, 4) AS mean_original, round(b, 4) AS mean_synthetic, round((b - a) / abs(a) * 100, 4) + 0.0 AS delta_pct,
  abs((b - a) / abs(a) * 100) > 10 AS flagged FROM m""",
)
def _(spark, folder):
    cols = ["o_totalprice", "o_custkey"]
    df = P.compare_means(
        P.stat_summary(orders_original(spark, folder), cols), P.stat_summary(orders_release(spark, folder), cols)
    )
    return df.select(
        "column",
        *[rounded(F.col(c), 4).alias(c) for c in ("mean_original", "mean_synthetic", "delta_pct")],
        "flagged",
    )


@query(
    "missing_report",
    f"""
WITH {HOLES_SQL}, l AS ({long_sql(['o_orderkey', 'o_totalprice', 'o_orderpriority', 'o_orderstatus', 'o_custkey'], 'holes', 'VARCHAR')}),
m AS (SELECT "column", avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM l GROUP BY 1)
SELECT "column", round(r, 6) AS null_ratio, CASE WHEN r > 0.6 THEN 'high' WHEN r > 0.3 THEN 'medium' ELSE 'low' END AS severity
FROM m WHERE r > 0.05""",
)
def _(spark, folder):
    light = P.profile_light(orders_holes(spark, folder)).withColumnRenamed("missing_ratio", "null_ratio")
    return P.missing_report(light).withColumn("null_ratio", rounded(F.col("null_ratio"), 6))


@query(
    "pair_correlation",
    PAIR_SQL
    + """, q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orig)
SELECT 'original' AS side, 'o_totalprice' AS col_x, 'o_custkey' AS col_y, round(corr(o_totalprice, o_custkey), 6) AS pearson, count(*) AS n,
  (SELECT round(a, 4) FROM q) AS q25, (SELECT round(b, 4) FROM q) AS q75 FROM orig
UNION ALL
SELECT 'release', 'o_totalprice', 'o_custkey', round(corr(o_totalprice, o_custkey), 6), count(*),
  (SELECT round(a, 4) FROM q), (SELECT round(b, 4) FROM q) FROM synth""",
)
def _(spark, folder):
    original = orders_original(spark, folder)
    box = P.profile_numeric(original, ["o_totalprice"]).select(F.col("column").alias("col_x"), "q25", "q75")
    both = (
        A.pair_correlation(original, "o_totalprice", "o_custkey")
        .withColumn("side", F.lit("original"))
        .unionByName(
            A.pair_correlation(orders_release(spark, folder), "o_totalprice", "o_custkey").withColumn("side", F.lit("release"))
        )
    )
    return both.join(F.broadcast(box), "col_x").select(
        "side",
        "col_x",
        "col_y",
        rounded(F.col("pearson"), 6).alias("pearson"),
        "n",
        rounded(F.col("q25"), 4).alias("q25"),
        rounded(F.col("q75"), 4).alias("q75"),
    )
