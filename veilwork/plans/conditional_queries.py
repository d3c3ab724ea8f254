"""Queries on conditional statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES, PROBS, rounded
from veilwork.operators import conditional as C
from veilwork.plans.fixtures import LINKED_CATEGORIES, LINKED_NUMBERS, LINKED_SQL, lineitem_linked
from veilwork.plans.profile_queries import cat_num_sql, cramers_sql, union_sql
from veilwork.plans.registry import query, table

LEVELS = "[" + ",".join(str(p) for p in PROBS) + "]"
LEVEL_PICKS = ", ".join(f"round(q[{i + 1}], 4) + 0.0 AS {n}" for i, n in enumerate(PROB_NAMES))


def moments_sql(groups, source, min_rows):
    return f"""
SELECT {groups}, n, round(mean, 4) + 0.0 AS mean, round(CASE WHEN coalesce(std, 0) > 0 THEN std ELSE 1e-6 END, 4) AS std,
  min, max, {LEVEL_PICKS} FROM (SELECT {groups}, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
  max(value) AS max, quantile_cont(value, {LEVELS}) AS q FROM {source} GROUP BY {groups}) WHERE n >= {min_rows}"""


def round_moments(df):
    return df.select(*[rounded(F.col(c), 4).alias(c) if c in ("mean", "std", *PROB_NAMES) else F.col(c) for c in df.columns])


FLAGS = ["l_returnflag", "ship_mode"]


@query(
    "class_stats",
    f"WITH {LINKED_SQL}, l AS ("
    + union_sql(LINKED_NUMBERS, "SELECT ship_mode AS label, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM linked")
    + ")"
    + moments_sql('label, "column"', "l", 2),
)
def _(spark, folder):
    return round_moments(C.class_stats(lineitem_linked(spark, folder), "ship_mode", LINKED_NUMBERS))


@query(
    "class_value_ratios",
    f"""WITH {LINKED_SQL}, l AS (
SELECT ship_mode AS label, 'l_linenumber' AS "column", CAST(l_linenumber AS BIGINT) AS value FROM linked
UNION ALL SELECT ship_mode, 'l_quantity', CAST(l_quantity AS BIGINT) FROM linked)
SELECT label, "column", value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label, "column"), 6) AS ratio
FROM l GROUP BY 1, 2, 3""",
)
def _(spark, folder):
    df = C.class_value_ratios(lineitem_linked(spark, folder), "ship_mode", LINKED_NUMBERS)
    return df.withColumn("ratio", rounded(F.col("ratio"), 6))


def shrink_sql(counts, groups, overall, pull):
    """CTEs ``s`` (shrunk) and ``f`` (protected) from ``counts`` (groups, column, value, n) and ``overall``."""
    g = ", ".join(groups)
    return f"""
gt AS (SELECT {g}, "column", sum(n) AS n_group FROM {counts} GROUP BY {g}, "column"),
s AS (SELECT {', '.join('gt.' + x for x in groups)}, gt."column", o.value, n_group, coalesce(c.n, 0) / n_group AS raw,
  n_group / (n_group + greatest(1, o.d / 5.0) * {pull}) * (coalesce(c.n, 0) / n_group)
  + (1 - n_group / (n_group + greatest(1, o.d / 5.0) * {pull})) * o.ratio AS p
  FROM gt JOIN {overall} o ON gt."column" = o."column" LEFT JOIN {counts} c ON c."column" = gt."column" AND c.value = o.value
  {' '.join(f'AND c.{x} = gt.{x}' for x in groups)}),
lift AS (SELECT *, CASE WHEN raw > 0 AND 0.5 * raw > p THEN 0.5 * raw - p ELSE 0 END AS l FROM s),
need AS (SELECT *, sum(l) OVER w AS t, sum(CASE WHEN l > 0 THEN 0 ELSE p END) OVER w AS donor FROM lift WINDOW w AS (PARTITION BY {g}, "column")),
moved AS (SELECT *, CASE WHEN t > 0 AND donor > 0 AND l > 0 THEN p + l * least(t, 0.15) / t
  WHEN t > 0 AND donor > 0 THEN p * greatest(0, (donor - least(t, 0.15)) / donor) ELSE p END AS p2 FROM need),
f AS (SELECT *, p2 / sum(p2) OVER (PARTITION BY {g}, "column") AS p3 FROM moved)"""


CLASS_COUNTS = (
    f"WITH {LINKED_SQL}, c AS ("
    + union_sql(["l_returnflag", "l_linestatus", "price_band"], "SELECT ship_mode AS label, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM linked GROUP BY ALL")
    + """), ov AS (SELECT "column", value, sum(n) / sum(sum(n)) OVER (PARTITION BY "column") AS ratio,
  count(*) OVER (PARTITION BY "column") AS d FROM c GROUP BY "column", value),"""
    + shrink_sql("c", ["label"], "ov", 20.0)
)


@query(
    "class_freq",
    CLASS_COUNTS + ' SELECT label, "column", value, CAST(n_group AS BIGINT) AS n_group, round(raw, 6) AS raw, round(p, 6) AS p FROM s',
)
def _(spark, folder):
    cols = ["l_returnflag", "l_linestatus", "price_band"]
    df = C.class_freq(lineitem_linked(spark, folder), "ship_mode", cols, protect=False)
    return df.withColumn("raw", rounded(F.col("raw"), 6)).withColumn("p", rounded(F.col("p"), 6))


# each customer segment's spread over nations, strongly shrunk so that the floor has work to do
SEGMENT_COUNTS = (
    """WITH c AS (SELECT c_mktsegment AS label, 'c_nationkey' AS "column", CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n
FROM customer GROUP BY ALL), ov AS (SELECT "column", value, sum(n) / sum(sum(n)) OVER (PARTITION BY "column") AS ratio,
  count(*) OVER (PARTITION BY "column") AS d FROM c GROUP BY "column", value),"""
    + shrink_sql("c", ["label"], "ov", 400000.0)
)


@query(
    "protect_sparse",
    SEGMENT_COUNTS.replace("o.ratio AS p", "o.ratio * o.ratio AS p")
    + ' SELECT label, "column", value, CAST(n_group AS BIGINT) AS n_group, round(raw, 6) AS raw, round(p3, 6) AS p FROM f',
)
def _(spark, folder):
    from veilwork.operators.frames import melt_text, value_counts
    from veilwork.operators.profile import with_ratios

    df = table(spark, folder, "customer").withColumn("label", F.col("c_mktsegment"))
    counts = value_counts(melt_text(df, ["c_nationkey"], ["label"]), ["label"])
    overall = with_ratios(counts.groupBy("column", "value").agg(F.sum("n").alias("n")))
    overall = overall.withColumn("ratio", F.col("ratio") * F.col("ratio"))
    out = C.protect_sparse(C.shrink(counts, overall, ["label"], 400000.0), ["label", "column"])
    return out.withColumn("raw", rounded(F.col("raw"), 6)).withColumn("p", rounded(F.col("p"), 6))


def bins_sql(n, column, source):
    levels = "[" + ",".join(repr(i / n) for i in range(n + 1)) + "]"
    return f"""edges AS (SELECT quantile_cont({column}, {levels}) AS q FROM {source}),
binned AS (SELECT s.*, CAST(len([e for e in (SELECT q FROM edges)[2:{n}] if e < CAST({column} AS DOUBLE)]) AS INTEGER) AS bin FROM {source} s)"""


@query(
    "quantile_bins",
    f"""WITH {bins_sql(10, 'o_totalprice', 'orders')}, c AS (SELECT bin, count(*) AS n FROM binned GROUP BY 1)
SELECT bin, round(q[bin + 1], 4) AS lo, round(q[bin + 2], 4) AS hi, n FROM c, edges""",
)
def _(spark, folder):
    df = C.quantile_bins(table(spark, folder, "orders"), "o_totalprice", 5)
    return df.withColumn("lo", rounded(F.col("lo"), 4)).withColumn("hi", rounded(F.col("hi"), 4))


def partner_sql():
    v = cramers_sql(LINKED_CATEGORIES, "linked", LINKED_SQL).replace("SELECT col_a, col_b, round(sqrt", ", v AS (SELECT col_a, col_b, round(sqrt") + ")"
    sides = """, both_sides AS (SELECT col_a AS "column", col_b AS partner, value FROM v WHERE value >= 0.3 AND k * r <= n / 5
UNION ALL SELECT col_b, col_a, value FROM v WHERE value >= 0.3 AND k * r <= n / 5),
best AS (SELECT "column", partner FROM both_sides QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY value DESC, partner) = 1)"""
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", '{b}' AS partner, {b} AS given, {a} AS value, count(*) AS n FROM linked GROUP BY 3, 4"
        for a in LINKED_CATEGORIES
        for b in LINKED_CATEGORIES
        if a != b
    )
    return (
        v + sides + f""", pc AS ({pairs}), pp AS (SELECT pc.* FROM pc JOIN best USING ("column", partner)),
ov AS (SELECT "column", value, sum(n) / sum(sum(n)) OVER (PARTITION BY "column") AS ratio, count(*) OVER (PARTITION BY "column") AS d
  FROM pp GROUP BY "column", value), big AS (SELECT * FROM pp QUALIFY sum(n) OVER (PARTITION BY "column", given) >= 5),"""
        + shrink_sql("big", ["partner", "given"], "ov", 2.0)
    )


@query(
    "cond_freq_cat",
    partner_sql() + ' SELECT "column", partner, given, value, CAST(n_group AS BIGINT) AS n_group, round(raw, 6) AS raw, round(p3, 6) AS p FROM f',
)
def _(spark, folder):
    df = C.cond_freq_cat(lineitem_linked(spark, folder), LINKED_CATEGORIES)
    return df.select(
        "column", "partner", "given", "value", "n_group", rounded(F.col("raw"), 6).alias("raw"), rounded(F.col("p"), 6).alias("p")
    )


@query(
    "cond_freq_num",
    f"""WITH {LINKED_SQL}, {bins_sql(10, 'l_extendedprice', 'linked')},
c AS (SELECT 'price_band' AS "column", 'l_extendedprice' AS partner, bin, price_band AS value, count(*) AS n FROM binned GROUP BY ALL),
ov AS (SELECT "column", value, sum(n) / sum(sum(n)) OVER () AS ratio, count(*) OVER () AS d FROM c GROUP BY "column", value),"""
    + shrink_sql("c", ["partner", "bin"], "ov", 10.0)
    + ' SELECT "column", partner, bin, value, CAST(n_group AS BIGINT) AS n_group, round(raw, 6) AS raw, round(p3, 6) AS p FROM f',
)
def _(spark, folder):
    df, _edges = C.cond_freq_num(lineitem_linked(spark, folder), ["price_band"], ["l_extendedprice", "l_linenumber"])
    return df.select(
        "column", "partner", "bin", "value", "n_group", rounded(F.col("raw"), 6).alias("raw"), rounded(F.col("p"), 6).alias("p")
    )


@query(
    "cond_profile",
    cat_num_sql(LINKED_CATEGORIES, LINKED_NUMBERS, "linked", LINKED_SQL).replace("SELECT col_a, col_b, round", ", a AS (SELECT col_a, col_b, round")
    + """), best AS (SELECT * FROM a WHERE abs(value) >= 0.3
  QUALIFY row_number() OVER (PARTITION BY col_b ORDER BY abs(value) DESC, col_a DESC) = 1),
pv AS (SELECT best.col_b AS "column", best.col_a AS partner, l.v AS given, l.x AS value FROM l JOIN best USING (col_a, col_b))"""
    + moments_sql('"column", partner, given', "pv", 10),
)
def _(spark, folder):
    return round_moments(C.cond_profile(lineitem_linked(spark, folder), LINKED_CATEGORIES, LINKED_NUMBERS))


@query(
    "variance_driver",
    f"WITH {LINKED_SQL}, l AS ("
    + union_sql(LINKED_CATEGORIES, "SELECT '{c}' AS \"column\", {c} AS v, l_extendedprice AS x FROM linked")
    + """), t AS (SELECT avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS s FROM linked),
g AS (SELECT "column", v, count(*) AS n, avg(x) AS gm FROM l GROUP BY 1, 2)
SELECT "column", round(sum(n * (gm - m) * (gm - m)) / sum(n) / any_value(s), 6) AS share FROM g, t GROUP BY 1
HAVING sum(n * (gm - m) * (gm - m)) / sum(n) / any_value(s) > 0.05 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def _(spark, folder):
    df = C.variance_driver(lineitem_linked(spark, folder), "l_extendedprice", LINKED_CATEGORIES)
    return df.withColumn("share", rounded(F.col("share"), 6))


@query(
    "target_quantiles",
    f"WITH {LINKED_SQL}, {bins_sql(10, 'l_extendedprice', 'linked')}, tv AS (SELECT bin, ship_mode AS given, l_extendedprice AS value FROM binned)"
    + moments_sql("bin, given", "tv", 5),
)
def _(spark, folder):
    df = lineitem_linked(spark, folder)
    return round_moments(C.target_quantiles(df, "l_extendedprice", "ship_mode", C.quantile_bins(df, "l_extendedprice", 3)))


COV_NUMBERS = ["l_quantity", "l_extendedprice", "l_net"]


@query(
    "class_cov",
    f"WITH {LINKED_SQL}, g AS ("
    + " UNION ALL ".join(
        f"SELECT ship_mode AS label, count(*) AS n, '{a}' AS col_a, '{b}' AS col_b, covar_samp({a}, {b}) AS cov FROM linked GROUP BY 1"
        for i, a in enumerate(COV_NUMBERS)
        for b in COV_NUMBERS[i:]
    )
    + """) SELECT label, n, col_a, col_b, round(CASE WHEN col_a = col_b THEN cov ELSE (1 - least(1.0, 3.0 / greatest(1, n - 4))) * cov END, 2) AS cov
FROM g WHERE n >= 4""",
)
def _(spark, folder):
    df = C.class_covariance(lineitem_linked(spark, folder), "ship_mode", COV_NUMBERS)
    return df.withColumn("cov", rounded(F.col("cov"), 2))
