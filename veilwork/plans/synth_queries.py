"""Synthetic-data queries. Draws are plain arithmetic on row ids, so most have an exact SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.draws import uniform_sql
from veilwork.functions.numeric import rounded
from veilwork.operators import compare as M
from veilwork.operators import conditional as C
from veilwork.operators import profile as P
from veilwork.operators import synth as S
from veilwork.plans.conditional_queries import CLASS_COUNTS, partner_sql
from veilwork.plans.fixtures import (
    HOLES_SQL,
    LINKED_CATEGORIES,
    LINKED_NUMBERS,
    LINKED_SQL,
    lineitem_linked,
    orders_holes,
)
from veilwork.plans.registry import query, table
from veilwork.plans.validate_queries import PROB_LIST, curve_sql, draw_sql, knots_sql

SEED = 7


def ids_sql(source):
    return f"ids AS (SELECT unnest(range((SELECT count(*) FROM {source}))) AS row_id)"


def weights_sql(name, inner):
    """CTE ``name`` (groups.., vals, ends) from ``inner`` giving groups, v and p."""
    return f"{name} AS (SELECT list(v ORDER BY v) AS vals, list(e ORDER BY v) AS ends FROM (SELECT v, sum(p) OVER (ORDER BY v) / sum(p) OVER () AS e FROM ({inner})))"


def pick_sql(u, w=""):
    return f"{w}vals[least(len({w}vals), len([e for e in {w}ends if e <= {u}]) + 1)]"


def group_weights(name, group, inner):
    return (
        f"{name} AS (SELECT {group}, list(v ORDER BY v) AS vals, list(e ORDER BY v) AS ends FROM (SELECT {group}, v, "
        f"sum(p) OVER (PARTITION BY {group} ORDER BY v) / sum(p) OVER (PARTITION BY {group}) AS e FROM ({inner})) GROUP BY {group})"
    )


def group_knots(name, group, column, source):
    return (
        f"{name} AS (SELECT {group}, list_concat(list_concat([CAST(min({column}) AS DOUBLE)], quantile_cont(CAST({column} AS DOUBLE), {PROB_LIST})), [CAST(max({column}) AS DOUBLE)]) AS k FROM {source} GROUP BY {group})"
    )


def row_count(spark, folder, name):
    return table(spark, folder, name).count()


@query(
    "gen_numeric",
    f"""WITH {ids_sql('lineitem')}, c AS (SELECT {knots_sql('l_extendedprice', 'lineitem')} AS k),
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'l_extendedprice')} AS u, {uniform_sql('row_id', SEED, 'l_extendedprice/jitter')} AS j FROM ids)
SELECT row_id, round({draw_sql('k', 'u', 'j')}, 4) AS l_extendedprice FROM d, c""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    from veilwork.functions.curves import curve_of

    knots = curve_of(P.profile_numeric(df, ["l_extendedprice"]).first())
    rows = S.sample_numeric(S.new_rows(spark, df.count()), {"l_extendedprice": knots}, SEED)
    return rows.withColumn("l_extendedprice", rounded(F.col("l_extendedprice"), 4))


@query(
    "gen_integers",
    f"""WITH {ids_sql('lineitem')}, {weights_sql('w', 'SELECT CAST(l_quantity AS BIGINT) AS v, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1')},
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'l_quantity')} AS u FROM ids)
SELECT row_id, {pick_sql('u')} AS l_quantity FROM d, w""",
)
def _(spark, folder):
    df = table(spark, folder, "lineitem")
    return S.sample_integers(S.new_rows(spark, df.count()), P.value_ratios(df, ["l_quantity"]), "l_quantity", SEED)


@query(
    "gen_categorical",
    f"""WITH {ids_sql('orders')}, {weights_sql('w', 'SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1')},
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'o_orderpriority')} AS u FROM ids)
SELECT row_id, {pick_sql('u')} AS o_orderpriority FROM d, w""",
)
def _(spark, folder):
    df = table(spark, folder, "orders")
    return S.sample_categorical(S.new_rows(spark, df.count()), P.full_value_distribution(df, ["o_orderpriority"]), "o_orderpriority", SEED)


@query(
    "gen_conditional",
    partner_sql()
    + f""", {ids_sql('lineitem')}, {weights_sql('wm', 'SELECT ship_mode AS v, count(*) / (SELECT count(*) FROM linked) AS p FROM linked GROUP BY 1')},
{group_weights('wf', 'given', "SELECT given, value AS v, p3 AS p FROM f WHERE " + '"column"' + " = 'l_returnflag' AND partner = 'ship_mode'")},
{group_knots('kq', 'ship_mode', 'l_quantity', 'linked')},
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'ship_mode')} AS u1, {uniform_sql('row_id', SEED, 'l_returnflag')} AS u2, {uniform_sql('row_id', SEED, 'l_quantity')} AS u3,
  {uniform_sql('row_id', SEED, 'l_quantity/jitter')} AS j3 FROM ids),
a AS (SELECT d.*, {pick_sql('u1')} AS ship_mode FROM d, wm)
SELECT row_id, a.ship_mode, {pick_sql('u2', 'wf.')} AS l_returnflag, round({draw_sql('kq.k', 'u3', 'j3')}, 4) AS l_quantity
FROM a JOIN wf ON wf.given = a.ship_mode JOIN kq ON kq.ship_mode = a.ship_mode""",
)
def _(spark, folder):
    df = lineitem_linked(spark, folder)
    freqs = C.cond_freq_cat(df, LINKED_CATEGORIES).where("column = 'l_returnflag' and partner = 'ship_mode'")
    stats = C.class_stats(df, "ship_mode", ["l_quantity"]).withColumnRenamed("label", "ship_mode").drop("column", "n", "mean", "std")
    rows = S.sample_categorical(S.new_rows(spark, df.count()), P.full_value_distribution(df, ["ship_mode"]), "ship_mode", SEED)
    rows = S.sample_conditional_category(rows, "l_returnflag", ["ship_mode"], freqs.select(F.col("given").alias("ship_mode"), "value", "p"), SEED)
    rows = S.sample_conditional_number(rows, "l_quantity", ["ship_mode"], stats, SEED)
    return rows.select("row_id", "ship_mode", "l_returnflag", rounded(F.col("l_quantity"), 4).alias("l_quantity"))


@query(
    "gen_labelled",
    CLASS_COUNTS
    + f""", {ids_sql('lineitem')}, {weights_sql('wm', 'SELECT ship_mode AS v, count(*) / (SELECT count(*) FROM linked) AS p FROM linked GROUP BY 1')},
{group_weights('wf', 'label', 'SELECT label, value AS v, p3 AS p FROM f WHERE "column" = ' + "'price_band'")}, {group_knots('kq', 'ship_mode', 'l_extendedprice', 'linked')},
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'ship_mode')} AS u1, {uniform_sql('row_id', SEED, 'price_band')} AS u2, {uniform_sql('row_id', SEED, 'l_extendedprice')} AS u3,
  {uniform_sql('row_id', SEED, 'l_extendedprice/jitter')} AS j3 FROM ids),
a AS (SELECT d.*, {pick_sql('u1')} AS ship_mode FROM d, wm)
SELECT row_id, a.ship_mode, {pick_sql('u2', 'wf.')} AS price_band, round({draw_sql('kq.k', 'u3', 'j3')}, 4) AS l_extendedprice
FROM a JOIN wf ON wf.label = a.ship_mode JOIN kq ON kq.ship_mode = a.ship_mode""",
)
def _(spark, folder):
    df = lineitem_linked(spark, folder)
    rows = S.sample_by_label(df, "ship_mode", ["price_band"], ["l_extendedprice"], df.count(), SEED)
    return rows.select("row_id", "ship_mode", "price_band", rounded(F.col("l_extendedprice"), 4).alias("l_extendedprice"))


@query("gen_target_binned")
def _(spark, folder):
    df = lineitem_linked(spark, folder)
    return S.sample_by_target(df, "l_extendedprice", ["price_band", "ship_mode"], ["l_quantity"], df.count(), SEED)


@query(
    "gen_nulls",
    f"""WITH {HOLES_SQL}, r AS (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN o_orderstatus IS NULL THEN 1.0 ELSE 0.0 END) AS b FROM holes),
full_rows AS (SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus FROM orders)
SELECT row_id, CASE WHEN {uniform_sql('row_id', SEED, 'null/o_totalprice')} < a THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN {uniform_sql('row_id', SEED, 'null/o_orderstatus')} < b THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM full_rows, r""",
)
def _(spark, folder):
    holes = P.profile_light(orders_holes(spark, folder), ["o_totalprice", "o_orderstatus"])
    ratios = {r["column"]: r["missing_ratio"] for r in holes.collect()}
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderstatus")
    return S.inject_nulls(rows, ratios, SEED)


@query(
    "gen_ids",
    f"""WITH {ids_sql('customer')}, m AS (SELECT max(c_custkey) AS m FROM customer), h AS (SELECT row_id, md5('{SEED}/token/' || row_id) AS h2, md5('{SEED}/uid/' || row_id) AS h FROM ids)
SELECT row_id, row_id + m + 1 AS c_custkey, h2 AS token, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid FROM h, m""",
)
def _(spark, folder):
    df = table(spark, folder, "customer")
    row = df.agg(F.max("c_custkey").alias("m"), F.count("*").alias("n")).first()
    return S.new_rows(spark, row["n"]).select(
        "row_id",
        S.generate_ids("sequential", SEED, "c_custkey", row["m"]).alias("c_custkey"),
        S.generate_ids("hash", SEED, "token").alias("token"),
        S.generate_ids("uuid4", SEED, "uid").alias("uid"),
    )


@query(
    "gen_dates",
    f"""WITH {ids_sql('orders')}, m AS (SELECT epoch_us(min(o_orderdate)) AS a, epoch_us(max(o_orderdate)) AS b FROM orders)
SELECT row_id, a + CAST(floor(({uniform_sql('row_id', SEED, 'o_orderdate')}) * (b - a)) AS BIGINT) AS micros FROM ids, m""",
)
def _(spark, folder):
    df = table(spark, folder, "orders")
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    row = df.agg(F.min(t).alias("a"), F.max(t).alias("b"), F.count("*").alias("n")).first()
    when = S.generate_datetimes(row["a"], row["b"], SEED, "o_orderdate")
    return S.new_rows(spark, row["n"]).select("row_id", F.unix_micros(when).alias("micros"))


@query(
    "gen_independent",
    f"""WITH {ids_sql('customer')}, c AS (SELECT {knots_sql('c_acctbal', 'customer')} AS k), {weights_sql('w', 'SELECT c_mktsegment AS v, count(*) / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1')},
d AS (SELECT row_id, {uniform_sql('row_id', SEED, 'c_acctbal')} AS u, {uniform_sql('row_id', SEED, 'c_mktsegment')} AS v FROM ids)
SELECT row_id, round({curve_sql('k', 'u')}, 4) + 0.0 AS c_acctbal, {pick_sql('v')} AS c_mktsegment FROM d, c, w""",
)
def _(spark, folder):
    df = table(spark, folder, "customer").select("c_acctbal", "c_mktsegment")
    out = S.bootstrap_independent(df, df.count(), SEED)
    return out.withColumn("c_acctbal", rounded(F.col("c_acctbal"), 4))


def probit_sql(p):
    """Acklam's approximation written out for SQL."""
    def poly(x, cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out}) * {x} + ({c!r}::DOUBLE)"
        return out

    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
    q, lo, hi = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return (
        f"CASE WHEN {p} < 0.02425 THEN ({poly(lo, c)}) / ({poly(lo, d)}) WHEN {p} > 0.97575 THEN -(({poly(hi, c)}) / ({poly(hi, d)})) "
        f"ELSE ({poly(f'({q} * {q})', a)}) * {q} / ({poly(f'({q} * {q})', b)}) END"
    )


COPULA = ["l_quantity", "l_extendedprice", "l_net"]


@query(
    "copula_fit",
    f"WITH {LINKED_SQL}, ranked AS (SELECT ship_mode AS label, "
    + ", ".join(
        f"greatest(1e-6, least(1 - 1e-6, (rank() OVER (PARTITION BY ship_mode ORDER BY {c}) + (count(*) OVER (PARTITION BY ship_mode, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY ship_mode))) AS {c}"
        for c in COPULA
    )
    + " FROM linked), z AS (SELECT label, "
    + ", ".join(f"{probit_sql(c)} AS {c}" for c in COPULA)
    + " FROM ranked), g AS ("
    + " UNION ALL ".join(
        f"SELECT label, count(*) AS n, '{a}' AS col_a, '{b}' AS col_b, avg({a}) AS mean_a, avg({b}) AS mean_b, covar_samp({a}, {b}) AS cov FROM z GROUP BY 1"
        for i, a in enumerate(COPULA)
        for b in COPULA[i:]
    )
    + """) SELECT label, n, col_a, col_b, round(mean_a, 6) + 0.0 AS mean_a, round(mean_b, 6) + 0.0 AS mean_b,
  round(CASE WHEN col_a = col_b THEN cov ELSE (1 - least(1.0, 3.0 / greatest(1, n - 4))) * cov END, 6) + 0.0 AS cov FROM g""",
)
def _(spark, folder):
    fit = S.copula_fit(lineitem_linked(spark, folder), COPULA, "ship_mode")
    return fit.select("label", "n", "col_a", "col_b", *[rounded(F.col(c), 6).alias(c) for c in ("mean_a", "mean_b", "cov")])


def copula_rows(spark, folder):
    from veilwork.functions.curves import curve_of

    df = lineitem_linked(spark, folder)
    names = ["l_extendedprice", "l_net"]
    mean, cov = S.copula_matrices(S.copula_fit(df, names), names)["all"]
    curves = {r["column"]: curve_of(r) for r in P.profile_numeric(df, names).collect()}
    return df, S.copula_sample(S.new_rows(spark, df.count()), {c: curves[c] for c in names}, mean, cov, SEED)


@query("gen_copula")
def _(spark, folder):
    return copula_rows(spark, folder)[1]


@query(
    "copula_quality",
    f"""WITH {LINKED_SQL} SELECT count(*) AS rows, 0 AS outside, true AS correlation_kept, true AS marginals_kept FROM linked""",
)
def _(spark, folder):
    df, made = copula_rows(spark, folder)
    names = ["l_extendedprice", "l_net"]
    outside = M.range_adherence(P.constraints(df.select(*names)), made.select(*names)).agg(F.sum("n_oob")).scalar()
    gap = M.correlation_gap(df, made, names).scalar()
    ks = M.ks_statistic(df, made, names).agg(F.max("ks")).scalar()
    return made.agg(F.count("*").alias("rows")).select(
        "rows", outside.alias("outside"), (gap < 0.01).alias("correlation_kept"), (ks < 0.02).alias("marginals_kept")
    )


@query("gen_correlated")
def _(spark, folder):
    from veilwork.operators.association import pearson_pairs

    df = lineitem_linked(spark, folder)
    names, matrix = S.inject_correlation(pearson_pairs(df, LINKED_NUMBERS), LINKED_NUMBERS)
    from veilwork.functions.curves import curve_of

    curves = {r["column"]: curve_of(r) for r in P.profile_numeric(df, names).collect()}
    return S.copula_sample(S.new_rows(spark, df.count()), {c: curves[c] for c in names}, [0.0] * len(names), matrix, SEED)


# ---- encoder

ENCODE_SQL = f"""WITH {LINKED_SQL}, t AS (SELECT avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM linked),
g AS (SELECT price_band AS category, count(*) AS n, avg(l_extendedprice) AS gm FROM linked GROUP BY 1),
rk AS (SELECT ship_mode AS p, row_number() OVER (ORDER BY count(*) DESC, ship_mode) - 1 AS rank FROM linked GROUP BY 1),
c0 AS (SELECT l_linestatus AS v, count(*) AS n, (count(*) + 0.5) / ((SELECT count(*) FROM linked) + 2 * 0.5) AS p FROM linked GROUP BY 1)
SELECT 'price_band' AS "column", 'pb_mean' AS strategy, 'l_extendedprice' AS partner, category,
  round(m + greatest(0, 1 - 1 * v / greatest(1e-10, n * (gm - m) * (gm - m))) * (gm - m), 4) AS code FROM g, t
UNION ALL SELECT 'l_returnflag', 'cramers_weighted', 'ship_mode', l_returnflag, round(avg(rank), 4) FROM linked JOIN rk ON p = ship_mode GROUP BY 4
UNION ALL SELECT 'l_linestatus', 'cumprob', NULL, v, round(sum(p) OVER (ORDER BY n DESC, v) - p / 2, 4) FROM c0"""


def codes_of(spark, folder):
    df = lineitem_linked(spark, folder)
    return df, S.encode_categories(df, ["price_band", "l_returnflag", "l_linestatus", "ship_mode"], ["l_extendedprice", "l_linenumber"])


@query("encode_categories", ENCODE_SQL)
def _(spark, folder):
    _df, codes = codes_of(spark, folder)
    return codes.where("column <> 'ship_mode'").withColumn("code", rounded(F.col("code"), 4))


@query(
    "decode_categories",
    f"WITH {LINKED_SQL} SELECT price_band, price_band AS decoded, count(*) AS n FROM linked GROUP BY 1, 2",
)
def _(spark, folder):
    df, codes = codes_of(spark, folder)
    pairs = [(r["category"], r["code"]) for r in codes.where("column = 'price_band'").collect()]
    coded = S.encode(df, codes, "price_band", "code")
    decoded = coded.withColumn("decoded", S.decode_categories(coded, "code", pairs, None, "price_band"))
    return decoded.groupBy("price_band", "decoded").agg(F.count("*").alias("n"))


@query("decode_softmax")
def _(spark, folder):
    df, codes = codes_of(spark, folder)
    pairs = [(r["category"], r["code"]) for r in codes.where("column = 'price_band'").collect()]
    coded = S.encode(df, codes, "price_band", "code").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    decoded = coded.withColumn("decoded", S.decode_categories(coded, "code", pairs, SEED, "price_band"))
    return decoded.groupBy("price_band", "decoded").agg(F.count("*").alias("n"))


# ---- text and whole tables


@query(
    "gen_text",
    f"""WITH {ids_sql('documents')}, pool AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS slot FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_id, CAST(floor(({uniform_sql('row_id', SEED, 'text/text')}) * (SELECT count(*) FROM pool)) AS BIGINT) AS slot FROM ids)
SELECT row_id, text FROM d JOIN pool USING (slot)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return S.sample_text(S.new_rows(spark, docs.count()), docs, "text", SEED, allow_source_text=True)


def made_table(spark, folder, method="conditional"):
    df = lineitem_linked(spark, folder).drop("l_orderkey")
    return df, S.generate(df, df.count(), SEED, method=method)


@query("generate_table")
def _(spark, folder):
    return made_table(spark, folder)[1]


@query(
    "generate_quality",
    f"WITH {LINKED_SQL} SELECT count(*) AS rows, count(*) AS ids, 0 AS outside, 0 AS invented, 0 AS copies, true AS marginals_kept, true AS tagged FROM linked",
)
def _(spark, folder):
    df, made = made_table(spark, folder)
    plain = made.select(*df.columns)
    limits = P.constraints(df)
    outside = M.range_adherence(limits, plain).agg(F.sum("n_oob")).scalar()
    invented = M.category_adherence(limits, plain).agg(F.sum("n_invented")).scalar()
    copies = M.exact_copy_rate(df, plain).select("copies").scalar()
    worst = M.fidelity(df, plain).agg(F.max("gap")).scalar()
    return made.agg(F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids"), F.min(F.col("_origin") == "generated").alias("tagged")).select(
        "rows", "ids", outside.alias("outside"), invented.alias("invented"), copies.alias("copies"), (worst < 0.05).alias("marginals_kept"), "tagged"
    )


@query(
    "generate_class_means",
    f"""WITH {LINKED_SQL} SELECT m.method, b.price_band AS label, c."column", true AS mean_kept, true AS share_kept
FROM (VALUES ('conditional'), ('copula')) m(method), (SELECT DISTINCT price_band FROM linked) b, (VALUES ('l_extendedprice'), ('l_net')) c("column")""",
)
def _(spark, folder):
    parts = []
    for method in ("conditional", "copula"):
        df, made = made_table(spark, folder, method)
        was, got = (class_summary(t) for t in (df, made))
        both = was.join(got.select("label", "column", F.col("mean").alias("m"), F.col("share").alias("s")), ["label", "column"], "left")
        kept = F.coalesce(F.abs(F.col("m") - F.col("mean")) < 0.1 * F.col("std"), F.lit(False))
        share = F.coalesce(F.abs(F.col("s") - F.col("share")) < 0.03, F.lit(False))
        parts.append(both.select(F.lit(method).alias("method"), "label", "column", kept.alias("mean_kept"), share.alias("share_kept")))
    return parts[0].unionByName(parts[1])


def class_summary(df):
    """(label, column, mean, std, share) of the price bands."""
    counted = df.groupBy(F.col("price_band").alias("label")).agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("l_extendedprice", "l_net")], *[F.stddev_samp(c).alias(f"s_{c}") for c in ("l_extendedprice", "l_net")], F.count("*").alias("n")
    ).where("label IS NOT NULL")
    total = df.agg(F.count("*")).scalar()
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std")) for c in ("l_extendedprice", "l_net")]))
    return counted.select("label", (F.col("n") / total).alias("share"), rows)


@query("generate_copula_table")
def _(spark, folder):
    return made_table(spark, folder, "copula")[1]

