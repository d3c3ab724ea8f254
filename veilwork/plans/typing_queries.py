"""Column typing and role queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions.numeric import rounded
from veilwork.operators import association as A
from veilwork.operators import profile as P
from veilwork.operators import typing as Y
from veilwork.plans.fixtures import LINKED_CATEGORIES, LINKED_NUMBERS, LINKED_SQL, lineitem_linked
from veilwork.plans.profile_queries import cat_num_sql, union_sql
from veilwork.plans.registry import query, table

TEXTS_SQL = """texts AS (SELECT CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_totalprice AS VARCHAR) AS price_text,
  CAST(o_orderdate AS VARCHAR) AS date_text, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS nothing,
  CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS partly_blank,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS answer,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS mostly_number FROM orders)"""

TEXT_COLUMNS = ["key_text", "price_text", "date_text", "priority", "nothing", "partly_blank", "answer", "mostly_number"]


def order_texts(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.cast("string").alias("key_text"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("o_orderdate").cast("string").alias("date_text"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(key % 3 == 1, "").otherwise(F.col("o_custkey").cast("string")).alias("partly_blank"),
        F.when(key % 2 == 0, "Yes").otherwise("no").alias("answer"),
        F.when(key % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("mostly_number"),
    )


@query(
    "infer_dtype",
    f"WITH {TEXTS_SQL}, l AS ("
    + union_sql(TEXT_COLUMNS, "SELECT '{c}' AS \"column\", {c} AS v FROM texts")
    + f"""), s AS (SELECT "column", count(*) FILTER (v <> '') AS f,
  count(*) FILTER (v <> '' AND regexp_matches(v, '{Y.INT_TEXT}')) AS i,
  count(*) FILTER (v <> '' AND regexp_matches(v, '{Y.FLOAT_TEXT}')) AS d,
  count(*) FILTER (v <> '' AND regexp_matches(v, '{Y.DATE_HINT}')) AS t FROM l GROUP BY 1)
SELECT "column", CASE WHEN f = 0 THEN 'null' WHEN i = f THEN 'int' WHEN d = f THEN 'float'
  WHEN t >= greatest(1, f // 2) THEN 'datetime' ELSE 'string' END AS dtype FROM s""",
)
def _(spark, folder):
    return Y.infer_dtype(order_texts(spark, folder))


@query(
    "infer_type_loose",
    f"WITH {TEXTS_SQL}, l AS ("
    + union_sql(TEXT_COLUMNS, "SELECT '{c}' AS \"column\", {c} AS v FROM texts")
    + f"""), s AS (SELECT "column", count(*) FILTER (v <> '') AS f,
  count(*) FILTER (v <> '' AND regexp_matches(v, '{Y.FLOAT_TEXT}')) AS d,
  count(DISTINCT lower(v)) FILTER (v <> '') AS u,
  bool_or(lower(v) IN ('true', 'false', 'yes', 'no', '0', '1')) FILTER (v <> '') AS b FROM l GROUP BY 1)
SELECT "column", CASE WHEN f > 0 AND d / f > 0.85 THEN 'numeric' WHEN u <= 2 AND b THEN 'boolean' ELSE 'categorical' END AS type FROM s""",
)
def _(spark, folder):
    return Y.infer_type_loose(order_texts(spark, folder))


# table, key, columns with their kinds
FACT_TABLES = [
    ("customer", "c_custkey", [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")]),
    ("part", "p_partkey", [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number"), ("p_retailprice", "number")]),
    ("events", "event_id", [("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")]),
    ("documents", "doc_id", [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]),
    ("pages", "page_id", [("page_id", "number"), ("url", "text"), ("html", "text")]),
]

INTEGER_COLUMNS = {"c_custkey", "c_nationkey", "p_partkey", "p_size", "event_id", "user_id", "doc_id", "n_chars", "page_id"}


def _quote(rx):
    return rx.replace("'", "''")


def _fact_sql(t, key, c, kind):
    v = f'CAST("{c}" AS VARCHAR)'
    text = kind == "text"
    share = lambda rx: f"avg(CASE WHEN regexp_matches({v}, '{_quote(rx)}') THEN 1.0 ELSE 0.0 END)" if text else "0.0"
    pats = "[" + ", ".join(share(rx) for _, rx in Y.PATTERN_TEMPLATES) + "]"
    tokens = f"avg(CASE WHEN trim({v}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({v}), '\\s+')) END)" if text else "0.0"
    rising = f'(SELECT bool_and(p IS NULL OR p <= x) FROM (SELECT "{c}" AS x, lag("{c}") OVER (ORDER BY "{key}") AS p FROM {t}))' if kind == "number" else "false"
    return (
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS kind, {str(c in INTEGER_COLUMNS).lower()} AS int_type, "
        f'count(*) AS n_total, count("{c}") AS n_valid, count(DISTINCT {v}) AS d, {tokens} AS mean_tokens, '
        f"{share(Y.FLOAT_TEXT)} AS number_share, {share(Y.DATE_TEXT)} AS date_share, {share(Y.PROPER_NAME)} AS name_share, "
        f"{share(Y.UUID_TEXT)} AS uuid_share, {share(Y.HEX_TEXT)} AS hex_share, {share(Y.EMAIL_SHAPE)} AS email_share, {pats} AS pats, "
        f"{rising} AS rising, " + (f'bool_and("{c}" % 1 = 0)' if kind == "number" else "false") + " AS whole, "
        + (f'CAST(max("{c}") AS DOUBLE)' if kind == "number" else "NULL") + f" AS max_number FROM {t}"
    )


FACTS_SQL = (
    "WITH f0 AS ("
    + " UNION ALL ".join(_fact_sql(t, k, c, kind) for t, k, cols in FACT_TABLES for c, kind in cols)
    + f"""), facts AS (SELECT *, d / n_valid AS ur, regexp_matches("column", '{Y.ID_NAME}')
  OR (kind = 'number' AND rising AND d = n_total AND whole)
  OR (kind <> 'number' AND d / n_valid > 0.95 AND mean_tokens <= 3 AND list_max(pats) <= 0.7 AND name_share <= 0.7) AS is_id,
  CASE WHEN kind = 'number' AND whole THEN 'sequential' WHEN uuid_share > 0.8 THEN 'uuid4' WHEN hex_share > 0.8 THEN 'hash' ELSE 'uuid4' END AS id_kind,
  CASE """
    + " ".join(f"WHEN pats[{i + 1}] > 0.7 THEN '{n}'" for i, (n, _) in enumerate(Y.PATTERN_TEMPLATES))
    + " END AS pattern FROM f0)"
)


def each_table(spark, folder, fn):
    out = None
    for t, key, _ in FACT_TABLES:
        part = fn(Y.column_facts(table(spark, folder, t), key)).withColumn("table", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "numeric_role",
    FACTS_SQL
    + """ SELECT "table", "column", CASE WHEN kind = 'number' AND NOT int_type THEN 'numeric'
  WHEN kind = 'number' THEN CASE WHEN ur > 0.9 THEN 'categorical' ELSE 'numeric' END
  WHEN kind = 'text' AND number_share >= 0.95 AND ur <= 0.9 THEN 'numeric' ELSE 'categorical' END AS role FROM facts""",
)
def _(spark, folder):
    return each_table(spark, folder, Y.numeric_role)


@query(
    "classify_columns",
    FACTS_SQL
    + """, t AS (SELECT *, CASE WHEN "column" = 'p_type' THEN 'HIGH_CARD_CATEGORICAL' WHEN "column" = 'html' THEN 'FREE_TEXT'
  WHEN kind = 'time' OR (kind = 'text' AND date_share >= 0.9) THEN 'DATETIME'
  WHEN is_id THEN 'ID_COLUMN' WHEN kind = 'text' AND ur > 0.7 AND mean_tokens > 3 THEN 'FREE_TEXT'
  WHEN kind = 'text' AND d > 15 AND ur > 0.4 THEN 'HIGH_CARD_CATEGORICAL'
  WHEN kind = 'number' AND d <= 50 AND whole THEN 'DISCRETE_NUMERIC' WHEN kind = 'number' THEN 'CONTINUOUS_NUMERIC'
  ELSE 'LOW_CARD_CATEGORICAL' END AS type FROM facts)
SELECT "table", "column", type, CASE WHEN type = 'HIGH_CARD_CATEGORICAL' THEN pattern END AS pattern,
  CASE WHEN type = 'ID_COLUMN' THEN id_kind END AS id_strategy,
  CASE WHEN type = 'ID_COLUMN' AND id_kind = 'sequential' THEN CAST(max_number AS BIGINT) END AS id_start FROM t""",
)
def _(spark, folder):
    return each_table(
        spark, folder, lambda f: Y.classify_columns(f, {"p_type": "HIGH_CARD_CATEGORICAL"}, excluded=["html"])
    )


@query(
    "id_columns",
    FACTS_SQL + ' SELECT "table", "column", is_id, CASE WHEN is_id THEN id_kind END AS id_strategy FROM facts',
)
def _(spark, folder):
    return each_table(spark, folder, Y.id_columns)


@query("detect_pattern", FACTS_SQL + """ SELECT "table", "column", pattern FROM facts WHERE kind = 'text'""")
def _(spark, folder):
    return each_table(spark, folder, Y.detect_pattern)


def _guess_case(field):
    pick = {"level": lambda lv, sc, why: f"'{lv}'", "score": lambda lv, sc, why: f"CAST({sc} AS DOUBLE)", "reason": lambda lv, sc, why: f"'{why}'"}[field]
    whens = [f"WHEN regexp_matches(\"column\", '{rx}') THEN {pick('high', 0.9, why)}" for rx, why in Y.HIGH_NAME_RULES]
    whens.append(f"WHEN email_share > 0.15 THEN {pick('high', 0.85, 'Email pattern in values')}")
    whens += [f"WHEN regexp_matches(\"column\", '{rx}') THEN {pick('medium', 0.5, why)}" for rx, why in Y.MEDIUM_NAME_RULES]
    return "CASE " + " ".join(whens) + f" ELSE {pick('none', 0.0, '')} END AS {field}"


@query(
    "guess_pii",
    FACTS_SQL + ' SELECT "table", "column", ' + ", ".join(_guess_case(f) for f in ("level", "score", "reason")) + " FROM facts",
)
def _(spark, folder):
    return each_table(spark, folder, Y.guess_pii)


@query(
    "detect_target",
    cat_num_sql(LINKED_CATEGORIES, LINKED_NUMBERS, "linked", LINKED_SQL).replace("SELECT col_a, col_b, round", ", a AS (SELECT col_a, col_b, round")
    + """)
SELECT col_a AS "column", 'classification' AS target_type, round(sum(abs(value)), 4) AS score FROM a
GROUP BY 1 ORDER BY sum(abs(value)) DESC, 1 LIMIT 1""",
)
def _(spark, folder):
    df = lineitem_linked(spark, folder).drop("l_orderkey")
    rows = df.count()
    found = Y.detect_target(
        P.profile_categorical(df),
        P.top_values(df),
        A.pearson_pairs(df, LINKED_NUMBERS),
        A.cat_num_association(df, LINKED_CATEGORIES, LINKED_NUMBERS),
        rows,
        LINKED_NUMBERS,
    )
    return found.withColumn("score", rounded(F.col("score"), 4))
