"""Tables derived from the whole test tables, each as a DataFrame and as the same SQL.

``release`` stands for a perturbed copy of a table handed out to others; every row of the source is in it. Some
rows come out unchanged, so copy rates and distances are not trivial. ``holes`` adds nulls, which the source
tables lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.plans.registry import table

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]

ORDERS_SQL = """orig AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders)"""

RELEASE_SQL = """synth AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice
         ELSE o_totalprice * (80 + (o_orderkey % 7) * 5) / 100 END AS o_totalprice,
    CASE WHEN o_orderkey % 20 <> 0 AND o_orderkey % 9 = 0 THEN 'F'
         WHEN o_orderkey % 311 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 20 <> 0 AND o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

PAIR_SQL = f"WITH {ORDERS_SQL}, {RELEASE_SQL}"


def orders_original(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(*ORDER_COLUMNS)


def orders_release(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    kept = key % 20 == 0
    return o.select(
        "o_orderkey",
        "o_custkey",
        F.when(kept, F.col("o_totalprice"))
        .otherwise(F.col("o_totalprice") * (F.lit(80) + (key % 7) * 5) / 100)
        .alias("o_totalprice"),
        F.when(~kept & (key % 9 == 0), "F").when(key % 311 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(~kept & (key % 5 == 0), "1-URGENT").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )


HOLES_SQL = """holes AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 10 = 3 OR o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 <> 1 THEN NULL ELSE o_custkey END AS o_custkey
  FROM orders)"""


def orders_holes(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(key % 10 != 3, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 3 != 1, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when((key % 10 != 3) & (key % 4 != 0), F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 3 == 1, F.col("o_custkey")).alias("o_custkey"),
    )


# lineitem with discounts and taxes as whole percents and a price strongly tied to another one
WIDE_SQL = """wide AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    l_extendedprice * 0.8 + 100 * l_quantity AS l_net, l_discount, l_tax,
    CAST(round(l_discount * 100) AS INTEGER) AS discount_pct, l_returnflag, l_linestatus
  FROM lineitem)"""

WIDE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_net", "l_discount", "l_tax", "discount_pct"]


def lineitem_wide(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        (F.col("l_extendedprice") * 0.8 + 100 * F.col("l_quantity")).alias("l_net"),
        "l_discount",
        "l_tax",
        F.round(F.col("l_discount") * 100).cast("int").alias("discount_pct"),
        "l_returnflag",
        "l_linestatus",
    )


# lineitem with two derived categories that depend on a flag, a quantity and a price
LINKED_SQL = """linked AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_extendedprice * 0.8 + 100 * l_quantity AS l_net,
    l_returnflag, l_linestatus,
    CASE WHEN l_returnflag = 'A' AND l_linenumber < 6 THEN 'AIR' WHEN l_quantity > 25 THEN 'RAIL' ELSE 'SHIP' END AS ship_mode,
    CASE WHEN l_extendedprice < 30000 THEN 'low' WHEN l_extendedprice < 60000 THEN 'mid' ELSE 'high' END AS price_band
  FROM lineitem)"""

LINKED_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_net"]
LINKED_CATEGORIES = ["l_returnflag", "l_linestatus", "ship_mode", "price_band"]


def lineitem_linked(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        (price * 0.8 + 100 * F.col("l_quantity")).alias("l_net"),
        "l_returnflag",
        "l_linestatus",
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") < 6), "AIR")
        .when(F.col("l_quantity") > 25, "RAIL")
        .otherwise("SHIP")
        .alias("ship_mode"),
        F.when(price < 30000, "low").when(price < 60000, "mid").otherwise("high").alias("price_band"),
    )


# customers with contact fields of every sensitive kind; some cells are null
CONTACTS_SQL = """contacts AS (
  SELECT c_custkey, c_name AS customer_name,
    CASE WHEN c_custkey % 7 <> 0 THEN 'user' || c_custkey || '@mail' || c_nationkey || '.com' END AS email,
    CASE WHEN c_custkey % 11 = 0 THEN 'ext 12' ELSE '+1 (555) ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS phone,
    lpad(CAST(c_custkey * 7 % 900 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn,
    c_custkey || ' Main Street Apt ' || c_nationkey || CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE 'B' END AS home_address,
    'P' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS passport_no,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'call 555-123-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' or write a.b' || c_custkey || '@x.org'
      WHEN c_custkey % 5 = 2 THEN 'card 4111 1111 1111 1111, ssn 123-45-6789' WHEN c_custkey % 5 = 3 THEN 'paid in ' || c_mktsegment ELSE 'host 10.0.' || c_nationkey || '.' || (c_custkey % 256) END AS notes,
    c_mktsegment, c_acctbal FROM customer)"""

CONTACT_TEXTS = ["customer_name", "email", "phone", "ssn", "home_address", "passport_no", "notes"]


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    pick = F.expr
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_name").alias("customer_name"),
        pick("CASE WHEN c_custkey % 7 <> 0 THEN concat('user', c_custkey, '@mail', c_nationkey, '.com') END").alias("email"),
        pick(
            "CASE WHEN c_custkey % 11 = 0 THEN 'ext 12' ELSE concat('+1 (555) ', lpad(c_custkey % 1000, 3, '0'), '-', lpad(c_custkey % 10000, 4, '0')) END"
        ).alias("phone"),
        pick("concat(lpad(c_custkey * 7 % 900, 3, '0'), '-', lpad(c_custkey % 100, 2, '0'), '-', lpad(c_custkey % 10000, 4, '0'))").alias("ssn"),
        pick("concat(c_custkey, ' Main Street Apt ', c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE 'B' END)").alias("home_address"),
        pick("concat('P', lpad(c_custkey, 7, '0'))").alias("passport_no"),
        pick(
            "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN concat('call 555-123-', lpad(c_custkey % 10000, 4, '0'), ' or write a.b', c_custkey, '@x.org')"
            " WHEN c_custkey % 5 = 2 THEN 'card 4111 1111 1111 1111, ssn 123-45-6789' WHEN c_custkey % 5 = 3 THEN concat('paid in ', c_mktsegment)"
            " ELSE concat('host 10.0.', c_nationkey, '.', c_custkey % 256) END"
        ).alias("notes"),
        "c_mktsegment",
        "c_acctbal",
    )


# made-up secrets and personal data appended to texts by key; every text of the table is kept whole
PLANTS = [
    "",
    "token sk-" + "A1b2C3d4E5" * 3,
    "ghp_" + "abcdefghij0123456789" * 2,
    "aws AKIA" + "ABCDEFGHIJKLMNOP",
    'api_key = "' + "k3y_" * 6 + '"',
    'password =\n  "s3cret-value"',
    "Authorization: Bearer " + "abc.DEF-123_" * 3,
    "eyJ" + "hbGciOiJI" * 2 + "." + "eyJzdWIiOi" * 2 + "." + "SflKxwRJSM" * 2,
    "-----BEGIN RSA PRIVATE KEY-----",
    "postgres://svc:pw@db.example.net:5432/app",
    "born: 12/05/1980 and ssn 123-45-6789",
    "Patient ID: AB-12345 diagnosed with seasonal flu",
    "gsk_" + "Z9y8X7w6V5" * 6,
    'MISTRAL_API_KEY = "' + "m1S2t3R4a5" * 4 + '"',
    "mail john.doe@example.org\nor jane.roe@example.org, mail john.doe@example.org",
    "card 4111 1111 1111 1111 and 5500-0000-0000-0004",
    "ICD-10 E11.9, prescription: metformin daily",
    "This is top secret and Internal Only, seen by John Smith and Data Team",
    "date of birth, medical, passport, address, phone, email, ssn, password, dob, diagnosis, prescription, credit card",
]


def _planted_sql(name: str, table_name: str, key: str, columns: str) -> str:
    cases = " ".join(f"WHEN {i} THEN chr(10) || '" + p.replace("'", "''") + "' || chr(10)" for i, p in enumerate(PLANTS) if p)
    return f"{name} AS (SELECT {columns}, text || CASE {key} % {len(PLANTS)} {cases} ELSE '' END AS text FROM {table_name})"


def _planted(df: DataFrame, key: str) -> DataFrame:
    extra = F.lit("")
    for i, p in enumerate(PLANTS):
        if p:
            extra = F.when(F.col(key) % len(PLANTS) == i, "\n" + p + "\n").otherwise(extra)
    return df.withColumn("text", F.concat("text", extra))


DOCS_SQL = _planted_sql("docs", "documents", "doc_id", "doc_id, lang, source, n_chars")
TURNS_SQL = _planted_sql("turns", "conversations", "(conv_id + turn)", "conv_id, turn, role")


def documents_planted(spark: SparkSession, folder: str) -> DataFrame:
    return _planted(table(spark, folder, "documents"), "doc_id").select("doc_id", "lang", "source", "n_chars", "text")


def turns_planted(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "conversations").withColumn("_k", F.col("conv_id") + F.col("turn"))
    return _planted(df, "_k").select("conv_id", "turn", "role", "text")


# one row of run metrics per order month, from the orders and their release
RUNS_SQL = """runs AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.35::DOUBLE + 0.04::DOUBLE * m)) AS membership_inference_auc, 0.02::DOUBLE * m AS avg_drift,
  CASE WHEN m % 4 = 0 THEN f ELSE 1 - f END AS acceptance_rate, CASE WHEN m % 6 = 5 THEN f + 0.05 WHEN m % 4 = 0 THEN 1 - f ELSE f END AS rejection_rate
FROM (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, CAST(month(min(o_orderdate)) AS INTEGER) AS m, count(*) AS n_rows,
  round(avg(CASE WHEN o_orderkey % 20 = 0 THEN 1.0 ELSE 0.0 END) * (month(min(o_orderdate)) % 5), 6) AS duplicates_rate,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS f,
  round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) AS pii_density,
  round(max(o_totalprice) / 500000, 6) AS max_reid FROM orders GROUP BY 1))"""


def order_runs(spark: SparkSession, folder: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    base = (
        table(spark, folder, "orders")
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run_id"))
        .agg(
            F.month(F.min("o_orderdate")).alias("m"),
            F.count("*").alias("n_rows"),
            F.round(share(F.col("o_orderkey") % 20 == 0) * (F.month(F.min("o_orderdate")) % 5), 6).alias("duplicates_rate"),
            F.round(share(F.col("o_orderstatus") == "F"), 6).alias("f"),
            F.round(share(F.col("o_orderpriority") == "1-URGENT"), 6).alias("pii_density"),
            F.round(F.max("o_totalprice") / 500000, 6).alias("max_reid"),
        )
    )
    m, f = F.col("m"), F.col("f")
    return base.select(
        "*",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.35) + 0.04 * m)).alias("membership_inference_auc"),
        (0.02 * m).alias("avg_drift"),
        F.when(m % 4 == 0, f).otherwise(1 - f).alias("acceptance_rate"),
        F.when(m % 6 == 5, f + 0.05).when(m % 4 == 0, 1 - f).otherwise(f).alias("rejection_rate"),
    )
