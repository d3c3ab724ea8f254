"""Scanning, anonymisation and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions import patterns as P
from veilwork.functions.numeric import rounded
from veilwork.operators import anonymize as N
from veilwork.operators import policy as L
from veilwork.operators import scan as S
from veilwork.plans.fixtures import (
    CONTACT_TEXTS,
    CONTACTS_SQL,
    DOCS_SQL,
    TURNS_SQL,
    contacts,
    documents_planted,
    turns_planted,
)
from veilwork.plans.profile_queries import union_sql
from veilwork.plans.registry import query

# RE2 has no look-ahead: the same SSN shapes written out
SSN_AREA = r"(?:00[1-9]|0[1-9]\d|[1-5]\d{2}|6[0-57-9]\d|66[0-57-9]|[78]\d{2})"
SSN_REST = r"(?:0[1-9]|[1-9]\d)", r"(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})"


def ssn_re2(gap):
    return rf"\b{SSN_AREA}{gap}?{SSN_REST[0]}{gap}?{SSN_REST[1]}\b"


def lit(text):
    return "'" + text.replace("'", "''") + "'"


MASK = "CASE WHEN length(v) <= 12 THEN left(v, 6) || '***' ELSE left(v, 6) || '***' || right(v, 3) END"
ENTROPY = "-list_sum([(length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)) for c in list_distinct(string_split(v, ''))])"


def cell_hits(source, entropy=True):
    """CTE ``hits`` (key, column, type, category, preview, confidence, severity) over ``source`` (key, column, v)."""
    parts = []
    for kind, category, rx, severity, _ in P.CELL_PATTERNS:
        if category == "ssn":
            rx = ssn_re2("[- ]")
        cond = f"regexp_matches(v, {lit('(?i)' + rx)})"
        if category == "ssn":
            cond = "lower(\"column\") IN ('ssn', 'social_security', 'social_security_number') AND " + cond
        if category == "passport":
            cond = "contains(lower(\"column\"), 'passport') AND " + cond
        parts.append(
            f"SELECT key, \"column\", '{kind}' AS type, '{category}' AS category, {MASK} AS preview, "
            f"CAST({P.CELL_CONFIDENCE[kind]} AS DOUBLE) AS confidence, '{severity}' AS severity FROM {source} WHERE length(v) >= 3 AND {cond}"
        )
    if entropy:
        parts.append(
            f"SELECT key, \"column\", 'secret', 'high_entropy', left(v, 8) || '***' || right(v, 3), least(1.0, (h - 4.5) / 2.0), "
            f"CASE WHEN h > 5.5 THEN 'high' ELSE 'medium' END FROM (SELECT *, {ENTROPY} AS h FROM {source} WHERE length(v) >= 16) WHERE h >= 4.5"
        )
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


CONTACTS_LONG = f"WITH {CONTACTS_SQL}, l AS (" + union_sql(
    CONTACT_TEXTS + ["c_acctbal"], "SELECT c_custkey AS key, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM contacts"
) + ")"
FOUND = 'SELECT key, "column", type, category, preview, round(confidence, 4) AS confidence, severity FROM hits'
FOUND_COLUMNS = ["key", "column", "type", "category", "preview", "confidence", "severity"]


def shown(findings):
    return findings.select(*[rounded(F.col(c), 4).alias(c) if c == "confidence" else F.col(c) for c in FOUND_COLUMNS])


@query("scan_cells", f"{CONTACTS_LONG}, {cell_hits('l', False)} {FOUND}")
def _(spark, folder):
    return shown(S.scan_cells(contacts(spark, folder), "c_custkey", CONTACT_TEXTS + ["c_acctbal"]))


@query("scan_documents", f"WITH {DOCS_SQL}, l AS (SELECT doc_id AS key, '__text__' AS \"column\", text AS v FROM docs), {cell_hits('l')} {FOUND}")
def _(spark, folder):
    return shown(S.scan_text(documents_planted(spark, folder), "doc_id", "text"))


@query(
    "scan_entropy",
    f"WITH {DOCS_SQL}, l AS (SELECT doc_id AS key, 'text' AS \"column\", text AS v FROM docs), {cell_hits('l')} {FOUND} WHERE category = 'high_entropy'",
)
def _(spark, folder):
    return shown(S.scan_entropy(documents_planted(spark, folder), "doc_id", ["text"]))


@query("mask_value", f"{CONTACTS_LONG} SELECT key, \"column\", {MASK} AS masked FROM l WHERE v IS NOT NULL")
def _(spark, folder):
    from veilwork.operators.frames import melt_text

    df = contacts(spark, folder).withColumnRenamed("c_custkey", "key")
    long = melt_text(df, CONTACT_TEXTS + ["c_acctbal"], ["key"])
    return long.select("key", "column", S.mask_value(F.col("value")).alias("masked"))


@query(
    "scan_names",
    f"""{CONTACTS_LONG}, s AS (SELECT "column", count(DISTINCT v) FILTER (length(v) > 2) AS n FROM l GROUP BY 1)
SELECT "column", 'person_name' AS category, CAST(0.8 AS DOUBLE) AS confidence, 'high' AS severity FROM s
  WHERE ("column" IN ({', '.join(lit(c) for c in P.NAME_COLUMNS)}) OR regexp_matches("column", 'name|person')) AND n > 5
UNION ALL SELECT "column", 'address', CAST(0.75 AS DOUBLE), 'high' FROM s
  WHERE "column" IN ({', '.join(lit(c) for c in P.ADDRESS_COLUMNS)}) OR regexp_matches("column", 'address|street|addr')""",
)
def _(spark, folder):
    df = S.scan_name_columns(contacts(spark, folder), CONTACT_TEXTS + ["c_acctbal"])
    return df.select("column", "category", "confidence", "severity")


WEIGHT = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END"


@query(
    "scan_risk",
    f"""{CONTACTS_LONG}, {cell_hits('l')}, s AS (SELECT count(*) AS findings, count(DISTINCT category) AS categories, sum({WEIGHT} * confidence) AS w,
  (SELECT count(*) * 8 FROM contacts) AS cells FROM hits)
SELECT findings, categories, cells, round(least(100.0, greatest(0.0, w * 2 + least(1.0, findings / greatest(cells, 1) * 100) * 30
  + least(1.0, categories / 5) * 20)), 4) AS risk_score FROM s""",
)
def _(spark, folder):
    df = contacts(spark, folder)
    columns = CONTACT_TEXTS + ["c_acctbal"]
    cells = df.agg(F.count("*") * len(columns)).scalar()
    out = S.scan_risk_score(S.scan_cells(df, "c_custkey", columns, entropy=True), cells)
    return out.withColumn("risk_score", rounded(F.col("risk_score"), 4))


@query(
    "high_risk_columns",
    f'{CONTACTS_LONG}, {cell_hits("l")} SELECT "column", count(*) AS findings FROM hits GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10',
)
def _(spark, folder):
    return S.high_risk_columns(S.scan_cells(contacts(spark, folder), "c_custkey", CONTACT_TEXTS + ["c_acctbal"], entropy=True))


PII_COLUMNS = CONTACT_TEXTS + ["c_mktsegment", "c_acctbal"]


def pii_sql():
    long = union_sql(PII_COLUMNS, "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM contacts")
    hits = ", ".join(f"count(*) FILTER (length(v) >= 3 AND regexp_matches(v, {lit('(?i)' + rx)})) AS h{i}" for i, (_, rx, _) in enumerate(P.COLUMN_PATTERNS))
    parts = [
        f"SELECT \"column\", '{c}' AS category, '{s}' AS severity, round(least(1.0, 0.5 + h{i} / n * 3.0), 2) AS confidence, 'regex' AS method, h{i} AS sample_count FROM s WHERE h{i} > 0"
        for i, (c, _, s) in enumerate(P.COLUMN_PATTERNS)
    ]
    parts.append("SELECT \"column\", 'high_entropy_token', 'high', least(1.0, 0.4 + odd / n), 'entropy', odd FROM s WHERE n > 0 AND odd >= greatest(1, n // 20)")
    parts.append("SELECT \"column\", 'quasi_identifier', 'high', CAST(0.85 AS DOUBLE), 'uniqueness_ratio', -1 FROM s WHERE n > 0 AND d / r > 0.95 AND r > 5")
    for c in PII_COLUMNS:
        category = S.hint_category(c)
        if category:
            parts.append(f"SELECT '{c}', '{category}', '{S.hint_severity(category)}', CAST(0.75 AS DOUBLE), 'column_name', -1")
    return f"""WITH {CONTACTS_SQL}, l AS ({long}), e AS (SELECT *, CASE WHEN length(v) >= 16 THEN {ENTROPY} END AS h FROM l),
s AS (SELECT "column", count(*) AS r, count(v) AS n, count(DISTINCT v) AS d, count(*) FILTER (h >= 4.5) AS odd, {hits} FROM e GROUP BY 1),
found AS ({' UNION ALL '.join(parts)})"""


@query("pii_columns", pii_sql() + ' SELECT "column", category, severity, round(confidence, 4) AS confidence, method, sample_count FROM found')
def _(spark, folder):
    df = S.detect_pii_columns(contacts(spark, folder), PII_COLUMNS)
    return df.withColumn("confidence", rounded(F.col("confidence"), 4))


@query(
    "pii_summary",
    pii_sql()
    + """, c AS (SELECT sum(n) AS cells FROM s)
SELECT count(*) AS findings, count(DISTINCT "column") AS pii_columns, round(count(*) / (SELECT cells FROM c), 6) AS pii_density,
  CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS pii_risk FROM found""",
)
def _(spark, folder):
    df = contacts(spark, folder)
    cells = df.agg(sum((F.count(c) for c in PII_COLUMNS), F.lit(0))).scalar()
    return S.pii_summary(S.detect_pii_columns(df, PII_COLUMNS), cells)


# ---- prompts

PROMPT_PARTS = [
    f"SELECT conv_id, turn, {lit(name)} AS name, '{kind}' AS type, '{category}' AS category, '{severity}' AS severity, "
    f"len(regexp_extract_all(text, {lit(('(?i)' if fold else '') + rx)})) AS n FROM turns"
    for name, rx, fold, kind, category, severity, _ in P.PROMPT_PATTERNS
]
WORDS = "[" + ", ".join(lit(w) for w in P.COMMON_WORDS) + "]"
PROMPT_PARTS.append(
    f"SELECT conv_id, turn, 'Person Name', 'pii', 'person_name', 'high', "
    f"len([p for p in list_zip(regexp_extract_all(text, {lit(P.PERSON_NAME)}, 1), regexp_extract_all(text, {lit(P.PERSON_NAME)}, 2)) "
    f"if NOT list_contains({WORDS}, p[1]) AND NOT list_contains({WORDS}, p[2])]) FROM turns"
)
PROMPT_SQL = f"WITH {TURNS_SQL}, p AS (" + " UNION ALL ".join(PROMPT_PARTS) + ")"


@query("prompt_counts", PROMPT_SQL + " SELECT * FROM p WHERE n > 0")
def _(spark, folder):
    return S.prompt_counts(turns_planted(spark, folder), "text", ["conv_id", "turn"])


# places by the lengths between marks, numbers by windows, the overlap rule as a recursion from match to match
PROMPT_RULES = [(("(?i)" if fold else "") + rx, kind, category, severity, form) for _, rx, fold, kind, category, severity, form in P.PROMPT_PATTERNS]
PROMPT_RULES.append((P.PERSON_NAME, "pii", "person_name", "high", "PERSON_{i:03d}"))
SPAN_PARTS = [
    f"SELECT id, {k} AS rule, string_split(regexp_replace(text, {lit(rx)}, chr(1) || '\\0', 'g'), chr(1)) AS pieces, regexp_extract_all(text, {lit(rx)}) AS found FROM texts"
    for k, (rx, *_) in enumerate(PROMPT_RULES)
]
RULE_ROWS = ", ".join(f"({k}, {', '.join(lit(v) for v in facts)})" for k, (_, *facts) in enumerate(PROMPT_RULES))
PEOPLE = len(PROMPT_RULES) - 1
SPANS_SQL = (
    f"WITH RECURSIVE {TURNS_SQL}, texts AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(text, '') AS text FROM turns), "
    f"rules(rule, type, category, severity, form) AS (VALUES {RULE_ROWS}), matches AS (" + " UNION ALL ".join(SPAN_PARTS) + ")"
    + f""", placed AS (SELECT id, rule, i, CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) AS BIGINT) AS spot, found[i] AS m FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id, rule = {PEOPLE} ORDER BY rule, i) AS number FROM placed
  WHERE rule <> {PEOPLE} OR (NOT list_contains({WORDS}, regexp_extract(m, {lit(P.PERSON_NAME)}, 1)) AND NOT list_contains({WORDS}, regexp_extract(m, {lit(P.PERSON_NAME)}, 2)))),
ordered AS (SELECT id, rule, m, spot, spot + length(m) AS upto, row_number() OVER (PARTITION BY id ORDER BY spot, rule) AS k,
  replace(replace(form, '{{i:03d}}', printf('%03d', number)), '{{match}}', upper(m)) AS suggestion, type, category, severity FROM numbered JOIN rules USING (rule)),
fold AS (SELECT id, k, upto AS last, true AS kept FROM ordered WHERE k = 1
  UNION ALL SELECT o.id, o.k, CASE WHEN o.spot >= f.last THEN o.upto ELSE f.last END, o.spot >= f.last FROM fold f JOIN ordered o ON o.id = f.id AND o.k = f.k + 1),
spans AS (SELECT o.*, f.kept FROM ordered o JOIN fold f USING (id, k)),
cut AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY id ORDER BY spot) AS before FROM spans WHERE kept),
redacted AS (SELECT t.conv_id, t.turn, coalesce(string_agg(substr(t.text, before + 1, spot - before) || suggestion, '' ORDER BY spot), '') || substr(any_value(t.text), coalesce(max(upto), 0) + 1) AS redacted,
  CAST(count(spot) AS INTEGER) AS items, coalesce(bool_or(severity = 'critical'), false) AS has_critical, coalesce(bool_or(severity = 'high'), false) AS has_high,
  CASE WHEN bool_or(severity = 'critical') THEN 'dangerous' WHEN count(spot) > 0 THEN 'warning' ELSE 'safe' END AS risk
  FROM texts t LEFT JOIN cut c USING (id) GROUP BY id, t.conv_id, t.turn)"""
)


@query(
    "scan_prompts",
    SPANS_SQL
    + """ SELECT conv_id, turn, type, category, severity, m AS "match", CAST(spot AS INTEGER) AS "start", CAST(upto AS INTEGER) AS "end", suggestion, kept FROM spans JOIN texts USING (id)""",
)
def _(spark, folder):
    return S.scan_prompts(turns_planted(spark, folder), "text", ["conv_id", "turn"])


@query("redact_prompts", SPANS_SQL + " SELECT * FROM redacted")
def _(spark, folder):
    return S.redact_prompts(turns_planted(spark, folder), "text", ["conv_id", "turn"])


@query(
    "prompt_decision",
    PROMPT_SQL
    + """, s AS (SELECT t.conv_id, t.turn, coalesce(bool_or(p.severity = 'critical'), false) AS c, coalesce(bool_or(p.severity = 'high'), false) AS h,
  coalesce(sum(p.n), 0) AS items FROM turns t LEFT JOIN (SELECT * FROM p WHERE n > 0) p ON t.conv_id = p.conv_id AND t.turn = p.turn GROUP BY 1, 2)
SELECT conv_id, turn, CAST(items AS BIGINT) AS items, CASE WHEN c THEN 'block' WHEN h OR items > 0 THEN 'warn' ELSE 'none' END AS decision FROM s""",
)
def _(spark, folder):
    turns = turns_planted(spark, folder)
    keys = ["conv_id", "turn"]
    found = S.prompt_counts(turns, "text", keys).groupBy(*keys).agg(
        F.max(F.col("severity") == "critical").alias("c"), F.max(F.col("severity") == "high").alias("h"), F.sum("n").alias("items")
    )
    joined = turns.select(*keys).join(found, keys, "left")
    items = F.coalesce("items", F.lit(0))
    decision = L.prompt_decision(F.coalesce("c", F.lit(False)), F.coalesce("h", F.lit(False)), items)
    return joined.select(*keys, items.alias("items"), decision.alias("decision"))


# ---- source text

NEWLINES = "length({0}) - length(replace({0}, chr(10), ''))"


def line_sql(source, key):
    parts = []
    for name, rx, category, severity, _ in P.LINE_PATTERNS:
        if name == "SSN Pattern":
            rx = ssn_re2(r"[-\s]")
        whole = f"regexp_replace(text, {lit('(' + rx + ')' if not rx.startswith('(?i)') else '(?i)(' + rx[4:] + ')')}, chr(1) || '\\1' || chr(2), 'g')"
        parts.append(
            f"SELECT {key} AS key, '{name}' AS pattern, '{category}' AS category, '{severity}' AS severity, unnest(string_split({whole}, chr(1))[:-2]) AS before, "
            f"unnest([string_split(s, chr(2))[1] for s in string_split({whole}, chr(1))[2:]]) AS m, generate_subscripts(string_split({whole}, chr(1))[2:], 1) AS i "
            f"FROM {source} WHERE regexp_matches(text, {lit(rx)})"
        )
    nl = lambda s: NEWLINES.format(s)
    return (
        "raw AS (" + " UNION ALL ".join(parts) + "), placed AS (SELECT *, CAST(1 + sum(" + nl("before") + ") OVER (PARTITION BY key, pattern ORDER BY i) AS INTEGER) AS line FROM raw)"
    )


@query(
    "scan_lines",
    f"WITH {DOCS_SQL}, {line_sql('docs', 'doc_id')} SELECT key, line, pattern, category, severity, left(m, 80) AS snippet FROM placed",
)
def _(spark, folder):
    df = S.scan_lines(documents_planted(spark, folder), "text", "doc_id")
    return df.select("key", "line", "pattern", "category", "severity", "snippet")


@query(
    "pattern_decision",
    f"WITH {DOCS_SQL}, {line_sql('docs', 'doc_id')}, names(pattern, rule) AS (VALUES "
    + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in P.PATTERN_RULE)
    + "), rules(rule, action, sev) AS (VALUES "
    + ", ".join(f"({lit(r)}, {lit(a)}, {lit(s)})" for r, e, a, s in P.LIVE_RULES if e and r != "warn_on_jwt")
    + """) SELECT key, line, pattern, rules.rule, action, sev AS policy_severity FROM placed
LEFT JOIN (names JOIN rules USING (rule)) USING (pattern)""",
)
def _(spark, folder):
    rules = L.live_rules(spark, {"warn_on_jwt": {"enabled": False}})
    hits = S.scan_lines(documents_planted(spark, folder), "text", "doc_id")
    return L.pattern_decision(hits, rules).select("key", "line", "pattern", "rule", "action", "policy_severity")


HEADER_SQL = (
    f"WITH {DOCS_SQL}, h AS (SELECT doc_id, source, "
    + " + ".join(f"CAST(regexp_matches(lower(text), {lit(rx)}) AS INTEGER)" for rx in P.HEADER_WORDS)
    + " AS signals FROM docs), d AS (SELECT *, signals / 16 AS pii_density, CAST(least(100, signals * 8) AS DOUBLE) AS risk FROM h)"
)


@query(
    "header_signal",
    HEADER_SQL
    + " SELECT doc_id, signals, pii_density, risk, CASE WHEN risk >= 70 THEN 'HIGH' WHEN risk >= 40 THEN 'MODERATE' ELSE 'LOW' END AS label FROM d",
)
def _(spark, folder):
    return S.header_signal(documents_planted(spark, folder), "text", ["doc_id"])


@query(
    "dataset_decision",
    HEADER_SQL
    + " SELECT doc_id, CASE WHEN pii_density >= 0.7 THEN 'block' WHEN pii_density >= 0.4 OR risk >= 60 THEN 'warn' ELSE 'none' END AS decision FROM d",
)
def _(spark, folder):
    df = S.header_signal(documents_planted(spark, folder), "text", ["doc_id"])
    return df.select("doc_id", L.dataset_decision(F.col("pii_density"), F.col("risk")).alias("decision"))


RULE_ROWS = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in P.FINDING_RULES)
VIOLATIONS = f"""{CONTACTS_LONG}, {cell_hits('l')}, rules(rule, type, category, severity, action, description) AS (VALUES {RULE_ROWS}),
c AS (SELECT type, category, count(*) AS instances, min("column") AS "column" FROM hits GROUP BY 1, 2),
v AS (SELECT rule, rules.severity, action, instances, "column", description || ': ' || instances || ' instance(s) found' AS message FROM c JOIN rules USING (type, category))"""


@query("apply_policy", VIOLATIONS + " SELECT * FROM v")
def _(spark, folder):
    findings = S.scan_cells(contacts(spark, folder), "c_custkey", CONTACT_TEXTS + ["c_acctbal"], entropy=True)
    return L.apply_policy(findings)


@query(
    "risk_threshold",
    VIOLATIONS
    + f""", s AS (SELECT count(*) AS findings, count(DISTINCT category) AS categories, sum({WEIGHT} * confidence) AS w, (SELECT count(*) * 8 FROM contacts) AS cells FROM hits),
r AS (SELECT least(100.0, w * 2 + least(1.0, findings / cells * 100) * 30 + least(1.0, categories / 5) * 20) AS score FROM s),
allv AS (SELECT rule, action FROM v UNION ALL SELECT 'risk_score_threshold', 'block' FROM r WHERE score > 50)
SELECT count(*) AS violations, CASE max(CASE action WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'pass' END AS action FROM allv""",
)
def _(spark, folder):
    df = contacts(spark, folder)
    columns = CONTACT_TEXTS + ["c_acctbal"]
    findings = S.scan_cells(df, "c_custkey", columns, entropy=True)
    score = S.scan_risk_score(findings, df.agg(F.count("*") * len(columns)).scalar())
    return L.policy_action(L.risk_threshold(L.apply_policy(findings), score))


# ---- anonymisation

NAME_SQL = "code AS (SELECT n, 'PERSON_' || CASE WHEN r < 1000 THEN lpad(CAST(r AS VARCHAR), 3, '0') ELSE CAST(r AS VARCHAR) END AS p FROM (SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT DISTINCT trim({0}) AS n FROM {1} WHERE trim({0}) <> '')))"
EMAIL_SQL = "CASE WHEN trim({0}) = '' THEN trim({0}) ELSE 'EMAIL_' || left(sha256(trim({0})), 8) || '@anon.local' END"
PHONE_SQL = "CASE WHEN {0} IS NULL THEN NULL WHEN length(regexp_replace(trim({0}), '\\D', '', 'g')) >= 4 THEN '***-***-' || right(regexp_replace(trim({0}), '\\D', '', 'g'), 4) ELSE '***-REDACTED' END"
SSN_SQL = "CASE WHEN {0} IS NOT NULL THEN '***-**-****' END"
STREET = "regexp_replace(regexp_replace(trim({0}), '^\\d+\\s+', ''), '(?i)\\b(?:apt|suite|unit|#)\\s*\\d+\\w*', '[UNIT]', 'g')"
ADDRESS_SQL = f"CASE WHEN {STREET} = '' THEN '[REDACTED]' ELSE {STREET} END"


def text_sql(column):
    out = column
    for rx, mark in N.TEXT_RULES:
        out = f"regexp_replace({out}, {lit(rx)}, {lit(mark)}, 'g')"
    return out


@query("anon_names", f"WITH {CONTACTS_SQL}, {NAME_SQL.format('c_mktsegment', 'contacts')} SELECT c_custkey, p AS c_mktsegment FROM contacts JOIN code ON n = trim(c_mktsegment)")
def _(spark, folder):
    return N.anon_names(contacts(spark, folder).select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("anon_emails", f"WITH {CONTACTS_SQL} SELECT c_custkey, {EMAIL_SQL.format('email')} AS email FROM contacts")
def _(spark, folder):
    return contacts(spark, folder).select("c_custkey", N.anon_email(F.col("email")).alias("email"))


@query("anon_phones", f"WITH {CONTACTS_SQL} SELECT c_custkey, {PHONE_SQL.format('phone')} AS phone FROM contacts")
def _(spark, folder):
    return contacts(spark, folder).select("c_custkey", N.anon_phone(F.col("phone")).alias("phone"))


@query("anon_ssn", f"WITH {CONTACTS_SQL} SELECT c_custkey, {SSN_SQL.format('ssn')} AS ssn FROM contacts")
def _(spark, folder):
    return contacts(spark, folder).select("c_custkey", N.anon_ssn(F.col("ssn")).alias("ssn"))


@query("anon_address", f"WITH {CONTACTS_SQL} SELECT c_custkey, {ADDRESS_SQL.format('home_address')} AS home_address FROM contacts")
def _(spark, folder):
    return contacts(spark, folder).select("c_custkey", N.anon_address(F.col("home_address")).alias("home_address"))


@query("anon_text", f"WITH {DOCS_SQL} SELECT doc_id, {text_sql('text')} AS text FROM docs")
def _(spark, folder):
    return documents_planted(spark, folder).select("doc_id", N.anon_text(F.col("text")).alias("text"))


@query(
    "anonymize_customer",
    f"""WITH {CONTACTS_SQL}, {NAME_SQL.format('customer_name', 'contacts')}
SELECT c_custkey, p AS customer_name, {EMAIL_SQL.format('email')} AS email, {PHONE_SQL.format('phone')} AS phone, {SSN_SQL.format('ssn')} AS ssn,
  {ADDRESS_SQL.format('home_address')} AS home_address, passport_no, {text_sql('notes')} AS notes, c_mktsegment, c_acctbal
FROM contacts LEFT JOIN code ON n = trim(customer_name)""",
)
def _(spark, folder):
    out, _report = N.anonymize(contacts(spark, folder), ["customer_name", "email", "phone", "ssn", "home_address", "notes"])
    return out


@query(
    "anonymize_report",
    f"WITH {CONTACTS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{s}' AS strategy, count({c}) AS cells FROM contacts"
        for c, s in [("customer_name", "pseudonymization"), ("email", "hash_replacement"), ("phone", "masking"), ("ssn", "redaction"), ("home_address", "generalization")]
    ),
)
def _(spark, folder):
    return N.anonymize(contacts(spark, folder))[1]
