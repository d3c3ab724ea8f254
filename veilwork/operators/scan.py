"""Sensitive-data scans of tables and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import patterns as P
from veilwork.functions.numeric import entropy_bits
from veilwork.operators.frames import column_rows, distinct_counts, melt_text, text_cell, value_counts

FINDING = "key {key}, type string, category string, column string, preview string, confidence double, severity string, description string"


def mask_value(value: Column) -> Column:
    """First six characters and ``***``; the last three as well when longer than twelve."""
    head = F.concat(F.substring(value, 1, 6), F.lit("***"))
    return F.when(F.length(value) <= 12, head).otherwise(F.concat(head, F.right(value, F.lit(3))))


def _finding(kind, category, column, preview, confidence, severity, description):
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(category).alias("category"),
        column.alias("column"),
        preview.alias("preview"),
        confidence.alias("confidence"),
        severity.alias("severity"),
        description.alias("description"),
    )


def _pattern_hits(column: Column, value: Column) -> list[Column]:
    low = F.lower(column)
    out = []
    for kind, category, rx, severity, text in P.CELL_PATTERNS:
        hit = value.rlike("(?i)" + rx)
        if category == "ssn":
            hit = low.isin(P.SSN_COLUMNS) & hit
        elif category == "passport":
            hit = F.contains(low, F.lit("passport")) & hit
        found = _finding(kind, category, column, mask_value(value), F.lit(P.CELL_CONFIDENCE[kind]), F.lit(severity), F.lit(text))
        out.append(F.when(hit, found))
    return out


def _entropy_hit(column: Column, value: Column, h: Column) -> Column:
    preview = F.concat(F.substring(value, 1, 8), F.lit("***"), F.right(value, F.lit(3)))
    found = _finding(
        "secret",
        "high_entropy",
        column,
        preview,
        F.least(F.lit(1.0), (h - P.ENTROPY_BITS) / 2.0),
        F.when(h > 5.5, "high").otherwise("medium"),
        F.lit("High entropy string detected. May be a secret or token."),
    )
    return F.when(h >= P.ENTROPY_BITS, found)


def _scan_long(long: DataFrame, regex: bool = True, entropy: bool = True) -> DataFrame:
    column, value = F.col("column"), F.col("value")
    if entropy:
        # a column of its own: the finding reads it several times
        long = long.withColumn("_bits", F.when(F.length("value") >= P.ENTROPY_LENGTH, entropy_bits(value)))
    hits = (_pattern_hits(column, value) if regex else []) + ([_entropy_hit(column, value, F.col("_bits"))] if entropy else [])
    found = long.where(F.length("value") >= 3).select("key", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return found.select("key", "f.*")


def scan_cells(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, max_rows: int | None = None, entropy: bool = False
) -> DataFrame:
    """Every cell against 22 patterns; one finding per cell and category.

    All rows are scanned; ``max_rows`` keeps the first rows in key order for callers that want the bounded form.
    """
    names = list(columns or [c for c in df.columns if c != key])
    if max_rows is not None:
        df = df.orderBy(key).limit(max_rows)
    keyed = df.withColumn("key", F.col(key))
    return _scan_long(melt_text(keyed, names, ["key"]), entropy=entropy)


def scan_entropy(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells of at least 16 characters whose Shannon entropy reaches 4.5 bits per character."""
    names = list(columns or [c for c in df.columns if c != key])
    return _scan_long(melt_text(df.withColumn("key", F.col(key)), names, ["key"]), regex=False)


def scan_text(df: DataFrame, key: str, text: str, entropy: bool = True) -> DataFrame:
    """Patterns and entropy over whole texts, under the column name ``__text__``."""
    long = df.select(F.col(key).alias("key"), F.lit("__text__").alias("column"), F.col(text).alias("value"))
    return _scan_long(long.where(F.col("value").isNotNull()), entropy=entropy)


def scan_name_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column-level findings for person names (more than five distinct longer values) and addresses."""
    names = list(columns or df.columns)
    counts = value_counts(melt_text(df, names)).where(F.length("value") > 2).groupBy("column").agg(F.count("*").alias("longer"))
    spark = df.sparkSession
    rows = spark.createDataFrame([(c,) for c in names], "column string").join(counts, "column", "left")
    low = F.replace(F.lower("column"), F.lit(" "), F.lit("_"))
    person = (low.isin(P.NAME_COLUMNS) | low.rlike("name|person")) & (F.coalesce("longer", F.lit(0)) > 5)
    place = low.isin(P.ADDRESS_COLUMNS) | low.rlike("address|street|addr")
    column = F.col("column")
    n = F.coalesce(F.col("longer"), F.lit(0)).cast("string")
    hits = F.array_compact(
        F.array(
            F.when(
                person,
                _finding("pii", "person_name", column, F.concat(F.lit("Column '"), column, F.lit("' contains "), n, F.lit(" unique name-like values")), F.lit(0.80), F.lit("high"), F.lit("Column appears to contain personal names")),
            ),
            F.when(
                place,
                _finding("pii", "address", column, F.concat(F.lit("Column '"), column, F.lit("' contains address-like data")), F.lit(0.75), F.lit("high"), F.lit("Column appears to contain physical addresses")),
            ),
        )
    )
    return rows.select(F.explode(hits).alias("f")).select("f.*")


def scan_table(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Cell, entropy and column-level findings of one table."""
    names = list(columns or [c for c in df.columns if c != key])
    cells = scan_cells(df, key, names, entropy=True)
    return cells.unionByName(scan_name_columns(df, names).withColumn("key", F.lit(None).cast(cells.schema["key"].dataType)))


def severity_weight(severity: Column) -> Column:
    out = F.lit(1.0)
    for name, w in P.SEVERITY_WEIGHT.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in P.SEVERITY_RANK.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def scan_risk_score(findings: DataFrame, cells: Column) -> DataFrame:
    """One row: findings, categories and the 0-100 score. ``cells`` is the number of cells scanned."""
    weight = F.sum(severity_weight(F.col("severity")) * F.col("confidence"))
    facts = findings.agg(
        F.count("*").alias("findings"), F.count_distinct("category").alias("categories"), F.coalesce(weight, F.lit(0.0)).alias("weight")
    ).withColumn("cells", cells.cast("long"))
    density = F.least(F.lit(1.0), F.col("findings") / F.greatest(F.col("cells"), F.lit(1)) * 100.0)
    variety = F.least(F.lit(1.0), F.col("categories") / 5.0)
    raw = F.col("weight") * 2.0 + density * 30.0 + variety * 20.0
    score = F.when(F.col("findings") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))
    return facts.select("findings", "categories", "cells", score.alias("risk_score"))


def high_risk_columns(findings: DataFrame, k: int = 10, at_least: int = 2) -> DataFrame:
    """The k columns with most findings (at least two); ties by name."""
    counts = findings.groupBy("column").agg(F.count("*").alias("findings"))
    return counts.where(F.col("findings") >= at_least).orderBy(F.desc("findings"), "column").limit(k)


def hint_category(name: str) -> str | None:
    low = name.lower().replace(" ", "_").replace("-", "_")
    return next((category for word, category in P.NAME_HINTS if word in low), None)


def hint_severity(category: str) -> str:
    return "critical" if category in P.CRITICAL_HINTS else "high" if category in P.HIGH_HINTS else "medium"


def detect_pii_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, category, severity, confidence, method, sample_count): name hints, patterns, entropy, uniqueness.

    Pattern and entropy shares are taken over all non-null values.
    """
    names = list(columns or df.columns)
    hinted = []
    for c in names:
        category = hint_category(c)
        if category:
            hinted.append((c, category, hint_severity(category), 0.75, "column_name", -1))

    def fields(c):
        v = text_cell(df, c)
        long_enough = F.length(v) >= 3
        hits = [F.count(F.when(long_enough & v.rlike("(?i)" + rx), 1)) for _, rx, _ in P.COLUMN_PATTERNS]
        odd = F.when(F.length(v) >= P.ENTROPY_LENGTH, entropy_bits(v) >= P.ENTROPY_BITS)
        return [
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("n"),
            F.array(*hits).alias("hits"),
            F.count(F.when(odd, 1)).alias("odd"),
        ]

    facts = column_rows(df, names, fields)
    distinct = distinct_counts(df, names)
    facts = facts.join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))

    def row(hit, category, severity, confidence, method, count):
        return F.when(
            hit,
            F.struct(
                F.lit(category).alias("category"),
                F.lit(severity).alias("severity"),
                confidence.alias("confidence"),
                F.lit(method).alias("method"),
                count.cast("long").alias("sample_count"),
            ),
        )

    n = F.greatest(F.col("n"), F.lit(1))
    parts = []
    for i, (category, _, severity) in enumerate(P.COLUMN_PATTERNS):
        hits = F.col("hits")[i]
        parts.append(row(hits > 0, category, severity, F.round(F.least(F.lit(1.0), 0.5 + hits / n * 3.0), 2), "regex", hits))
    odd_floor = F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    parts.append(row((F.col("n") > 0) & (F.col("odd") >= odd_floor), "high_entropy_token", "high", F.least(F.lit(1.0), 0.4 + F.col("odd") / n), "entropy", F.col("odd")))
    unique = F.col("distinct") / F.greatest(F.col("rows"), F.lit(1))
    parts.append(row((F.col("n") > 0) & (unique > 0.95) & (F.col("rows") > 5), "quasi_identifier", "high", F.lit(0.85), "uniqueness_ratio", F.lit(-1)))
    found = facts.select("column", F.explode(F.array_compact(F.array(*parts))).alias("f")).select("column", "f.*")
    if not hinted:
        return found
    by_name = df.sparkSession.createDataFrame(
        hinted, "column string, category string, severity string, confidence double, method string, sample_count long"
    )
    return by_name.unionByName(found)


def pii_summary(findings: DataFrame, cells: Column) -> DataFrame:
    """One row: findings, flagged columns, density over non-null cells, worst severity."""
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    names = F.array(F.lit("low"), F.lit("medium"), F.lit("high"), F.lit("critical"))
    facts = findings.agg(F.count("*").alias("findings"), F.count_distinct("column").alias("pii_columns"), worst.alias("_w"))
    facts = facts.withColumn("cells", cells.cast("long"))
    return facts.select(
        "findings", "pii_columns", F.round(F.col("findings") / F.greatest(F.col("cells"), F.lit(1)), 6).alias("pii_density"), names[F.col("_w")].alias("pii_risk")
    )


# ---- prompts ---------------------------------------------------------------------------------------------------


def name_pairs(text: Column) -> Column:
    """How many capitalised word pairs hold no common word."""
    first = F.regexp_extract_all(text, F.lit(P.PERSON_NAME), F.lit(1))
    second = F.regexp_extract_all(text, F.lit(P.PERSON_NAME), F.lit(2))
    common = F.array(*[F.lit(w) for w in P.COMMON_WORDS])
    pairs = F.arrays_zip(first.alias("a"), second.alias("b"))
    return F.size(F.filter(pairs, lambda x: ~F.array_contains(common, x["a"]) & ~F.array_contains(common, x["b"])))


def prompt_counts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys.., name, type, category, severity, n): matches per prompt pattern, and person names."""
    t = F.col(text)
    rows = [
        F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(severity).alias("severity"),
            F.regexp_count(t, F.lit(("(?i)" if fold else "") + rx)).cast("long").alias("n"),
        )
        for name, rx, fold, kind, category, severity, _ in P.PROMPT_PATTERNS
    ]
    rows.append(
        F.struct(
            F.lit("Person Name").alias("name"), F.lit("pii").alias("type"), F.lit("person_name").alias("category"), F.lit("high").alias("severity"),
            name_pairs(t).cast("long").alias("n"),
        )
    )
    return df.where(t.isNotNull()).select(*keys, F.inline(F.array(*rows))).where("n > 0")


#: Matches folded at a time; keeps the cost of growing arrays small.
FOLD_BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step) -> Column:
    """All states of a left fold over an array: ``step(state, item)`` gives the next state.

    Items are folded in blocks, since an array that grows by one entry is copied each time.
    """

    def fold(values):
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(FOLD_BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(values, i, F.lit(FOLD_BLOCK)))
        one = lambda last, block: F.aggregate(block, F.array(last), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
        states = F.aggregate(blocks, F.array(F.array(zero)), lambda out, block: F.concat(out, F.array(one(F.element_at(F.element_at(out, -1), -1), block))))
        return F.flatten(F.transform(states, lambda b: F.slice(b, F.lit(2), F.size(b))))  # a block starts with the last state before it

    return _let(items, fold)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose formula the optimiser neither copies into later formulas nor pushes filters through."""
    return df.select("*", F.explode(F.array(value)).alias(name))


MARK, OTHER = "\u0001", "\u0002"


def marked_matches(text: Column, rx: str, rule: int, wanted=None) -> Column:
    """Array of (rule, gap, match, ok) of all matches of a pattern.

    A mark is set before every match; ``gap`` is the length of the piece before the mark, from the mark before it, so
    the running sum of the gaps is the place of the match. A mark that the text holds itself is read as another control
    character. ``wanted`` (first group, second group) says which matches count.
    """
    clean = F.translate(text, MARK, OTHER)
    gaps = F.transform(F.split(F.regexp_replace(clean, rx, MARK + "$0"), MARK, -1), F.length)
    found = F.regexp_extract_all(clean, F.lit(rx), F.lit(0))
    if wanted is None:
        matches = F.transform(found, lambda m: F.struct(m.alias("match"), F.lit(True).alias("ok")))
    else:
        groups = F.zip_with(F.regexp_extract_all(clean, F.lit(rx), F.lit(1)), F.regexp_extract_all(clean, F.lit(rx), F.lit(2)), wanted)
        matches = F.zip_with(found, groups, lambda m, ok: F.struct(m.alias("match"), ok.alias("ok")))
    # the piece behind the last match has no match beside it and is left out
    placed = F.filter(F.zip_with(gaps, matches, lambda n, m: F.struct(F.lit(rule).alias("rule"), n.alias("gap"), m["match"].alias("match"), m["ok"].alias("ok"))), lambda x: x["match"].isNotNull())
    return F.when(text.rlike(rx), placed).otherwise(F.array().cast("array<struct<rule:int,gap:int,match:string,ok:boolean>>"))


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``spans``, all matches by their place; ``kept`` marks those that survive the left-to-right overlap rule.

    Places count code points from 0. Suggestions are numbered over all patterns in their order, person names by
    themselves. Ties in place go to the earlier pattern. Null texts have no spans.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    common = F.array(*[F.lit(w) for w in P.COMMON_WORDS])
    rules = [("(?i)" * fold + rx, *facts) for _, rx, fold, *facts in P.PROMPT_PATTERNS]
    people = len(rules)
    matches = [marked_matches(t, rx, k) for k, (rx, *_) in enumerate(rules)]
    matches.append(marked_matches(t, P.PERSON_NAME, people, lambda a, b: ~F.array_contains(common, a) & ~F.array_contains(common, b)))
    rules.append((P.PERSON_NAME, "pii", "person_name", "high", "PERSON_{i:03d}"))

    state = lambda rule, at, number: F.struct(rule.alias("rule"), at.alias("at"), number.alias("number"))
    places = running(
        F.col("_matches"),
        state(F.lit(-1), F.lit(0), F.lit(0)),
        lambda s, x: state(
            x["rule"],
            F.when(x["rule"] == s["rule"], s["at"]).otherwise(0) + x["gap"],
            F.when((x["rule"] == people) & (s["rule"] != people), 0).otherwise(s["number"]) + x["ok"].cast("int"),
        ),
    )
    fact = lambda i, rule: F.get(F.array(*[F.lit(r[i]) for r in rules]), rule)
    forms = F.array(*[F.lit(r[4].replace("{i:03d}", "%1$03d").replace("{match}", "%2$s")) for r in rules])
    found = F.transform(
        F.filter(F.zip_with("_matches", places, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda x: x["m"]["ok"]),
        lambda x: F.struct(
            x["s"]["at"].alias("start"),
            x["m"]["rule"].alias("rule"),
            (x["s"]["at"] + F.length(x["m"]["match"])).alias("end"),
            x["m"]["match"].alias("match"),
            F.call_function("format_string", F.get(forms, x["m"]["rule"]), x["s"]["number"], F.upper(x["m"]["match"])).alias("suggestion"),
        ),
    )
    seen = lambda last, kept: F.struct(last.alias("last"), kept.alias("kept"))
    kept = running(F.col("_found"), seen(F.lit(-1), F.lit(False)), lambda s, x: seen(F.when(x["start"] >= s["last"], x["end"]).otherwise(s["last"]), x["start"] >= s["last"]))
    spans = F.zip_with(
        "_found",
        kept,
        lambda x, s: F.struct(
            *[fact(i, x["rule"]).alias(n) for i, n in enumerate(("type", "category", "severity"), 1)], x["match"], x["start"], x["end"], x["suggestion"], s["kept"]
        ),
    )
    out = _once(_once(df, "_matches", F.concat(*matches)), "_found", F.sort_array(found))
    return _once(out, "spans", spans).drop("_matches", "_found")


def scan_prompts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per finding with its span and suggested replacement."""
    return with_spans(df, text).select(*keys, F.inline("spans"))


def redact_prompts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys.., redacted, items, has_critical, has_high, risk): kept spans replaced, everything else untouched."""
    t = F.col(text)
    kept = F.sort_array(F.transform(F.filter("spans", lambda s: s["kept"]), lambda s: F.struct(s["start"], s["end"], s["suggestion"], s["severity"])))
    marked = with_spans(df, text).withColumn("_kept", kept)
    n = F.size("_kept")
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.concat(
            F.substring(
                t,
                F.when(i == 0, 1).otherwise(F.try_element_at("_kept", i)["end"] + 1),
                F.when(i == n, F.length(t)).otherwise(F.try_element_at("_kept", i + 1)["start"])
                - F.when(i == 0, 0).otherwise(F.try_element_at("_kept", i)["end"]),
            ),
            F.when(i < n, F.try_element_at("_kept", i + 1)["suggestion"]).otherwise(""),
        ),
    )
    critical = F.exists("_kept", lambda s: s["severity"] == "critical")
    high = F.exists("_kept", lambda s: s["severity"] == "high")
    risk = F.when(critical, "dangerous").when(n > 0, "warning").otherwise("safe")
    return marked.select(
        *keys, F.array_join(pieces, "").alias("redacted"), n.alias("items"), critical.alias("has_critical"), high.alias("has_high"), risk.alias("risk")
    )


# ---- source text ------------------------------------------------------------------------------------------------


def ignored_path(path: Column) -> Column:
    out = F.lit(False)
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    for rx in P.IGNORED_PATHS:
        out = out | normal.rlike(rx)
    return out


START = "\u0001"
LINE_HITS = "array<struct<line:int,pattern:string,category:string,severity:string,message:string,snippet:string>>"


def line_hits(text: Column) -> Column:
    """Array of (line, pattern, category, severity, message, snippet), one entry per match, in linear time.

    Matches may span lines, so whole texts are matched. A marker set before every match and a split at the line
    breaks give the line each match starts on; no window and no state is needed.
    """

    def starts(line, i):
        return F.array_repeat((i + 1).cast("int"), (F.length(line) - F.length(F.replace(line, F.lit(START), F.lit("")))).cast("int"))

    def entries(clean, name, rx, category, severity, message):
        found = F.regexp_extract_all(clean, F.lit(rx), F.lit(0))
        marked = F.split(F.regexp_replace(clean, rx, START + "$0"), "\n", -1)
        lines = F.flatten(F.transform(marked, starts))
        hits = F.transform(
            F.arrays_zip(lines.alias("line"), found.alias("m")),
            lambda x: F.struct(
                x["line"].alias("line"),
                F.lit(name).alias("pattern"),
                F.lit(category).alias("category"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                F.substring(x["m"], 1, 80).alias("snippet"),
            ),
        )
        # most texts hold few patterns: one search of each decides
        return F.when(clean.rlike(rx), hits).otherwise(F.array().cast(LINE_HITS))

    # as the element of an array the cleaned text is made once, not once a pattern
    clean = F.array(F.replace(text, F.lit(START), F.lit(" ")))
    return F.flatten(F.transform(clean, lambda x: F.concat(*[entries(x, *p) for p in P.LINE_PATTERNS])))


def scan_lines(df: DataFrame, text: str, key: str, path: str | None = None) -> DataFrame:
    """(key, line, pattern, category, severity, message, snippet): every match with its 1-based line; no shuffle."""
    kept = df if path is None else df.where(~ignored_path(F.col(path)))
    return kept.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.inline(line_hits(F.col(text))))


def header_signal(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(keys.., signals, pii_density, risk, label): how many of the 16 header words occur."""
    low = F.lower(F.col(text))
    hits = sum((low.rlike(rx).cast("int") for rx in P.HEADER_WORDS), F.lit(0))
    out = df.select(*keys, F.coalesce(hits, F.lit(0)).alias("signals"))
    risk = F.least(F.lit(100), F.col("signals") * 8)
    return out.select(
        *keys,
        "signals",
        (F.col("signals") / float(len(P.HEADER_WORDS))).alias("pii_density"),
        risk.cast("double").alias("risk"),
        F.when(risk >= 70, "HIGH").when(risk >= 40, "MODERATE").otherwise("LOW").alias("label"),
    )
