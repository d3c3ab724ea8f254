"""Host-level quality rules: failures per host, shrunk by an empirical beta prior, decide over the host's documents.

Every document gets counts of its own (words, symbols, repeated lines, repeated word windows). Rules on these counts
are summed up per host. A host's failure rate is drawn towards the rate of all hosts by a beta prior fitted to the
hosts themselves, so that a host with three documents is not judged by three documents. A host whose shrunk rate is
high is ``watched`` (its documents that fail a rule are rejected) or ``blocked`` (all its documents are rejected);
elsewhere only the base rules reject.

Null texts have no words and fail the base rule. A null host is a host of its own. Repeated rows count as often as
they occur. An empty table gives an empty result. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilwork.llm.common import bytes_of, cell, field, hot_join, packed
from veilwork.session import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space and UTF-8 continuation bytes

#: Share of a host's documents that may fail: above the first its failing documents go, above the second all.
WATCH_RATE = 0.5
BLOCK_RATE = 0.9
#: Bounds on the weight of the prior, in documents.
MIN_WEIGHT, MAX_WEIGHT = 2.0, 10_000.0


def count_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The counts of one UTF-8 text, in the order of ``COUNTS``."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    """The counts of every text; null texts count as empty."""
    rows = [count_text(t or b"") for t in bytes_of(texts)]
    columns = list(zip(*rows)) if rows else [[] for _ in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=COUNTS)


def base_failed(get) -> Column:
    return (get("n_words") < 50) | (100 * get("n_repeat_words") > 50 * get("n_words"))


def rule_failures(get) -> dict[str, Column]:
    """Each rule as a condition that is true where a document fails; ``get`` gives the column of a count."""
    words = get("n_words")
    return {
        "base": base_failed(get),
        "symbols": 10 * get("n_symbols") > words,
        "lines": 10 * get("n_dup_lines") > 3 * get("n_lines"),
        "repeats": 5 * get("n_repeat_words") > words,
        "length": (get("word_chars") < 3 * words) | (get("word_chars") > 12 * words),
    }


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def host_rates(counts: DataFrame, host_key: str) -> DataFrame:
    """Per host: documents, shrunk failure rate of every rule and of all rules together, and the verdict."""
    names = list(rule_failures(F.col))
    failed = rule_failures(F.col)
    anyone = F.lit(False)
    for condition in failed.values():
        anyone = anyone | condition
    hosts = cut_lineage(
        counts.groupBy(host_key).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in failed.items()],
            F.sum(anyone.cast("long")).alias("f_any"),
        )
    )
    rules = [*names, "any"]
    moments = hosts.agg(
        *[F.avg(F.col(f"f_{r}") / F.col("n")).alias(f"m_{r}") for r in rules],
        *[F.var_pop(F.col(f"f_{r}") / F.col("n")).alias(f"v_{r}") for r in rules],
        F.avg(1 / F.col("n")).alias("noise"),
    ).first()
    shrunk = []
    for r in rules:
        mean, var = moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0
        spread = var - mean * (1 - mean) * (moments["noise"] or 0.0)
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else MAX_WEIGHT
        weight = min(MAX_WEIGHT, max(MIN_WEIGHT, weight))
        shrunk.append(((F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
    rates = hosts.select(host_key, "n", *shrunk)
    verdict = F.when(F.col("rate_any") > BLOCK_RATE, "blocked").when(F.col("rate_any") > WATCH_RATE, "watched").otherwise("fine")
    return cut_lineage(rates.withColumn("host_verdict", verdict))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: its counts, ``base_failed``, its host's verdict and shrunk rate, and ``kept``."""
    facts = docs.select(cell(id_col).alias("doc_id"), _host_key(cell(host_col)).alias("_host"), text_counts(cell(text_col)).alias("c"))
    facts = cut_lineage(facts.select("doc_id", "_host", "c.*"))
    rates = host_rates(facts, "_host")
    joined = hot_join(facts, rates.select("_host", "n", "rate_any", "host_verdict"), "_host", "n", ["doc_id", *COUNTS])
    return joined.select(
        "doc_id", *COUNTS, base_failed(F.col).alias("base_failed"), _kept(F.col).alias("kept"), "host_verdict", F.col("rate_any").alias("host_rate")
    )


def _kept(get) -> Column:
    soft = F.lit(False)
    for name, condition in rule_failures(get).items():
        if name != "base":
            soft = soft | condition
    verdict = F.col("host_verdict")
    return ~base_failed(get) & (verdict != "blocked") & ~((verdict == "watched") & soft)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    The counts are made twice, once for the hosts and once beside the texts: that costs less than moving texts.
    """
    facts = docs.select(_host_key(cell(host_col)).alias("_host"), text_counts(cell(text_col)).alias("c")).select("_host", "c.*")
    rates = host_rates(facts, "_host").select("_host", "n", "host_verdict")
    marked = packed(docs).withColumn("_host", _host_key(field(host_col)))
    # the verdict meets the texts before the counts, so that few hosts are broadcast and move nothing
    joined = hot_join(marked, rates, "_host", "n", ["doc"])
    # not deterministic, so that the filter on the counts does not count anew
    counted = joined.withColumn("c", text_counts.asNondeterministic()(field(text_col)))
    return counted.where(_kept(lambda n: F.col("c")[n])).select("doc.*")


#: The same by SQL. Rates that decide nothing are left out.
ORACLE = r"""
WITH a AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
q AS (SELECT doc_id, count(DISTINCT k) AS n FROM r GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
c AS (
  SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(q.n, 0) AS n_repeat_words, len(l) AS n_lines
  FROM a JOIN l USING (doc_id) LEFT JOIN q USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 5 * n_repeat_words > n_words
         OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS soft_failed FROM c),
h AS (SELECT host, count(*) AS n, avg(CAST(base_failed OR soft_failed AS INT)) AS p FROM f GROUP BY 1),
m AS (SELECT avg(p) AS mean, var_pop(p) AS var, avg(1.0 / n) AS noise FROM h),
b AS (
  SELECT mean, CASE WHEN var - mean * (1 - mean) * noise > 0
         THEN least(10000.0, greatest(2.0, mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1)) ELSE 10000.0 END AS weight FROM m),
v AS (
  SELECT host, CASE WHEN (p * n + mean * weight) / (n + weight) > 0.9 THEN 'blocked'
         WHEN (p * n + mean * weight) / (n + weight) > 0.5 THEN 'watched' ELSE 'fine' END AS host_verdict FROM h, b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND host_verdict <> 'blocked' AND NOT (host_verdict = 'watched' AND soft_failed) AS kept, host_verdict
FROM f JOIN v USING (host)
"""
