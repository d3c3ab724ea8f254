"""Phrase collocations from stripes.

A text is cut into pieces and words. The stripe of a prefix of no, one or two words is an associative counter of the
word that follows it. The merged stripes are one table (lang, prefix, next, f) that holds everything the scores need: its
cells are the counts of all phrases, the cell of a prefix is that prefix' total, its extensions are the cells below it,
and the greatest of them decides whether the prefix is subsumed.

Stripes are made level by level, since every part of a frequent phrase is frequent: a level counts only continuations
whose two parts may be frequent, told by a bitmap of ``2 ** BITS`` hashed phrases of the level before. The bitmap has
one size whatever the corpus; where it fills up it leaves out less, and the counts stay exact. Tasks number the words
of ``WORDS`` words at a time, sort the numbered phrases, and pass the runs of equal prefixes on as stripes. Prefixes
that hold more than a thousandth of all words (known exactly from the level before, so a thousand at most) are
cut into segments by the next word, so no stripe is ever merged whole in one task. Cells are summed by Spark, which
spills, and only those of ``min_count`` or more go on.

Null texts are empty, a null language is ``und``. Repeated rows count each time; texts of any length are counted
whole; other columns are not looked at; an empty table gives an empty result. Ties in score go to the more frequent
phrase, then to the lesser one in bytes. All arithmetic is in decimals of 38 digits, exact for counts below 10^16.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import bytes_of, cell
from veilwork.session import cut_lineage

#: Words a task holds before it passes its stripes on.
WORDS = 1 << 20
#: Size of the bitmap of frequent phrases, as a power of two: 4 MB.
BITS = 25
#: A prefix of 1 / SHARE of all words is one more segment; the stripe of the empty prefix has SPREAD of them.
SHARE, SPREAD = 1000, 64

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_MIX = 1_000_003


class _Numbers(dict):
    """Words to numbers from 1 on, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _codes(lang: str, words: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """The bitmap place of the phrase of ``size`` words that starts at each number; ``words`` are checksums by number."""
    at = np.full(max(0, len(numbers) - size + 1), crc32(lang.encode()), np.int64)
    for k in range(size):
        at = (at % (1 << BITS) * _MIX + words[numbers[k : k + len(at)]]) % (1 << BITS)
    return at


def _frequent(level: DataFrame) -> np.ndarray:
    """The bitmap of a level's phrases, packed eight to a byte."""
    word = F.split(F.ltrim(F.concat_ws(" ", "prefix", "next")), " ", -1)
    at = F.aggregate(word, F.crc32(F.col("lang").cast("binary")), lambda h, w: (h % (1 << BITS) * _MIX + F.crc32(w.cast("binary"))) % (1 << BITS))
    places = level.where("next != ''").select((at + 1).alias("at"))
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    packed = np.zeros(1 << BITS >> 3, np.uint8)
    for row in rows:
        bits = np.frombuffer(row["bits"], np.uint8)
        packed[(row["b"] - 1) * 4096 :][: len(bits)] = bits
    return packed


def _cells(lang: str, numbers: np.ndarray, words: dict, size: int, frequent: np.ndarray | None, hot: dict) -> pa.RecordBatch | None:
    """The stripes of one language's numbered words (0 parts pieces): lang, prefix, segment, nexts, counts."""
    sums = np.array([0, *map(crc32, words)], np.int64)
    starts = max(0, len(numbers) - size + 1)
    valid = np.ones(starts, bool)
    for k in range(size):
        valid &= numbers[k : k + starts] > 0
    if frequent is not None:
        at = _codes(lang, sums, numbers, size - 1)
        known = (frequent[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        valid &= known[:starts] & known[1 : starts + 1]
    first = np.flatnonzero(valid)
    if not len(first):
        return None
    width = len(words) + 1
    following = numbers[first + size - 1]
    if size == 1:
        prefix, heads = np.zeros(len(first), np.int64), None
    elif size == 2:
        prefix, heads = numbers[first], None
    else:
        heads, prefix = np.unique(numbers[first] * width + numbers[first + 1], return_inverse=True)
    found, counts = np.unique(prefix * width + following, return_counts=True)
    prefix, following = found // width, found % width
    names = pa.array(list(words), pa.binary())
    if size == 1:
        spread = np.full(1, SPREAD)
    else:
        keys = list(words) if size == 2 else [b" ".join(p) for p in zip(names.take(heads // width - 1).to_pylist(), names.take(heads % width - 1).to_pylist())]
        spread = np.array([hot.get((lang, key), 1) for key in keys], np.int64)
        if size == 2:
            spread = np.concatenate(([1], spread))
    segment = sums[following] % spread[prefix]
    order = np.lexsort((segment, prefix)) if spread.max() > 1 else np.arange(len(prefix))
    prefix, segment, following, counts = prefix[order], segment[order], following[order], counts[order]
    runs = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1]))))
    offsets = pa.array(np.append(runs, len(prefix)).astype(np.int32))
    if size == 1:
        text = pa.array([""] * len(runs), pa.string())
    elif size == 2:
        text = names.take(pa.array(prefix[runs] - 1)).cast(pa.string())
    else:
        text = pa.array(keys, pa.binary()).take(pa.array(prefix[runs])).cast(pa.string())
    nexts = pa.ListArray.from_arrays(offsets, names.take(pa.array(following - 1)).cast(pa.string()))
    totals = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))
    langs = pa.array([lang]).take(pa.array(np.zeros(len(runs), np.int32)))
    return pa.RecordBatch.from_arrays([langs, text, pa.array(segment[runs].astype(np.int32)), nexts, totals], names=_NAMES)


_NAMES = ["lang", "prefix", "segment", "nexts", "counts"]


def stripes(docs: DataFrame, size: int, frequent: np.ndarray | None = None, hot: dict | None = None, at_once: int = WORDS) -> DataFrame:
    """(lang, text) to (lang, prefix, segment, nexts, counts): partial stripes of prefixes of ``size - 1`` words.

    The stripes of no words have a cell for the empty word, which counts all words.
    """
    hot = hot or {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[int]]] = {}
        room = at_once

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (words, numbers) in held.items():
                made = _cells(lang, np.array(numbers, np.int64), words, size, frequent, hot)
                if made is not None:
                    yield made
                    if size == 1:
                        n = pc.sum(made.column(4).values).as_py()
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([[""]]), pa.array([[n]])], names=_NAMES)
            held.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                if not raw:
                    continue
                words, numbers = held.setdefault(lang, (_Numbers(), []))
                before = len(numbers)
                pieces = raw.lower().translate(_BREAKS).split(b"\n")
                numbers.extend(chain.from_iterable((*map(words.__getitem__, piece.split()), 0) for piece in pieces))
                room -= len(numbers) - before
                if room <= 0:
                    yield from emit()
                    room = at_once
        yield from emit()

    return docs.select("lang", "text").mapInArrow(count, "lang string, prefix string, segment int, nexts array<string>, counts array<bigint>")


def merge(partial: DataFrame, min_count: int) -> DataFrame:
    """(lang, prefix, next, f): the cells of the merged stripes that hold ``min_count`` or more, and the words in all."""
    dealt = partial.repartition("lang", "prefix", "segment")
    cells = dealt.select("lang", "prefix", "segment", F.explode(F.arrays_zip("nexts", "counts")).alias("c"))
    summed = cells.groupBy("lang", "prefix", "segment", F.col("c.nexts").alias("next")).agg(F.sum("c.counts").alias("f"))
    return summed.where((F.col("f") >= min_count) | (F.col("next") == "")).select("lang", "prefix", "next", "f")


def _hot(level: DataFrame, words: int) -> dict[tuple[str, bytes], int]:
    """Segments of the phrases that hold more than 1 / ``SHARE`` of all words, so ``SHARE`` phrases at most."""
    big = level.where((F.col("next") != "") & (F.col("f") * SHARE > words)).select("lang", F.ltrim(F.concat_ws(" ", "prefix", "next")).alias("p"), "f")
    return {(r["lang"], r["p"].encode()): -(-r["f"] * SHARE // words) for r in big.collect()}


def count_phrases(docs: DataFrame, min_count: int, at_once: int = WORDS) -> DataFrame:
    """(lang, text) to the merged stripes (lang, prefix, next, f) of all phrases of one to three words."""
    levels: list[DataFrame] = []
    frequent, hot, words = None, None, 0
    for size in (1, 2, 3):
        levels.append(cut_lineage(merge(stripes(docs, size, frequent, hot, at_once), min_count)))
        if size == 1:
            words = levels[0].where("next = ''").agg(F.sum("f")).first()[0] or 0
        if size < 3:
            frequent, hot = _frequent(levels[-1]), _hot(levels[-1], words)
    return levels[0].union(levels[1]).union(levels[2])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exactly: a division of whole decimals."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right).cast("long")


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 10,
    subsumed_percent: int = 50,
    top: int | None = 2000,
    at_once: int = WORDS,
) -> DataFrame:
    """The best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is that of its lowest-scoring cut. Phrases inside a candidate that is at least ``subsumed_percent``
    as frequent are left out. ``top=None`` returns all of them.
    """
    slim = docs.select(F.coalesce(cell(lang_col).cast("string"), F.lit("und")).alias("lang"), cell(text_col).cast("string").alias("text"))
    counts = count_phrases(slim, min_count, at_once)
    total = counts.where("next = ''").select("lang", F.col("f").alias("n"))
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    known = counts.where(F.col("next") != "").select("lang", phrase.alias("phrase"), F.col("f").alias("a")).withColumn("words", F.size(F.split("phrase", " ", -1)))
    parts = known.where("words < 3").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    word = F.split("phrase", " ", -1)
    cuts = known.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(word, F.col("k") + 1, F.lit(2)), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the greatest extension of each pair, to the right and to the left
    triples = known.where("words = 3")
    wider = triples.select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))).alias("phrase")
    )
    extended = wider.groupBy("lang", "phrase").agg(F.max("a").alias("widest"))
    left = best.join(extended, ["lang", "phrase"], "left").where(
        F.col("widest").isNull() | (F.col("widest") * 100 < F.col("a") * subsumed_percent)
    )
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    # one row per language
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, d, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
z AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS z FROM w),
g AS (
  SELECT lang, z[1] AS phrase, 1 AS words FROM z
  UNION ALL SELECT lang, z[1] || ' ' || z[2], 2 FROM z WHERE z[2] IS NOT NULL
  UNION ALL SELECT lang, z[1] || ' ' || z[2] || ' ' || z[3], 3 FROM z WHERE z[3] IS NOT NULL),
f AS (SELECT lang, phrase, words, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT lang, phrase, words, f AS a, unnest(range(1, words)) AS k, w FROM c),
h AS (SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM k),
s AS (
  SELECT h.lang, h.phrase, h.words, a, k, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail),
b AS (SELECT lang, phrase, words, a, min(score) AS score, arg_min({'l': l, 'r': r}, {'score': score, 'k': k}) AS lr FROM s GROUP BY ALL),
x AS (
  SELECT lang, phrase, max(f) AS widest FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM c WHERE words = 3)
  GROUP BY ALL),
t AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE widest IS NULL OR 100 * widest < 50 * a)
SELECT t.lang, rank, phrase, a, lr.l AS l, lr.r AS r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""
