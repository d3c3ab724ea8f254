"""Benchmark decontamination by a distributed positional inverted index.

The benchmark is cut into windows of consecutive words. The corpus frequency of every benchmark word is counted, and
the postings of each window's two rarest words that the corpus has are stored: per document and word the position, and
the numbers of the words around it. The lists of the two words, each shifted back by the word's offset in the window,
are intersected; a shared start whose neighbouring words are the window's own is an exact phrase.

A proximity match is a start, given by a posting of the window's rarest word, that is no exact phrase, where the second
rarest word and at least ``LEAST`` tenths of all the window's words stand within ``slop`` places of their own place.
Words that the corpus lacks are not found there, so a changed or inserted word does not hide a passage.

The benchmark is taken in blocks of bounded size, so what is broadcast (words, windows, anchors of a block) never
grows beyond ``block_bytes``; a larger benchmark takes more blocks. Which items hold a window stays a table and is
joined to the matches, repeats removed before they are gathered. Documents are never grouped by word: postings stay
beside their document and meet the block's windows in the task, so a frequent passage is no hot key.

Null texts have no words. Repeated rows are found each by itself. A null item id marks hits but is no item. An empty
benchmark or table gives rows without hits, or none. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veilwork.llm.common import bytes_of, cell, field, rows_of
from veilwork.session import cut_lineage

WIDTH = 10
BLOCK_BYTES = 24 << 20
#: How many of ten words of a window a proximity match holds.
LEAST = 8
#: Everything but 0-9, a-z and the bytes of other characters separates words; A-Z are lower-cased.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, words): the windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                words = [w.decode() for w in words_of(text)]
                if words:
                    found = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.list_(pa.string()))], names=["item", "words"])

    return items.select(cell(id_col).cast("string"), cell(text_col).cast("string")).mapInArrow(cut, "item string, words array<string>").distinct()


class Block:
    """A bounded part of the benchmark's windows, held by the driver and sent to the tasks."""

    def __init__(self, rows: list):
        self.windows = [(r["window"], [w.encode() for w in r["words"]]) for r in rows]
        self.terms = {w: i for i, w in enumerate(sorted({w for _, words in self.windows for w in words}))}

    def anchors(self, counts: np.ndarray, near: bool) -> list[tuple]:
        """(term, offset, which, window, ids, other, shift) of the two rarest present words of every window that can match.

        ``other`` is the term of the window's other anchor, ``shift`` how many places it is further on. A window with
        absent words can only come near, and only if enough of its words are present.
        """
        out = []
        for window, words in self.windows:
            ids = [self.terms[w] for w in words]
            present = [o for o, i in enumerate(ids) if counts[i]]
            if len(present) == len(ids) or near and 10 * len(present) >= LEAST * len(ids):
                rarest = sorted(present, key=lambda o: (counts[ids[o]], o))[:2]
                for which, o in enumerate(rarest):
                    mate = rarest[1 - which] if len(rarest) > 1 else None
                    out.append((ids[o], o, which, window, ids, *((None, None) if mate is None else (ids[mate], mate - o))))
        return out


def corpus_counts(texts: DataFrame, terms) -> np.ndarray:
    """How often each of a block's words occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                get = known.get
                total += np.bincount([get(w, -1) + 1 for w in words_of(text)], minlength=len(total)) if text else 0
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1:][at])], names=["term", "n"])

    rows = texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms.value), np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out


def postings(texts: DataFrame, terms, wanted, reach: int) -> DataFrame:
    """(row, n_words, posts): one row per document with the postings of the wanted words.

    ``near`` holds the numbers of the words up to ``reach`` places to either side, -1 where there is none or an
    unknown one.
    """
    span = np.arange(2 * reach + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, anchor = terms.value, wanted.value
        for batch in batches:
            sizes, counts, term, pos, near = [], [0], [], [], []
            for text in bytes_of(batch.column(1)):
                get = known.get
                words = words_of(text)
                ids = np.array([get(w, -1) for w in words], np.int32)
                at = np.flatnonzero(anchor[ids]) if len(ids) else np.empty(0, np.int64)
                sizes.append(len(words))
                counts.append(len(at))
                if len(at):
                    term.append(ids[at])
                    pos.append(at.astype(np.int32))
                    near.append(np.pad(ids, reach, constant_values=-1)[at[:, None] + span].ravel())
            flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (term, pos, near)]
            around = pa.ListArray.from_arrays(pa.array(np.arange(len(flat[0]) + 1) * len(span), pa.int32()), pa.array(flat[2]))
            rows = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1]), around], names=["term", "pos", "near"])
            posts = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), posts], names=["row", "n_words", "posts"])

    return texts.mapInArrow(index, f"row {texts.schema['row'].dataType.simpleString()}, n_words bigint, posts array<struct<term:int,pos:int,near:array<int>>>")


def block_matches(texts: DataFrame, block: Block, width: int, slop: int, near: bool) -> DataFrame:
    """(row, window, size, starts, near_starts): exact phrase starts and, if wanted, proximity starts of the block's windows."""
    spark = texts.sparkSession
    terms = spark.sparkContext.broadcast(block.terms)
    anchors = block.anchors(corpus_counts(texts.select("text"), terms), near)
    flags = np.zeros(len(block.terms) + 1, bool)  # the last one is for unknown words, numbered -1
    flags[[a[0] for a in anchors]] = True
    reach = width - 1 + slop
    index = cut_lineage(postings(texts.select("row", "text"), terms, spark.sparkContext.broadcast(flags), reach))
    table = spark.createDataFrame(anchors, "term int, offset int, which int, window bigint, ids array<int>, other int, shift int")
    posts = index.where(F.size("posts") > 0).select("row", F.inline("posts"))
    # a posting without the other anchor close to its place can neither meet its list nor come near; it is left in the task
    place = F.lit(reach + 1 - slop) + F.col("shift")
    close = F.col("other").isNull() | F.array_contains(F.slice("near", place, F.lit(2 * slop + 1)), F.col("other"))
    met = posts.join(F.broadcast(table), "term").where(close).withColumn("start", F.col("pos") - F.col("offset"))
    first = F.lit(reach + 1) - F.col("offset")
    exact = F.slice("near", first, F.size("ids")) == F.col("ids")
    in_place = F.filter("ids", lambda term, j: F.array_contains(F.slice("near", first + j - slop, F.lit(2 * slop + 1)), term))
    close_by = ~exact & (F.size(in_place) * 10 >= F.size("ids") * LEAST) if near else F.lit(False)
    lists = met.groupBy("row", "window").agg(
        F.collect_set(F.when((F.col("which") == 0) & exact, F.col("start"))).alias("whole"),
        F.collect_set(F.when(F.col("which") == 1, F.col("start"))).alias("second"),
        F.collect_set(F.when((F.col("which") == 0) & close_by, F.col("start"))).alias("near_starts"),
        F.first(F.size("ids")).alias("size"),
    )
    starts = F.when(F.col("size") == 1, F.col("whole")).otherwise(F.array_intersect("whole", "second"))
    found = lists.select("row", "window", "size", starts.alias("starts"), "near_starts")
    return found.where((F.size("starts") > 0) | (F.size("near_starts") > 0))


def find_passages(
    texts: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH, slop: int = 2, block_bytes: int = BLOCK_BYTES, near: bool = True
) -> DataFrame:
    """``texts`` (row, text) against the benchmark: (row, items, spans, near), rows with an exact or a proximity match only.

    ``items`` are the sorted ids of the items with an exact window, ``spans`` holds (start, size) of exact phrases and
    ``near`` of proximity matches, in words. ``near=False`` looks for exact phrases alone.
    """
    spark = texts.sparkSession
    cuts = cut_lineage(item_windows(items, item_col, text_col, width))
    size = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8)
    windows = cut_lineage(cuts.select("words").distinct().withColumns({"bytes": size, "window": F.monotonically_increasing_id()}))
    total = windows.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // block_bytes)
    parts = []
    for k in range(blocks):
        block = Block(windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("window", "words").collect())
        if block.windows:
            parts.append(block_matches(texts, block, width, slop, near))
    place = "array<struct<start:int,size:int>>"
    if not parts:
        return spark.createDataFrame([], f"row {texts.schema['row'].dataType.simpleString()}, items array<string>, spans {place}, near {place}")
    every = cut_lineage(reduce(DataFrame.union, parts))
    placed = lambda starts: F.transform(starts, lambda s: F.struct(s.alias("start"), F.col("size").alias("size")))
    gathered = lambda starts: F.array_sort(F.flatten(F.collect_list(placed(starts))))
    spans = every.groupBy("row").agg(gathered("starts").alias("spans"), gathered("near_starts").alias("near"))
    holders = cuts.where(F.col("item").isNotNull()).join(windows.select("words", "window"), "words").select("window", "item")
    named = every.where(F.size("starts") > 0).select("row", "window").join(holders, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return cut_lineage(spans.join(named, "row", "left").select("row", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", "near"))


def covered(spans):
    """Words inside any of the sorted spans."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(s["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["start"] + s["size"]).alias("upto"),
        ),
    )
    return step["n"]


@F.arrow_udf(LongType())
def word_counts(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t)) for t in bytes_of(texts)], pa.int64())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, hit words, items with occurring windows, and the number of proximity matches."""
    rows = rows_of(docs)
    texts = rows.select("row", field(text_col).alias("text"))
    found = find_passages(texts, items, width=width, slop=slop, block_bytes=block_bytes)
    counted = cut_lineage(rows.select("row", field(id_col).alias("doc_id"), word_counts(field(text_col)).alias("n_words")))
    none = F.array().cast("array<string>")
    joined = counted.join(found, "row", "left").withColumn("items", F.coalesce("items", none))
    hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    rows = rows_of(docs)
    found = find_passages(rows.select("row", field(text_col).alias("text")), items, width=width, near=False)
    return rows.join(found.where(F.size("spans") > 0).select("row"), "row", "left_anti").select("doc.*")


#: The same by SQL: words per document, then each window's rarest word as the entry to the comparison.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS w
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS MATERIALIZED (SELECT id, i, w[i] AS x FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT x, count(*) AS n FROM p GROUP BY 1),
o AS (
  SELECT v.w, v.j, row_number() OVER (PARTITION BY v.w ORDER BY c.n, v.j) AS k, count(*) OVER (PARTITION BY v.w) AS present
  FROM (SELECT w, unnest(range(1, len(w) + 1)) AS j FROM (SELECT DISTINCT w FROM v)) v JOIN c ON v.w[v.j] = c.x),
a AS (
  SELECT w, max(j) FILTER (k = 1) AS j1, max(j) FILTER (k = 2) AS j2
  FROM o GROUP BY w HAVING 10 * max(present) >= {LEAST} * len(w)),
q AS (
  SELECT p.id, a.w, p.i - a.j1 + 1 AS s, list_slice(d.w, greatest(p.i - a.j1 + 1, 1), p.i - a.j1 + len(a.w)) = a.w AND p.i >= a.j1 AS whole,
         len(list_filter(range(1, len(a.w) + 1),
                         lambda j: list_contains(list_slice(d.w, greatest(p.i - a.j1 + j - 2, 1), greatest(p.i - a.j1 + j + 2, 0)), a.w[j]))) AS found
  FROM a JOIN p ON p.x = a.w[a.j1] JOIN d USING (id)
  WHERE a.j2 IS NULL OR list_contains(list_slice(d.w, greatest(p.i - a.j1 + a.j2 - 2, 1), greatest(p.i - a.j1 + a.j2 + 2, 0)), a.w[a.j2])),
m AS (SELECT q.id, q.s, len(q.w) AS n, v.item_id FROM q JOIN v ON q.whole AND q.w = v.w),
h AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS k FROM m) GROUP BY 1),
t AS (
  SELECT id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1),
r AS (SELECT id, count(*) AS n_near FROM q WHERE NOT whole AND 10 * found >= {LEAST} * len(w) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(r.n_near, 0) AS n_near
FROM d LEFT JOIN h USING (id) LEFT JOIN t USING (id) LEFT JOIN r USING (id)
"""
