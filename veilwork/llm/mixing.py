"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source asks for its share of all words; no source is taken more than ``max_epochs`` times, and what it
cannot give is shared out again by weight. Schedule: slot t = 0, 1, 2, ... falls on the point frac((t + 1/2) / golden
ratio) of [0, 1), which the cumulative weights map to a source. Slots are ranked within their source. Every source's
documents are shuffled by a keyed hash, laid end to end as often as needed, and cut into blocks of equal word count;
slot r of a source takes block r. A source's slots end where its target is reached, in the middle of a block if need
be, so the words taken equal the targets, and any prefix of the schedule is mixed as evenly as the points are spread.

Ranks and positions are running totals made in two steps (sums of small parts, then inside a part), so that a source
with a third of all rows is spread over many tasks.

Null texts have size 0 and are never taken. A null source is a source of its own, last in order. Repeated rows are
taken each by itself. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import cell, field, rows_of
from veilwork.session import cut_lineage

BLOCK_WORDS = 128
MAX_EPOCHS = 3
GOLDEN = 0.6180339887498949
#: Least number of cells of [0, 1) through which points meet the cumulative weights; more sources get more cells.
CELLS = 4096
#: Parts of a source's shuffled documents, and slots of a part, for running totals.
PARTS = 4096
SLOTS = 65_536
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(key, source_size) to (key, source_size, target): one row per source, in the order of ``key``.

    Sources are capped in the order of cap over weight; the running totals give at each source the level that those
    after it would share, and a source is capped where its own ratio lies below that level.
    """
    order = Window.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level)
    capped = F.col("cap") <= F.col("w") * F.col("level")
    rows = rows.withColumn("shared", F.min(F.when(~capped, F.struct(F.col("cap") / F.col("w"), "key", "level"))).over(every)["level"])
    return rows.select("key", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("w") * F.col("shared")).alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, key, rank): the mixed order of blocks, each source until its target is reached.

    ``sources`` is (key, target). The points run on until nearly every source has had all its slots; the surplus of each
    source is left out. Slots that the points did not give (a source far smaller than the distance of two points) follow
    after the last point.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("target").alias("t"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"]:
        return spark.createDataFrame([], "slot bigint, key string, rank bigint")
    every = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("target").over(every) / F.lit(total["t"])
    ranges = sources.where("target > 0").withColumn("hi", upto)
    ranges = ranges.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("key")), F.lit(0.0)))
    ranges = ranges.withColumn("hi", F.when(F.lead("hi").over(Window.orderBy("key")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    # as many cells as sources at least: all ranges together fill at most cells + sources rows, about two a cell
    grid = max(CELLS, total["n"])
    first, last = (F.least(F.floor(F.col(c) * grid), F.lit(grid - 1)).cast("long") for c in ("lo", "hi"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(first, last)))
    slots = int(total["t"] / block) + 1
    # a source of share s may lag a few slots behind, that is a few times 1 / s points
    slots += min(slots + 64, int(8 * total["t"] / total["least"]) + 1)
    point = (F.col("slot") + 0.5) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * grid).cast("long"))
    met = points.join(cells.select("key", "target", "lo", "hi", "cell"), "cell").where("u >= lo AND u < hi")
    placed = met.select("slot", "key", "target", F.floor(F.col("slot") / SLOTS).alias("part"))
    counts = cut_lineage(placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part").orderBy("slot")
    ranked = placed.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["key", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r")).where(F.col("rank") * block < F.round("target"))
    given = sources.where("target > 0").join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").select("key", "target", F.coalesce("n", F.lit(0)).alias("n"))
    numbered = given.withColumn("place", F.row_number().over(Window.orderBy("key"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy()))
    short = numbered.withColumn("wanted", F.ceil(F.round("target") / block)).where("n < wanted")
    late = short.withColumn("rank", F.explode(F.sequence(F.col("n"), F.col("wanted") - 1)))
    after = late.select((F.lit(slots) + F.col("rank") * F.col("of") + F.col("place")).alias("slot"), "key", "rank")
    return ranked.select("slot", "key", "rank").unionByName(after)


def laid_out(facts: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``: the words that precede a document in its source's shuffled order."""
    mixed = facts.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "mark")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    sums = mixed.groupBy("key", "part").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part").orderBy("h", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = mixed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(offsets, ["key", "part"]).withColumn("start", F.col("before") + F.col("within")).drop("h", "mark", "part", "before", "within")


def pieces(laid: DataFrame, block: int) -> DataFrame:
    """(key, rank, row, from_word, words): the parts of documents that make up each block, over all epochs needed."""
    goal = F.round("target").cast("long")
    epochs = F.ceil(goal / F.col("source_size")).cast("long")
    turned = laid.where("size > 0 AND target > 0").withColumn("goal", goal).withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    turned = turned.withColumn("at", F.col("start") + F.col("e") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), F.col("goal")))
    turned = turned.where("at < end")
    cut = turned.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    lo = F.greatest("at", F.col("rank") * block)
    hi = F.least("end", (F.col("rank") + 1) * block)
    return cut.select("key", "rank", "row", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"))


def facts_of(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, doc_id, key, size, mark) of documents; the key of a null source sorts last, the mark is a hash of the text."""
    source = field(source_col).cast("string")
    size = F.coalesce(F.regexp_count(field(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    return rows.select("row", field(id_col).alias("doc_id"), key.alias("key"), size.alias("size"), F.xxhash64(field(text_col)).alias("mark"))


def mixed(facts: DataFrame, weights: Sequence[int], block: int, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's target, and the mix itself: (slot, row, from_word, words)."""
    sizes = facts.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(targets(sizes, weights, max_epochs))
    laid = cut_lineage(laid_out(facts, seed).join(sources, "key"))
    slots = schedule(sources, block)
    mix = slots.join(pieces(laid, block), ["key", "rank"]).select("slot", "row", "from_word", "words")
    return laid, mix


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    block: int = BLOCK_WORDS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    slim = docs.select(cell(id_col).alias("doc_id"), cell(text_col).alias("text"), cell(source_col).alias("source"))
    doc = F.struct("doc_id", "text", "source").alias("doc")
    facts = cut_lineage(facts_of(slim.select(doc, F.monotonically_increasing_id().alias("row")), "doc_id", "text", "source"))
    laid, mix = mixed(facts, weights, block, max_epochs, seed)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    return laid.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """Whole documents, each as often as the mix takes it, rounded to the nearest number of times."""
    rows = rows_of(docs)
    facts = cut_lineage(facts_of(rows, id_col, text_col, source_col))
    laid, mix = mixed(facts, weights, BLOCK_WORDS, MAX_EPOCHS, seed)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = laid.select("row", "size").join(taken, "row").select("row", times.alias("times")).where("times > 0")
    return rows.join(often, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).select("doc.*")
