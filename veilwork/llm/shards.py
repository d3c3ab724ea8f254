"""Minimax contiguous shards over groups of equal texts.

Documents are sorted by a digest of their text, so equal texts lie together; such a group is never split. Groups larger than an
even share come first. In this order every group starts at a known number of bytes. The smallest feasible shard capacity is found by binary search:
a capacity is checked greedily, by filling one shard after the other up to the last group start within reach. The
cuts then follow, each at the group start nearest to an even share of what is left, as far as the capacity and the
shards still to come allow.

Only DataFrame operations touch rows. The driver holds a summary of bounded size: the sorted order is divided into at
most ``CELLS`` intervals, each with its first and last group start. Where an interval holds further starts, a check
gives bounds instead of an answer, and just the intervals that matter are divided again, until the answer is exact.
Positions come from one range sort of slim rows (texts do not travel) and the sums of its partitions; a group of
copies may spread over any number of partitions.

The law is ``bytes``. A null text has no bytes and lies with the empty texts; every document counts 16 bytes more.
Repeated rows and ids are placed each by itself. An empty table gives an empty result; with fewer groups than shards
some shards stay empty. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.common import cell, field, rows_of
from veilwork.session import cut_lineage

OVERHEAD = 16
CELLS = 65_536
_ROW_BITS = 33


def _facts(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    ]


def placed_rows(facts: DataFrame, large: list) -> DataFrame:
    """``facts`` (with size, grp, row) in group order: adds ``before`` (bytes), ``number`` (rows) and ``first`` (a group starts).

    The groups ``large`` come first, so that the rest is cut evenly.
    """
    ties = [c for c in ("doc_id", "row") if c in facts.columns]
    order = facts.orderBy(~F.col("grp").isin(large), "grp", *ties).withColumn("at", F.monotonically_increasing_id())
    frozen = cut_lineage(order).withColumn("part", F.shiftright("at", _ROW_BITS))
    parts = frozen.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max_by("grp", "at").alias("tail"))
    earlier = Window.orderBy("part")
    upto = earlier.rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    offsets = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("rows"),
        F.lag("tail").over(earlier).alias("tail"),
    )
    inside = Window.partitionBy("part").orderBy("at")
    joined = frozen.join(F.broadcast(offsets), "part")
    return joined.select(
        *[c for c in facts.columns if c != "grp"],
        (F.col("bytes") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"),
        (F.col("rows") + F.row_number().over(inside) - 1).alias("number"),
        (~F.coalesce(F.col("grp") == F.coalesce(F.lag("grp").over(inside), F.col("tail")), F.lit(False))).alias("first"),
    )


class Starts:
    """What the driver knows of the group starts: intervals with their first and last start and the number of starts."""

    def __init__(self, placed: DataFrame, total: int, cells: int = CELLS):
        self.rows = placed.where("first").select("before")
        self.total, self.cells = total, cells
        self.blocks = [*self._divide([(0, total - 1, 1)]), (total, total, 1)]
        self._index()

    def _index(self) -> None:
        self.lows = [b[0] for b in self.blocks]
        self.highs = [b[1] for b in self.blocks]

    def _divide(self, ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The intervals into which ranges (from, to, intervals so far) fall: at least twice as many, about ``cells`` in all."""
        whole = sum(b - a for a, b, _ in ranges) or 1
        keys = []
        for i, (a, b, n) in enumerate(ranges):
            width = (b - a) // max(2 * n, self.cells * (b - a) // whole) + 1
            keys.append(F.when(F.col("before").between(a, b), F.struct(F.lit(i).alias("i"), F.floor((F.col("before") - a) / width).alias("j"))))
        key = F.coalesce(*keys)
        rows = self.rows.where(key.isNotNull()).groupBy(key)
        found = rows.agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["lo"], r["hi"], r["n"]) for r in found)

    def refine(self, wanted: set[int]) -> None:
        """Divide the intervals ``wanted`` anew; neighbours are asked for together."""
        ranges: list[list[int]] = []
        for k in sorted(wanted):
            lo, hi, _ = self.blocks[k]
            if ranges and k - 1 in wanted:
                ranges[-1][1:] = [hi, ranges[-1][2] + 1]
            else:
                ranges.append([lo, hi, 1])
        kept = [b for k, b in enumerate(self.blocks) if k not in wanted]
        for at in range(0, len(ranges), 50):
            kept += self._divide([tuple(r) for r in ranges[at : at + 50]])
        self.blocks = sorted(kept)
        self._index()

    def open(self, k: int) -> bool:
        return self.blocks[k][2] > 2

    def last_upto(self, x: int, unsure: set[int]) -> tuple[int, int]:
        """Bounds of the last start at or below ``x``; an interval that leaves them apart goes to ``unsure``."""
        k = bisect_right(self.lows, x) - 1
        lo, hi, n = self.blocks[k]
        if x >= hi:
            return hi, hi
        if n <= 2:
            return lo, lo
        unsure.add(k)
        return lo, x

    def first_from(self, x: int, unsure: set[int]) -> tuple[int, int]:
        """Bounds of the first start at or above ``x``."""
        k = bisect_left(self.highs, x)
        lo, hi, n = self.blocks[k]
        if x <= lo:
            return lo, lo
        if n <= 2:
            return hi, hi
        unsure.add(k)
        return x, hi


def greedy(starts: Starts, capacity: int, shards: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Bounds of where each of ``shards`` shards of a capacity ends, filled greedily."""
    lo = hi = 0
    ends, unsure = [], set()
    for _ in range(shards):
        a, b = starts.last_upto(lo + capacity, unsure), starts.last_upto(hi + capacity, unsure)
        lo, hi = max(lo, a[0]), max(hi, b[1])
        ends.append((lo, hi))
    return ends, unsure


def smallest_capacity(starts: Starts, shards: int, largest: int) -> int:
    """The smallest capacity at which greedy filling needs no more than ``shards`` shards."""
    total = starts.total
    no, yes = max(-(-total // shards), largest) - 1, -(-total // shards) + largest
    while True:
        low, high = no, yes
        while high - low > 1:  # the smallest capacity that holds for certain
            mid = (low + high) // 2
            if greedy(starts, mid, shards)[0][-1][0] >= total:
                high = mid
            else:
                low = mid
        yes, low = high, no
        while high - low > 1:  # the largest that fails for certain
            mid = (low + high) // 2
            if greedy(starts, mid, shards)[0][-1][1] < total:
                low = mid
            else:
                high = mid
        no = low
        if yes - no <= 1:
            return yes
        first, last = greedy(starts, no + 1, shards)[0], greedy(starts, yes - 1, shards)[0]
        wanted = set()
        for (a, _), (_, b) in zip(first, last):
            wanted.update(k for k in range(max(0, bisect_right(starts.lows, a) - 1), bisect_right(starts.lows, b)) if starts.open(k))
        starts.refine(wanted)


def even_cuts(starts: Starts, shards: int, capacity: int) -> list[int]:
    """Where shards 1, 2, .. begin: as even as the capacity and the shards to come allow."""
    total = starts.total
    while True:
        unsure: set[int] = set()
        least = [total]  # from behind: the first start from which the last shards can hold the rest
        for _ in range(shards - 1):
            least.append(starts.first_from(max(0, least[-1] - capacity), unsure)[1])
        least = least[::-1]  # least[k]: shard k may begin no earlier
        at, cuts = 0, []
        for k in range(1, shards):
            ideal = at + (total - at) // (shards - k + 1)
            below, above = starts.last_upto(ideal, unsure)[0], starts.first_from(ideal, unsure)[1]
            near = below if ideal - below <= above - ideal and below > at else above
            at = max(at, min(max(near, least[k]), starts.last_upto(min(total, at + capacity), unsure)[0]))
            cuts.append(at)
        if not unsure:
            return cuts
        starts.refine({k for u in unsure for k in (u - 1, u, u + 1) if 0 <= k < len(starts.blocks) and starts.open(k)})


def cut_points(placed: DataFrame, shards: int, largest: int, cells: int = CELLS) -> list[int]:
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0]
    if total is None:
        return []
    starts = Starts(placed, total, cells)
    return even_cuts(starts, shards, smallest_capacity(starts, shards, largest))


def assigned(facts: DataFrame, shards: int) -> DataFrame:
    """``facts`` (row, size, grp and others) with ``shard`` and ``slot``."""
    groups = cut_lineage(facts.groupBy("grp").agg(F.sum("size").alias("s")))
    total, largest = groups.agg(F.sum("s"), F.max("s")).first()
    # groups above an even share: fewer than there are shards
    large = [r["grp"] for r in groups.where(F.col("s") * shards > F.lit(total or 0)).collect()]
    placed = cut_lineage(placed_rows(facts, large))
    cuts = cut_points(placed, shards, largest or 0)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("before") >= c).cast("int")
    numbered = placed.withColumn("shard", shard.cast("int"))
    begins = numbered.groupBy("shard").agg(F.min("number").alias("begin"))
    # at most one row per shard
    return numbered.join(F.broadcast(begins), "shard").withColumn("slot", F.col("number") - F.col("begin"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard and slot (gapless from 0 in each shard)."""
    facts = docs.select(cell(id_col).alias("doc_id"), *_facts(cell(text_col)))
    facts = cut_lineage(facts.withColumn("row", F.monotonically_increasing_id()))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return assigned(facts, shards).select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def sharded_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two columns more, ``shard`` and ``slot`` (``_shard`` and so on where a name is taken)."""
    rows = rows_of(docs)
    facts = cut_lineage(rows.select("row", field(id_col).alias("doc_id"), *_facts(field(text_col))))
    at = assigned(facts, shards).select("row", "shard", "slot")
    taken = {c.lower() for c in docs.columns}
    names = [("_" if n in taken else "") + n for n in ("shard", "slot")]
    return rows.join(at, "row").select("doc.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))
