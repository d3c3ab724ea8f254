"""SimHash near duplicates by a generalised pigeonhole.

Every text becomes a 64-bit fingerprint. Two fingerprints link at ``max_bits`` or fewer differing bits; components of
links are groups of near duplicates.

Search: the bits are grouped into partitions, correlated bits together. Partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = max_bits + 1. If two fingerprints differed by more than t_i bits in every partition i, they would
differ by at least sum(t_i + 1) > max_bits bits in all; so each linked pair agrees up to t_i bits in some partition,
and is found when one of them probes all values within t_i bits of its own. The thresholds, and the number of
partitions, are chosen by dynamic programming over estimated numbers of probes and candidates. The estimate rests on a
bounded sample of fingerprints and on all bit correlations; it steers cost only, every choice finds every link.

Candidates meet in buckets. Buckets are read as a sorted stream, verified in blocks of bounded size, and give only a
spanning star per group of links, never all pairs. Members of a bucket beyond ``bucket_cap`` are set aside and compared
in a second pass, block against block, so that nothing is lost and no task holds more than two blocks.

Null texts count as empty; texts without a word have fingerprint zero and link like any other. A component's id is its
smallest document id that is not null (null if there is none). Repeated rows come out as often as they go in. An empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veilwork.llm.common import bytes_of, field, hot_join, rows_of, star_join
from veilwork.session import cut_lineage

BITS = 64
SEED = 42
#: Members of a bucket that one task compares with each other in the first pass.
BUCKET_CAP = 20_000
#: Fingerprints in the sample from which candidate counts are estimated.
SAMPLE = 2_048
#: Numbers of partitions to choose from, and the cost of a compared pair in probes.
PARTITIONS = (2, 3, 4, 5)
PAIR_COST = 0.02


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of one UTF-8 text: A-Z lower-cased, shingles of ``width`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    values = np.array(hashes, dtype="<u8")
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    out = np.array([fingerprint(t or b"") for t in bytes_of(texts)], dtype=np.uint64)
    return pa.array(out.view(np.int64))


# ---- partitions and thresholds ------------------------------------------------------------------------------------


def bit_table(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per fingerprint, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(prints: DataFrame) -> np.ndarray:
    """The absolute correlation of every two bits over all distinct fingerprints, summed up in the tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            x = bit_table(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        cells = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["i", "v"])

    found = prints.select("fp").mapInArrow(sums, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not found:
        return np.eye(BITS)
    cells = np.zeros(BITS * BITS + 1)
    for r in found:
        cells[r["i"]] = r["v"]
    n = max(cells[-1], 1.0)
    both = cells[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both - np.outer(mean, mean)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each starts with the freest bit most tied to the others and grows by the bit most tied to it."""
    free = list(range(BITS))
    groups = []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    total, part = 0, 1
    for k in range(radius + 1):
        total += part
        part = part * (width - k) // (k + 1)
    return total


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, max_bits: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with sum(t + 1) = max_bits + 1, by dynamic programming over the partitions."""
    bits = bit_table(sample).astype(np.float32)
    need = max_bits + 1
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * need
    for group in groups:
        x = bits[:, group]
        ones = x.sum(axis=1)
        apart = np.rint(ones[:, None] + ones[None, :] - 2 * (x @ x.T))[np.triu_indices(len(x), 1)]
        cost = [0.0]
        for t in range(min(max_bits, len(group)) + 1):
            seen = float((apart <= t).mean()) if len(apart) else 0.0
            chance = max(seen, ball(len(group), t) / 2.0 ** len(group))
            cost.append(n * ball(len(group), t) + PAIR_COST * chance * n * n / 2)
        after: list[tuple[float, list[int]] | None] = [None] * (need + 1)
        for used, state in enumerate(best):
            if state is None:
                continue
            for given, c in enumerate(cost):
                if used + given <= need and (after[used + given] is None or state[0] + c < after[used + given][0]):
                    after[used + given] = (state[0] + c, [*state[1], given - 1])
        best = after
    return best[need] or (float("inf"), [])


def plan_search(prints: DataFrame, n: int, max_bits: int) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds of least estimated cost."""
    corr = bit_correlations(prints)
    rows = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    plans = []
    for m in PARTITIONS:
        groups = group_bits(corr, m)
        cost, thresholds = allocate(groups, sample, n, max_bits)
        plans.append((cost, groups, thresholds))
    return min(plans, key=lambda p: p[0])[1:]


# ---- candidates ---------------------------------------------------------------------------------------------------


def probes(prints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, value, own, fp): for each partition all values within its threshold; ``own`` marks a fingerprint's own value."""
    plan = []
    for part, (group, t) in enumerate(zip(groups, thresholds)):
        masks = [0]
        if t >= 0:
            layer = [(0, -1)]
            for _ in range(t):
                layer = [(m | 1 << b, k) for m, last in layer for k, b in enumerate(group) if k > last]
                masks += [m for m, _ in layer]
            plan.append((part, sum(1 << b for b in group), np.array(masks, dtype=np.uint64)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, mask, flips in plan:
                for at in range(0, len(fp), 2000):
                    some = fp[at : at + 2000]
                    values = ((some & np.uint64(mask))[:, None] ^ flips[None, :]).ravel()
                    own = np.tile(flips == 0, len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), part, np.int32)), pa.array(values.view(np.int64)), pa.array(own), pa.array(np.repeat(some, len(flips)).view(np.int64))],
                        names=["part", "value", "own", "fp"],
                    )

    return prints.select("fp").mapInArrow(spread, "part int, value bigint, own boolean, fp bigint")


def linked_pairs(bucket: np.ndarray, own: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs within buckets of bounded size; ``bucket`` numbers the buckets in ascending order."""
    ends = np.searchsorted(bucket, bucket, side="right")
    left, right = [], []
    at = np.arange(len(fp))
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        other = at + step
        hit = (own[at] | own[other]) & (np.bitwise_count(fp[at] ^ fp[other]) <= max_bits)
        left.append(at[hit])
        right.append(other[hit])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (at, at)


def grown_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large bucket: groups grow from a member, each time among the members not yet reached."""
    rest = np.arange(len(fp))
    left, right = [], []
    while len(rest):
        front = [int(rest[0])]
        rest = rest[1:]
        while front and len(rest):
            here = front.pop()
            near = np.bitwise_count(fp[rest] ^ fp[here]) <= max_bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), here))
                right.append(found)
                front.extend(found.tolist())
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint with the smallest one of its group, within what one task has seen at a time."""
    nodes, spot = np.unique(fp[np.concatenate((left, right))], return_inverse=True)
    a, b = spot[: len(left)], spot[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def bucket_links(rows: DataFrame, keys: list[str], max_bits: int, cap: int | None) -> DataFrame:
    """(fp, root) for links inside buckets; members of a bucket beyond ``cap`` come out unlinked, with ``value`` and ``part`` set.

    ``rows`` is dealt out by the bucket and sorted, so a task holds one batch and one unfinished bucket at a time.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fp", pa.int64()), ("root", pa.int64()), ("part", pa.int32()), ("value", pa.int64()), ("own", pa.bool_())])
        held: list[np.ndarray] | None = None
        full: tuple | None = None  # the key of a bucket whose further members are set aside

        def out(some: list[np.ndarray], n_keys: int):
            key = np.zeros(len(some[0]), bool)
            for k in some[:n_keys]:
                key[1:] |= k[1:] != k[:-1]
            bucket = np.cumsum(key)
            own, fp = some[n_keys], some[n_keys + 1].view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:])))
            sizes = np.diff(np.append(starts, len(fp)))
            large = sizes > 512
            small = ~np.repeat(large, sizes)
            i, j = linked_pairs(bucket[small], own[small], fp[small], max_bits)
            pos = np.flatnonzero(small)
            left, right = [pos[i]], [pos[j]]
            for s, n in zip(starts[large], sizes[large]):
                i, j = grown_links(fp[s : s + n], max_bits)
                left.append(s + i)
                right.append(s + j)
            node, root = stars(fp, np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64))
            none = pa.nulls(len(node), pa.int32()), pa.nulls(len(node), pa.int64()), pa.nulls(len(node), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64)), *none], schema=schema)

        n_keys = len(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys + 2)]
            if full is not None:
                same = np.logical_and.reduce([k == v for k, v in zip(now, full)])
                if same.any():
                    yield aside(now, same, schema)
                    now = [x[~same] for x in now]
                if not len(now[0]):
                    continue
                full = None
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.logical_and.reduce([k == k[-1] for k in now[:n_keys]])
            cut = int(np.argmax(last))
            if cut:
                yield out([x[:cut] for x in now], n_keys)
            held = [x[cut:] for x in now]
            if cap is not None and len(held[0]) > cap:
                full = tuple(k[0] for k in held[:n_keys])
                yield aside(held, np.ones(len(held[0]), bool), schema)
                held = None
        if held is not None and len(held[0]):
            yield out(held, n_keys)

    def aside(some, which, schema):
        part, value, own, fp = (x[which] for x in some)
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(part), pa.array(value), pa.array(own)], schema=schema)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "own", "fp").mapInArrow(links, "fp bigint, root bigint, part int, value bigint, own boolean")


def all_links(prints: DataFrame, n: int, max_bits: int, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(fp, root): links that span every group of linked fingerprints."""
    groups, thresholds = plan_search(prints, n, max_bits)
    first = cut_lineage(bucket_links(probes(prints, groups, thresholds), ["part", "value"], max_bits, bucket_cap))
    done = first.where(F.col("root").isNotNull()).select("fp", "root").distinct()
    left = first.where(F.col("root").isNull()).select("part", "value", "own", "fp")
    sizes = left.groupBy("part", "value").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_cap / 2)).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return done
    # block against block: a member goes to each pair of blocks that its own block is part of
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = left.join(sizes, ["part", "value"]).withColumn("b", block)
    paired = placed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "value", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"), "own", "fp"
    )
    more = bucket_links(paired, ["part", "value", "low", "high"], max_bits, None)
    return done.union(more.select("fp", "root")).distinct()


# ---- components ---------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(fp, root): every linked fingerprint that is not the smallest of its component, with the smallest one.

    Alternating large-star and small-star steps; each step's table is written, so lineage stays short and lost
    executors cost one step. A step takes minima per node, which are combined before the shuffle; the edges of a node
    that a large part of all edges meet in are split over tasks.
    """
    edges = cut_lineage(links.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = (state["n"], state["h"])
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = star_join(both, 2 * state["n"], low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # at most as many edges as before: an edge gives one at its larger end
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        own = low.select("a", F.col("m").alias("b"))
        rest = star_join(large, state["n"], low).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(own.union(rest).distinct())


def near_groups(docs: DataFrame, row: list[str], width: int = 4, max_bits: int = 4, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """``docs`` (doc_id, text and the columns ``row``) to (row.., doc_id, fp, root, component_id).

    Equal fingerprints are one node from the start, so exact copies are never compared.
    """
    prints = cut_lineage(docs.select(*row, "doc_id", fingerprints("text").alias("fp")))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")))
    roots = components(all_links(nodes, nodes.count(), max_bits, bucket_cap))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = cut_lineage(hot_join(rooted, firsts, "root", "members", ["fp"]).select("fp", "n", "root", "component_id"))
    return hot_join(prints, known, "fp", "n", [*row, "doc_id"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = near_groups(slim, [], width, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of every group: the one with the smallest id, then the first row."""
    rows = rows_of(docs)
    slim = rows.select("row", field(id_col).alias("doc_id"), field(text_col).alias("text"))
    found = near_groups(slim, ["row"], width, max_bits)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k"))
    return rows.join(kept.select(F.col("k.row").alias("row")), "row", "left_semi").select("doc.*")
