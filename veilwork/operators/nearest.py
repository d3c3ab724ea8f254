"""Exact nearest rows between whole tables.

The pool is cut by a k-d tree whose split planes come from a bounded sample. Every probe first searches the leaf it
lies in; the distance found there is an upper bound, so that only leaves whose box is no farther away can hold a nearer
row, and the probe is sent to just those. Both searches are joins on the leaf number, in groups of bounded size: leaves
hold about equal shares of the pool, and the probes of a crowded leaf are dealt over copies of it. Inside a group, blocks
of neighbouring rows are compared with blocks, nearest first, until the next block is too far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.operators.frames import number_cell
from veilwork.session import cut_lineage

#: Pool rows of a leaf, until there are ``LEAVES`` of them; then leaves grow. Their planes and boxes travel to the tasks.
LEAF_ROWS, LEAVES = 4_000, 4_096
#: Rows per leaf in the sample that the planes are taken from: at most ``LEAVES * SAMPLED`` rows reach the driver.
SAMPLED = 64
#: Probes that search one copy of a leaf.
PROBES = 50_000
_BLOCK = 96


class Tree:
    """Split planes over ``k`` columns, and the box of each node."""

    def __init__(self, sample: np.ndarray, k: int, leaves: int):
        self.k, self.nodes, self.low, self.high, self.leaves = k, [], [], [], 0
        self._grow(sample.reshape(-1, k), np.full(k, -np.inf), np.full(k, np.inf), leaves)
        self.low, self.high = np.array(self.low).reshape(-1, k), np.array(self.high).reshape(-1, k)
        table = np.array(self.nodes, dtype=float)  # column, value, left, right; column -1 marks a leaf with its number
        self.column, self.value = table[:, 0].astype(int), table[:, 1]
        self.left, self.right = table[:, 2].astype(int), table[:, 3].astype(int)

    def _grow(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        self.low.append(low)
        self.high.append(high)
        if leaves > 1 and len(points) > 1:
            for column in np.argsort(-np.ptp(points, axis=0), kind="stable"):
                values = np.sort(points[:, column])
                value = values[len(values) * (leaves // 2) // leaves]
                below = points[:, column] < value
                if below.any() and not below.all():
                    inner, outer = high.copy(), low.copy()
                    inner[column] = outer[column] = value
                    left = self._grow(points[below], low, inner, leaves // 2)
                    right = self._grow(points[~below], outer, high, leaves - leaves // 2)
                    self.nodes[at] = (column, value, left, right)
                    return at
        self.nodes[at] = (-1, 0.0, self.leaves, 0)
        self.leaves += 1
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := np.flatnonzero(self.column[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, self.column[node]] < self.value[node], self.left[node], self.right[node])
        return self.left[at]

    def within(self, x: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose box is no farther than each row's squared distance.

        Rows go down from the root and leave the nodes that are too far, so that far leaves cost nothing.
        """
        rows, leaves = [], []
        for lo in range(0, len(x), 1024):
            part, limit = x[lo : lo + 1024], d2[lo : lo + 1024] * (1 + 1e-12)
            row, at = np.arange(len(part)), np.zeros(len(part), int)
            while len(row):
                gap = 0.0
                for c in range(self.k):
                    gap = gap + np.maximum(0, np.maximum(self.low[at, c] - part[row, c], part[row, c] - self.high[at, c])) ** 2
                near = gap <= limit[row]
                row, at = row[near], at[near]
                done = self.column[at] < 0
                rows.append(row[done] + lo)
                leaves.append(self.left[at[done]])
                row, at = row[~done], at[~done]
                row, at = np.concatenate([row, row]), np.concatenate([self.left[at], self.right[at]])
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in blocks of neighbours, by halving the widest column."""
    done, waiting = [], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= _BLOCK:
            done.append(np.sort(rows))
            continue
        column, half = int(np.argmax(np.ptp(x[rows], axis=0))), len(rows) // 2
        order = np.argpartition(x[rows, column], half)
        waiting += [rows[order[:half]], rows[order[half:]]]
    return done


def search(pool: np.ndarray, probes: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, pool row) of the nearest pool row within ``bound`` of each probe; -1 where there is none.

    Ties go to the first pool row; the pool row numbered ``own`` is no neighbour of its probe.
    """
    best, who = bound.copy(), np.full(len(probes), -1)
    if not len(pool) or not len(probes):
        return best, who
    blocks = _blocks(pool)
    low, high = np.array([pool[b].min(axis=0) for b in blocks]), np.array([pool[b].max(axis=0) for b in blocks])
    for rows in _blocks(probes):
        x = probes[rows]
        gap = (np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high)) ** 2).sum(axis=1)
        near, at = best[rows], who[rows]
        for b in np.argsort(gap, kind="stable"):
            if gap[b] > near.max() * (1 + 1e-12):
                break
            some = blocks[b]
            d = np.zeros((len(rows), len(some)))
            for c in range(pool.shape[1]):
                d += (x[:, c, None] - pool[some, c]) ** 2
            d[own[rows, None] == some] = np.inf
            first = d.argmin(axis=1)
            found, row = d[np.arange(len(rows)), first], some[first]
            better = (found < near) | ((found == near) & np.isfinite(found) & ((at < 0) | (row < at)))
            near, at = np.where(better, found, near), np.where(better, row, at)
        best[rows], who[rows] = near, at
    return best, who


def points(df: DataFrame, key: str, columns: Sequence[str], scale: Sequence[float], extra: Sequence[Column] = ()) -> DataFrame:
    """(key, x0.., extra): the named numbers in units of ``scale``, null as 0."""
    xs = [(F.coalesce(number_cell(df, c), F.lit(0.0)) / F.lit(s)).alias(f"x{i}") for i, (c, s) in enumerate(zip(columns, scale))]
    return df.select(F.col(key).alias("key"), *xs, *extra)


def nearest_points(probes: DataFrame, pool: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(probe, dist, key, label) for probes (key, x0..) and pool (key, x0.., label): the nearest pool row of every probe.

    Keys are unique on each side. Ties go to the smallest key; ``exclude_self`` leaves out the pool row of the same key.
    Probes without any neighbour are left out. At most two pool rows of one place are kept: no other can be an answer.
    """
    xs = [f"x{i}" for i in range(k)]
    first = Window.partitionBy(*xs).orderBy("key")
    pool = cut_lineage(pool.select("key", *xs, "label").withColumn("_n", F.row_number().over(first)).where("_n <= 2").drop("_n"))
    probes = cut_lineage(probes.select(F.col("key").alias("probe"), *xs))
    many = pool.count()
    leaves = max(1, min(LEAVES, many // LEAF_ROWS))
    share = min(1.0, SAMPLED * leaves / max(1, many))
    rows = pool.select(*xs).sample(share, seed=1).collect() if leaves > 1 else []
    tree = Tree(np.array([list(r) for r in rows], dtype=float), k, leaves)

    def placed(df: DataFrame) -> DataFrame:
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(leaf=tree.leaf(pdf[xs].to_numpy(float)))

        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(place, f"{names}, leaf bigint")

    pool = cut_lineage(placed(pool))
    kinds = {"probe": probes.schema["probe"].dataType.simpleString(), "key": pool.schema["key"].dataType.simpleString()}
    found = cut_lineage(_search_leaves(placed(probes).withColumn("bound", F.lit(float("inf"))), pool, xs, kinds, exclude_self))

    def farther(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[xs].to_numpy(float)
            row, leaf = tree.within(x, pdf["bound"].to_numpy(float))
            other = leaf != tree.leaf(x)[row]
            yield pdf.iloc[row[other]].assign(leaf=leaf[other])

    bounded = probes.join(found.select("probe", F.col("d2").alias("bound")), "probe", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    sent = cut_lineage(bounded.mapInPandas(farther, f"probe {kinds['probe']}, {', '.join(x + ' double' for x in xs)}, bound double, leaf bigint"))
    every = found.union(_search_leaves(sent, pool, xs, kinds, exclude_self))
    best = every.groupBy("probe").agg(F.min(F.struct("d2", "key", "label")).alias("b"))
    return best.select("probe", F.sqrt("b.d2").alias("dist"), F.col("b.key").alias("key"), F.col("b.label").alias("label"))


def _search_leaves(probes: DataFrame, pool: DataFrame, xs: list[str], kinds: dict[str, str], exclude_self: bool) -> DataFrame:
    """(probe, d2, key, label) of probes (probe, x0.., bound, leaf) in the pool rows of the same leaf."""
    # one row per leaf
    parts = {r["leaf"]: -(-r["n"] // PROBES) for r in probes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = {n: F.lit(None).cast(t).alias(n) for n, t in kinds.items()}
    crowded = {leaf: n for leaf, n in parts.items() if n > 1}
    split = F.lit(1)
    if crowded:
        split = F.coalesce(F.create_map(*[F.lit(v) for pair in crowded.items() for v in pair])[F.col("leaf")], F.lit(1))
    left = probes.select("leaf", F.pmod(F.xxhash64("probe"), split).cast("int").alias("part"), "probe", none["key"], F.lit(None).cast("string").alias("label"), "bound", *xs)
    wanted = pool.where(F.col("leaf").isin(*parts)) if len(parts) < LEAVES // 4 else pool
    right = wanted.select(
        "leaf", F.explode(F.sequence(F.lit(0), (split - 1).cast("int"))).alias("part"), none["probe"], "key", "label", F.lit(None).cast("double").alias("bound"), *xs
    )

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        is_probe = pdf["probe"].notna().to_numpy()
        asked, held = pdf[is_probe], pdf[~is_probe].sort_values("key", kind="stable")
        own = np.full(len(asked), -1)
        if exclude_self and len(held):
            keys, wanted = held["key"].to_numpy(), asked["probe"].to_numpy()
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            own = np.where(keys[at] == wanted, at, -1)
        d2, who = search(held[xs].to_numpy(float), asked[xs].to_numpy(float), own, asked["bound"].to_numpy(float))
        hit = who >= 0
        near = held.iloc[who[hit]]
        return pd.DataFrame({"probe": asked["probe"].to_numpy()[hit], "d2": d2[hit], "key": near["key"].to_numpy(), "label": near["label"].to_numpy()})

    both = left.unionByName(right)
    return both.groupBy("leaf", "part").applyInPandas(group, f"probe {kinds['probe']}, d2 double, key {kinds['key']}, label string")
