"""Size checks taken from the optimiser's own statistics, before a plan is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT = 32 << 20
SPREAD_LIMIT = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df`` from file listings; no job runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def fits(df: DataFrame, limit: int) -> bool:
    return estimated_bytes(df) <= limit


def spread_small(df: DataFrame, limit: int = SPREAD_LIMIT) -> DataFrame:
    """Deal a small table out to all cores.

    A file with a single row group is read by one task, however many cores wait. Tables above the limit have splits
    of their own and pass unchanged, so nothing is shuffled at scale. Rows are dealt by the hash of their place: dealing
    them in turn would first sort all rows of the file in the one task that reads them.
    """
    if not fits(df, limit):
        return df
    taken, place = {c.lower() for c in df.columns}, "_place"
    while place in taken:
        place += "_"
    placed = df.withColumn(place, F.monotonically_increasing_id())
    return placed.repartition(df.sparkSession.sparkContext.defaultParallelism, place).drop(place)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the statistics prove the side small; otherwise leave the choice to AQE."""
    return F.broadcast(df) if fits(df, limit) else df
