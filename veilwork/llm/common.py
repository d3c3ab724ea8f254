"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.session import cut_lineage

#: Rows of one hot key that go to one task of a join.
ROWS_PER_SALT = 100_000


def cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` inside one column ``doc``, so that no name of theirs can clash with an operator's own."""
    return df.select(F.struct(*[cell(c) for c in df.columns]).alias("doc"))


def keyed(df: DataFrame) -> DataFrame:
    """``df`` written once as (doc, row): its columns as a struct and a number per row.

    The numbers are read back from the written table, so they stay the same when tasks are run again; repeated rows
    and null ids keep their own numbers.
    """
    return cut_lineage(packed(df).withColumn("row", F.monotonically_increasing_id()))


def rows_of(df: DataFrame) -> DataFrame:
    """``df`` as (doc, row): its columns as a struct and what tells its rows apart.

    Rows of a plain Parquet table are told apart by file and place in the file, which stay the same whenever the table
    is read, so nothing is copied. Any other input is written once, see ``keyed``.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        try:
            return df.select(
                F.struct(*[cell(c) for c in df.columns]).alias("doc"), F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("more"), index.alias("at")).alias("row")
            )
        except AnalysisException:  # a source without row numbers
            pass
    return keyed(df)


def field(name: str) -> Column:
    """A column inside ``doc``."""
    return F.col("doc").getField(name)


def bytes_of(column: pa.Array, at_once: int = 256) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow column, a few made at a time."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for i in range(0, len(raw), at_once):
        yield from raw.slice(i, at_once).to_pylist()


def star_join(edges: DataFrame, total: int, low: DataFrame) -> DataFrame:
    """``edges`` (a, b) joined with ``low`` (a, m, n): one row per node a, ``n`` of the ``total`` edges being its own.

    Nodes with more than a thousandth of all edges, and more than a task should hold, are at most a thousand and are
    broadcast by that bound; their edges are split by a hash of b and their row of ``low`` is repeated once per part.
    """
    least = max(ROWS_PER_SALT, total // 1000)
    parts = F.when(F.col("n") > least, F.ceil(F.col("n") / F.lit(ROWS_PER_SALT)).cast("int")).otherwise(F.lit(1))
    hot = F.broadcast(low.where(F.col("n") > least).select("a", parts.alias("_parts")))
    salt = F.coalesce(F.pmod(F.xxhash64("b"), F.col("_parts")), F.lit(0)).cast("int")
    salted = edges.join(hot, "a", "left").select("a", "b", salt.alias("_salt"))
    repeated = low.select("a", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    return salted.join(repeated, ["a", "_salt"]).drop("_salt")


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, spread: Sequence[str]) -> DataFrame:
    """Left join on ``key`` of many rows with one row per key, whose column ``n`` says how many rows ``left`` has.

    Keys holding more than a thousandth of all rows (at most a thousand keys, so they may be broadcast) are split
    by a hash of the columns ``spread``, into as many parts as their own count asks for; their partner is repeated
    once per part. ``n`` is not returned. Keys must not be null.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    parts = F.ceil(F.col(n) / F.lit(ROWS_PER_SALT)).cast("int")
    hot = F.broadcast(right.where(F.col(n) * 1000 > F.lit(total)).select(key, parts.alias("_parts")))
    salt = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*spread), F.col("_parts"))).otherwise(F.lit(0)).cast("int")
    salted = left.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.when(F.col("_parts") > 1, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(0)))
    # written, so that its size is known and few keys are broadcast
    repeated = cut_lineage(right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_parts", n))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
