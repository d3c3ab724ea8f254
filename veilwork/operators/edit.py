"""Table edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.operators.frames import spread_join


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def add_column(df: DataFrame, name: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default) if default is not None else F.lit(None).cast("string"))


def delete_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids`` (one column named like the key); null keys stay."""
    return spread_join(df, ids.select(key).where(F.col(key).isNotNull()).distinct(), [key], "left_anti")


def keep_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return spread_join(df, ids.select(key).where(F.col(key).isNotNull()).distinct(), [key], "left_semi")


def delete_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Delete rows that meet the condition; rows for which it is unknown stay."""
    test = F.expr(condition) if isinstance(condition, str) else condition
    return df.where(~F.coalesce(test, F.lit(False)))


def merge_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new, allowMissingColumns=True)


def combine_tagged(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    a = original.withColumn("_source", F.lit("original"))
    return a.unionByName(synthetic.withColumn("_source", F.lit("synthetic")), allowMissingColumns=True)


def sort_rows(df: DataFrame, column: str, key: str, ascending: bool = True, n: int = 100) -> DataFrame:
    """A sorted preview of n rows; ties by key."""
    order = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return df.orderBy(order, key).limit(n)
