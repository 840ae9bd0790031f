"""Composites: one observation a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 1) -> DataFrame:
    """The first `limit` rows of each group; Spark cuts each task's groups to the limit before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def latest(df: DataFrame, keys: Sequence[str], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The most recent row of each group; of equal times the one with the larger id."""
    return first_by(df, keys, [F.desc(time), F.desc(tie)])


def best(df: DataFrame, keys: Sequence[str], by: str = "value", tie: str = "event_id") -> DataFrame:
    """The row with the highest value of each group, nulls last; of equal values the one with the smaller id."""
    return first_by(df, keys, [F.desc_nulls_last(by), F.asc(tie)])


def sample_hash(df: DataFrame, key: str, share: float) -> DataFrame:
    """The same share of rows on every run: those whose md5 of `key`, read as hexadecimal digits, is low enough."""
    return df.where(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < f"{round(share * 2**32):08x}")


def sample_strata(df: DataFrame, keys: Sequence[str], k: int, key: str) -> DataFrame:
    """k rows of each stratum, in the order of the md5 of `key`."""
    return first_by(df, keys, [F.md5(F.col(key).cast("string")), F.col(key)], k)


def merge(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row an id from two pulls whose columns may differ; where both have a value the larger one counts."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in both.columns if c != key))


def new_rows(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't stored yet."""
    return df.join(stored.select(key).distinct(), key, "left_anti")
