"""Choosing bands, dates, metadata and places, all as predicates that Spark can push to the scan where the format allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.functions import meta


def select_bands(df: DataFrame, names: Mapping[str, str], band: str = "event_type") -> DataFrame:
    """Rows of the bands in `names` (old to new), renamed; the filter is on the stored names, so it is pushed down."""
    renamed = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col(band)]
    return df.where(F.col(band).isin(*names)).withColumn(band, renamed)


def filter_date(df: DataFrame, start: datetime, end: datetime, time: str = "ts") -> DataFrame:
    """start <= time < end, as a range of plain timestamps rather than of a day computed from them."""
    return df.where((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) < F.lit(end).cast("timestamp_ntz")))


def filter_meta(df: DataFrame, path: str, low: int | None = None, high: int | None = None, among: Sequence[int] | None = None, column: str = "props") -> DataFrame:
    """Rows whose whole-number metadata value lies in [low, high] and in `among`; other values don't match."""
    value = meta(path, column).try_cast("bigint")
    if low is not None:
        df = df.where(value >= low)
    if high is not None:
        df = df.where(value <= high)
    return df if among is None else df.where(value.isin(*among))


def mask(df: DataFrame, keep: Column, value: str = "value") -> DataFrame:
    """`value` where `keep` holds, else null."""
    return df.withColumn(value, F.when(keep, F.col(value)))
