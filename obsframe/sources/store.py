"""Storing pulls by day, and exchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.streaming import shared_folder


def write_days(df: DataFrame, path: str, time: str = "ts") -> None:
    """Write by day; days that are in `df` are replaced, all others stay. Rows of one day are dealt to as
    many tasks as their size asks for, so a large day doesn't end in one file."""
    dated = df.withColumn("day", F.col(time).cast("date")).hint("rebalance", "day")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored rows from `first` to `last` day inclusive; only those days' folders are read."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    return df.where(F.col("day") <= F.lit(last).cast("date")) if last else df


#: Options under which text formats give back what was written: nulls and empty texts apart, whole microseconds.
_TIME = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OPTIONS = {"csv": {"header": "true", "escape": '"', "nullValue": "\\N", **_TIME}, "json": _TIME, "orc": {}, "parquet": {}}


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write as csv, json, orc or parquet."""
    df.write.mode("overwrite").options(**_OPTIONS[kind]).format(kind).save(path)


def read_export(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Read what `export` wrote; the schema is given, so no file is read to infer it."""
    return spark.read.options(**_OPTIONS[kind]).schema(schema).format(kind).load(path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared checkpoint folder and return a reader of it: what comes behind survives lost executors and
    doesn't repeat what came before."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
