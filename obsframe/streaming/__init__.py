"""Structured Streaming over observations.

A plan here is a streaming DataFrame; `drain` runs it over what is there now
and returns what came out. Append mode gives a window once the watermark
has passed its end, so the last windows stay open.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's spark.checkpoint.dir; a temporary one where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="obsframe-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """A Parquet table, one file or a folder, as a stream; timestamps without zone become UTC ones, as watermarks need them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # as a pattern, since a plain path must be a folder
    df = spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return df.withColumn(time, F.col(time).cast("timestamp"))


def run_through(sink: DataStreamWriter, steps: bool = False) -> None:
    """Run a stream over all that is there now. `steps`: for sources that say themselves how much a batch takes, which
    a single look at what is available would pass over."""
    if not steps:
        sink.trigger(availableNow=True).start().awaitTermination()
        return
    running = sink.start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def drain(df: DataFrame, name: str, steps: bool = False) -> DataFrame:
    """Run a stream in append mode over all that is there now, into a Parquet table; returns the table."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    sink = df.writeStream.outputMode("append").format("parquet")
    run_through(sink.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows"), steps)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as timers need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def tumbling_counts(df: DataFrame, size: str, delay: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Rows per window and key; rows later than `delay` may be dropped."""
    counts = df.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, gap: str, delay: str, key: str, time: str = "ts") -> DataFrame:
    """Runs of rows with less than `gap` between them, per key."""
    grouped = df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drop_repeats(df: DataFrame, key: str, delay: str, time: str = "ts") -> DataFrame:
    """The first row of each id; repeats more than `delay` apart may both come through, so state stays bounded."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def match_within(left: DataFrame, right: DataFrame, site: str, tolerance: str, time: str = "ts", key: str = "event_id") -> DataFrame:
    """Pairs of one site at most `tolerance` apart; the watermarks bound what either side holds."""
    a = left.select(F.col(site), F.col(key).alias("left_id"), F.col(time).alias("left_time")).withWatermark("left_time", tolerance)
    b = right.select(F.col(site).alias("_site"), F.col(key).alias("right_id"), F.col(time).alias("right_time")).withWatermark("right_time", tolerance)
    near = f"{site} = _site AND right_time BETWEEN left_time - INTERVAL {tolerance} AND left_time + INTERVAL {tolerance}"
    return a.join(b, F.expr(near)).select(site, "left_id", "right_id")


def store_new(df: DataFrame, path: str, state: str, steps: bool = False) -> None:
    """Append what the stream has not stored yet. Each batch writes a folder of its own, so a batch that
    is run again replaces its own rows only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_through(df.writeStream.foreachBatch(write).option("checkpointLocation", state), steps)


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n): after each batch the rows seen so far, for the keys in it; update mode. The state is one number a key."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def drain_latest(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Run an update-mode stream over all that is there now; per key the largest value that came out."""
    folder = shared_folder(df.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/rows").groupBy(key).agg(F.max(value).alias(value))
