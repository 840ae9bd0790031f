"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A query's shuffle files go at its end; without this they stay until the driver happens to collect garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """The field `name` of `df`, nullable and perhaps renamed, for an output schema."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, led by as many underscores as it takes not to clash with a column of `df`."""
    while name in df.columns:
        name = "_" + name
    return name


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's spark.checkpoint.dir; a temporary folder where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="obsframe-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return a reader of it."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "table", folder: str | None = None) -> DataFrame:
    """Write `df` to the shared checkpoint folder, or to `folder`, as compressed Parquet and return a reader of it: for
    tables with texts, and for those of which later steps read some columns only. Its shuffle files go when it is written."""
    path = f"{folder}/{name}" if folder else shared_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(FREES_SHUFFLES, "false")
    conf.set(FREES_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(FREES_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        start, size = 0, 0
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for row, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


class Memo:
    """A worker's bounded memory of results by word: two generations of at most `limit` entries
    and one batch each; the older one goes when the younger one is full."""

    def __init__(self, limit: int, compute: Callable[[list[str]], Iterable]):
        self.limit, self.compute = limit, compute
        self.young: dict = {}
        self.old: dict = {}

    def over(self, words: set[str]) -> dict:
        """A dict that holds the result of each of `words`."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new = words.difference(self.young)
        for w in new.intersection(self.old):
            self.young[w] = self.old[w]
        new.difference_update(self.young)
        if new:
            todo = list(new)
            self.young.update(zip(todo, self.compute(todo), strict=True))
        return self.young
