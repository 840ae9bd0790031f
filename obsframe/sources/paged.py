"""A paged service as a Spark source, in batch and as a stream.

The caller brings the service: its ordered keys (days, arrivals) and
`fetch(key, cursor)`, which gives one page of a key's rows and the cursor of the
next page (None behind the last one). A key is one partition; its pages go to
Spark one by one as Arrow batches, so a task holds a page, however many a key
has. As a stream, the offset is the number of keys that were read: the keys
between two offsets are always the same, so a batch that is run again, or a
stream that starts from an old offset, gets the same rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: One page of a key's rows, and the cursor of the next page.
Page = tuple[pa.RecordBatch, object]
Fetch = Callable[[object, object], Page]

#: Comparisons with a literal; a null key, or a comparison with null, doesn't hold.
_TESTS: dict[type, Callable] = {
    EqualTo: lambda key, v: key == v,
    EqualNullSafe: lambda key, v: key == v,
    In: lambda key, v: key in v,
    GreaterThan: lambda key, v: key > v,
    GreaterThanOrEqual: lambda key, v: key >= v,
    LessThan: lambda key, v: key < v,
    LessThanOrEqual: lambda key, v: key <= v,
}


@dataclass
class Service:
    """schema: of the rows, as Spark writes it. keys: in the order in which a stream reads them. column: the one that holds the
    key, for filters. tries: of a page; the pause before each further one doubles."""

    schema: str
    keys: Sequence
    fetch: Fetch
    column: str = "day"
    tries: int = 4
    pause: float = 0.2

    def page(self, key: object, cursor: object) -> Page:
        for n in range(self.tries):
            try:
                return self.fetch(key, cursor)
            except OSError:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**n)
        raise ValueError("a page is tried once at least")

    def pages(self, key: object) -> Iterator[pa.RecordBatch]:
        cursor = None
        while True:
            batch, cursor = self.page(key, cursor)
            yield batch
            if cursor is None:
                return


@dataclass
class Key(InputPartition):
    key: object


class PagesReader(DataSourceReader):
    def __init__(self, service: Service):
        self.service, self.keys = service, list(service.keys)

    def partitions(self) -> list[Key]:
        return [Key(k) for k in self.keys]

    def read(self, partition: Key | None) -> Iterator[pa.RecordBatch]:
        # without any partition Spark reads once with None
        return self.service.pages(partition.key) if partition else iter(())


class FilteredReader(PagesReader):
    """Filters on the key column drop whole keys before anything is fetched; Spark checks all other filters itself."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            test = _TESTS.get(type(f))
            if test and f.attribute == (self.service.column,):
                self.keys = [k for k in self.keys if f.value is not None and test(k, f.value)]
            else:
                yield f


class PagesStreamReader(DataSourceStreamReader):
    """Offset {"keys": n}: the first n keys were read. `per_batch` keys a batch at most; None: all there are."""

    def __init__(self, service: Service, start: int, per_batch: int | None):
        self.service, self.start, self.per_batch, self.at = service, start, per_batch, start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"keys": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        # asked twice about one batch it says the same; it moves on once a batch is planned
        return {"keys": len(self.service.keys) if self.per_batch is None else min(self.at + self.per_batch, len(self.service.keys))}

    def partitions(self, start: dict, end: dict) -> list[Key]:
        self.at = max(self.at, end["keys"])
        return [Key(k) for k in self.service.keys[start["keys"] : end["keys"]]]

    def read(self, partition: Key) -> Iterator[pa.RecordBatch]:
        return self.service.pages(partition.key)


def register_pages(spark: SparkSession, name: str, service: Service) -> None:
    """Make `name` a format of spark.read and spark.readStream.

    Batch filters reach the source if spark.sql.python.filterPushdown.enabled is set by now; it must stay so. Options of a stream: `start`, the number of
    keys left out at first (it counts where a stream has no checkpoint yet, and must be the committed number, see
    `committed`, where one with `perBatch` goes on), and `perBatch`, the keys of a micro-batch at most.
    """
    of = FilteredReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else PagesReader

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return service.schema

        def reader(self, schema):
            return of(service)

        def streamReader(self, schema):  # noqa: N802  (Spark's name)
            each = self.options.get("perBatch")
            return PagesStreamReader(service, int(self.options.get("start", "0")), each and int(each))

    spark.dataSource.register(Pages)


def committed(spark: SparkSession, state: str) -> int:
    """The number of keys that a stream's checkpoint has committed; 0 without one."""
    named = lambda part: spark.read.text(f"{state}/{part}").select(F.element_at(F.split(F.input_file_name(), "/"), -1).try_cast("long").alias("n"), "value")
    try:
        last = named("commits").agg(F.max("n")).first()[0]
        lines = named("offsets").where((F.col("n") == last) & F.col("value").startswith('{"keys"')).select("value").collect()
    except AnalysisException:  # no such folder: nothing is committed
        return 0
    return max((json.loads(r["value"])["keys"] for r in lines), default=0)


class FolderPages:
    """A service over a folder of Parquet files, `<column>=<key>` for each key: a page is a row group. Reads any file
    system that pyarrow knows, from executors too. Keys without files have one empty page."""

    def __init__(self, folder: str, column: str, schema: T.StructType):
        self.folder, self.column, self.schema = re.sub("^file:/+", "file:///", folder), column, to_arrow_schema(schema)

    def __call__(self, key: object, cursor: object) -> Page:
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(f"{path}/{self.column}={key}", allow_not_found=True))
        files = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
        at, group = cursor or (0, 0)
        while at < len(files):
            with system.open_input_file(files[at]) as opened:
                file = pq.ParquetFile(opened)
                if group < file.num_row_groups:
                    rows = file.read_row_group(group, [n for n in self.schema.names if n != self.column])
                    rows = rows.append_column(self.column, pa.array([key] * rows.num_rows))
                    more = (at, group + 1) if group + 1 < file.num_row_groups else (at + 1, 0)
                    return self._batch(rows), more if more[0] < len(files) else None
            at, group = at + 1, 0
        return self._batch(None), None

    def _batch(self, rows: pa.Table | None) -> pa.RecordBatch:
        columns = [rows.column(f.name).cast(f.type).combine_chunks() if rows else pa.array([], f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)
