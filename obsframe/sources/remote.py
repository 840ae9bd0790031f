"""A paged remote pull as a Spark data source: one request is one partition.

The caller brings the service: `fetch(day)` returns the rows of one day.
Filters on `day` drop requests before anything is fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

_TESTS: dict[type, Callable] = {
    EqualTo: lambda day, v: day == v,
    In: lambda day, v: day in v,
    GreaterThan: lambda day, v: day > v,
    GreaterThanOrEqual: lambda day, v: day >= v,
    LessThan: lambda day, v: day < v,
    LessThanOrEqual: lambda day, v: day <= v,
}


@dataclass
class Request(InputPartition):
    day: int


class PagedReader(DataSourceReader):
    def __init__(self, days: Sequence[int], fetch: Callable[[int], Iterator[tuple]], tries: int):
        self.days, self.fetch, self.tries = list(days), fetch, tries

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            test = _TESTS.get(type(f))
            if test and f.attribute == ("day",):
                self.days = [d for d in self.days if test(d, f.value)]
            else:
                yield f

    def partitions(self) -> list[Request]:
        return [Request(d) for d in self.days]

    def read(self, partition: Request) -> Iterator[tuple]:
        # a request is tried again as a whole before any of its rows go out
        for left in reversed(range(self.tries)):
            try:
                rows = list(self.fetch(partition.day))
                break
            except OSError:
                if not left:
                    raise
        yield from rows


def register_pull(spark: SparkSession, name: str, schema: str, days: Sequence[int], fetch: Callable[[int], Iterator[tuple]], tries: int = 3) -> None:
    """Make `spark.read.format(name).load()` pull from `fetch`; `schema` has a column `day`.

    Filters reach the source only under spark.sql.python.filterPushdown.enabled.
    """

    class Pull(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return PagedReader(days, fetch, tries)

    spark.dataSource.register(Pull)
