"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values are summed as decimals, so that a sum doesn't depend on the order of partitions.
EXACT = "decimal(28,6)"


def exact_sum(value: str = "value") -> Column:
    return F.sum(F.col(value).cast(EXACT)).cast("double")


def exact_mean(value: str = "value") -> Column:
    return F.try_divide(exact_sum(value), F.count(value).cast("double"))


def meta(path: str, column: str = "props") -> Column:
    """A value of the JSON metadata, as text; null where the path is missing."""
    return F.get_json_object(column, path)


def point(vector: str) -> list[Column]:
    """The first two elements of an array as x and y (null where they are missing)."""
    return [F.get(vector, k).cast("double").alias(name) for k, name in enumerate(("x", "y"))]
