"""Points in the plane."""

from __future__ import annotations

from functools import reduce as reduce_all

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_bounds(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Points inside or on (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = box
    return df.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))


#: Cells aren't smaller than this share of the largest coordinate, so that their numbers are exact in a double.
_FINEST = 2.0**-45


def _level(side: Column, reach: Column) -> Column:
    """The exponent of the smallest power of two that isn't below `side`."""
    return F.ceil(F.log2(F.greatest(side, reach * _FINEST, F.lit(1e-300)))).cast("int")


def _cell(c: Column | str, level: Column | str) -> Column:
    """The number of the cell of side 2^level that holds a coordinate."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.pow(F.lit(2.0), F.col(level) if isinstance(level, str) else level))


def within(df: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, zone) for each polygon that holds a point, by the even-odd rule on `edges` (zone, x1, y1, x2, y2).

    Cells are a quadtree: at level n their side is 2^n. A polygon is listed at the level of its own size, so in four
    cells at most, however large or small the others are; a point looks up one cell of each level that there is.
    Points in a polygon's box meet its edges in the same way: an edge is listed at the level of its height, in two
    rows at most, and a point looks up one row of each level that the polygon has. So neither points nor edges
    meet each with each. A point on a left or lower edge is inside; points with a null, NaN or infinite coordinate
    are in none, and edges with one are left out, as are those of a null zone.
    """
    whole = lambda *c: reduce_all(lambda a, b: a & b, (F.abs(F.col(x)) < float("inf") for x in c))  # noqa: E731  (not for null or NaN)
    edges = edges.where(whole("x1", "y1", "x2", "y2") & F.col("zone").isNotNull()).select("zone", "x1", "y1", "x2", "y2")
    ends = lambda pick, a, b: (F.min if pick is F.least else F.max)(pick(a, b))
    boxes = edges.groupBy("zone").agg(*(ends(pick, f"{c}1", f"{c}2").alias(f"_{c}{n}") for c in "xy" for n, pick in enumerate((F.least, F.greatest))))
    reach = F.greatest(*(F.abs(F.col(f"_{c}{n}")) for c in "xy" for n in (0, 1)))
    boxes = boxes.withColumn("_level", _level(F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")), reach))
    both = lambda a, b, level: F.explode(F.array_distinct(F.array(_cell(a, level), _cell(b, level))))
    listed = boxes.select("*", both("_x0", "_x1", "_level").alias("_cx")).select("*", both("_y0", "_y1", "_level").alias("_cy"))
    # as many numbers as there are levels, which the range of doubles bounds
    levels = boxes.agg(F.collect_set("_level")).scalar()
    placed = df.where(whole("x", "y")).withColumn("_level", F.explode(levels))
    placed = placed.withColumn("_cx", _cell("x", "_level")).withColumn("_cy", _cell("y", "_level"))
    boxed = placed.join(listed, ["_level", "_cx", "_cy"]).where(F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1")))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    sloped = edges.where("y1 <> y2").withColumn("_height", _level(high - low, F.greatest(F.abs("y1"), F.abs("y2"))))
    rows = sloped.withColumn("_row", both(low, high, "_height"))
    heights = sloped.groupBy("zone").agg(F.collect_set("_height").alias("_heights"))
    asked = boxed.select(key, "x", "y", "zone").join(heights, "zone").withColumn("_height", F.explode("_heights")).drop("_heights")
    near = asked.withColumn("_row", _cell("y", "_height")).join(rows, ["zone", "_height", "_row"])
    reaches = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    crosses = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hits = near.where(reaches & crosses)
    return hits.groupBy(key, "zone").agg(F.count("*").alias("_n")).where("_n % 2 = 1").select(key, "zone")


def tile(df: DataFrame, size: float) -> DataFrame:
    """Points per grid tile; a tile is named by floor(x / size) and floor(y / size)."""
    place = [F.floor(F.col(c) / size).cast("bigint").alias(f"tile_{c}") for c in ("x", "y")]
    return df.where("x is not null and y is not null").groupBy(*place).agg(F.count("*").alias("n"))
