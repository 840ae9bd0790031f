"""Tiles of the plane as rasters: statistics over windows, and connected regions.

Tiles (tile_x, tile_y, value) are sparse: those that aren't there are empty. They are
dealt to square blocks, so that each task holds one block (and a rim of its
neighbours) as an array, whatever the extent of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.operators.graph import components
from obsframe.sources.store import stored

#: Tiles along a block's side; a block isn't narrower than a window reaches.
BLOCK = 256
#: How far a window reaches at most: three times that, squared, is what a task holds.
MOST_REACH = 2048


def _one_each(tiles: DataFrame, value: str) -> DataFrame:
    """A row a tile: repeated ones are added up, those without a place or a value left out."""
    known = tiles.where(F.col("tile_x").isNotNull() & F.col("tile_y").isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y")).agg(F.sum(value).cast("long").alias("value"))


def _windows(table: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the windows around places of an array, by four look-ups each in its summed-area table."""
    low_x, high_x, low_y, high_y = x - reach, x + reach + 1, y - reach, y + reach + 1
    return table[high_x, high_y] - table[low_x, high_y] - table[high_x, low_y] + table[low_x, low_y]


def focal(tiles: DataFrame, reach: int, value: str = "n") -> DataFrame:
    """(tile_x, tile_y, value, window_sum, window_tiles): for each tile the sum of the values, and the number of tiles that are
    there, in the square of 2 * reach + 1 tiles around it.

    Values are whole numbers; their sum over a block and its rim must fit into a long. Repeated tiles are added
    up; rows with a null are left out. A window of any reach up to MOST_REACH costs four look-ups: each block gets
    the tiles of its rim too (nine blocks hold a tile at most) and sums them up once in each direction.
    """
    if not 0 <= reach <= MOST_REACH:
        raise ValueError(f"reach is from 0 to {MOST_REACH}")
    side = max(BLOCK, reach)
    place = lambda c: F.floor(F.col(c) / side)
    around = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    rows = _one_each(tiles, value).withColumn("bx", F.explode(around("tile_x"))).withColumn("by", F.explode(around("tile_y")))
    rows = rows.withColumn("own", (F.col("bx") == place("tile_x")) & (F.col("by") == place("tile_y")))

    def sum_up(block: pa.Table) -> pa.Table:
        tx, ty, v = (block.column(c).to_numpy() for c in ("tile_x", "tile_y", "value"))
        own = block.column("own").to_numpy(zero_copy_only=False)
        x, y = tx - (block.column("bx")[0].as_py() * side - reach), ty - (block.column("by")[0].as_py() * side - reach)
        wide = side + 2 * reach + 1
        sums = []
        for what in (v, np.ones_like(v)):
            table = np.zeros((wide, wide), np.int64)
            table[x + 1, y + 1] = what
            sums.append(_windows(table.cumsum(0).cumsum(1), x[own], y[own], reach))
        return pa.table([pa.array(c) for c in (tx[own], ty[own], v[own], *sums)], names=["tile_x", "tile_y", "value", "window_sum", "window_tiles"])

    found = rows.groupBy("bx", "by").applyInArrow(sum_up, "tile_x long, tile_y long, value long, window_sum long, window_tiles long")
    return found.withColumnRenamed("value", value)


def _labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For tiles in ascending order of (x, y): the first place in that order of each one's region, neighbours sharing a side."""
    at = {p: k for k, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
    parent = list(range(len(x)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for (a, b), k in at.items():
        for before in (at.get((a - 1, b)), at.get((a, b - 1))):
            if before is not None and (p := root(k)) != (q := root(before)):
                parent[max(p, q)] = min(p, q)
    return np.array([root(k) for k in range(len(x))], np.int64)


def regions(tiles: DataFrame, least: int = 1, value: str = "n") -> DataFrame:
    """(region_x, region_y, tiles, total, x0, y0, x1, y1): regions of tiles with a value of at least `least` that share sides.

    A region is named by its first tile in the order of (tile_x, tile_y); total is the sum of its values, and the
    box holds its tiles. Repeated tiles are added up; rows with a null are left out.

    Blocks are labelled each by itself; then only labels are joined, over tiles that face one another across a
    block's edge. A region over all blocks never meets in one task.
    """
    rows = _one_each(tiles, value).where(F.col("value") >= least)
    rows = rows.withColumn("bx", F.floor(F.col("tile_x") / BLOCK)).withColumn("by", F.floor(F.col("tile_y") / BLOCK))

    def label(block: pa.Table) -> pa.Table:
        block = block.sort_by([("tile_x", "ascending"), ("tile_y", "ascending")])
        x, y = block.column("tile_x").to_numpy(), block.column("tile_y").to_numpy()
        first = _labels(x, y)
        return pa.table([block.column("tile_x"), block.column("tile_y"), block.column("value"), pa.array(x[first]), pa.array(y[first])], names=["tile_x", "tile_y", "value", "label_x", "label_y"])

    labelled = stored(rows.groupBy("bx", "by").applyInArrow(label, "tile_x long, tile_y long, value long, label_x long, label_y long"), "labelled")
    named = F.struct("label_x", "label_y")
    links = None
    for c, other in (("tile_x", "tile_y"), ("tile_y", "tile_x")):
        last = labelled.where(F.pmod(c, F.lit(BLOCK)) == BLOCK - 1).select((F.col(c) + 1).alias(c), other, named.alias("a"))
        facing = last.join(labelled.where(F.pmod(c, F.lit(BLOCK)) == 0).select(c, other, named.alias("b")), [c, other]).select("a", "b")
        links = facing if links is None else links.union(facing)
    parts = labelled.groupBy(named.alias("part")).agg(
        F.count("*").alias("tiles"), F.sum("value").alias("total"), *(f(f"tile_{c}").alias(f"{c}{n}") for c in "xy" for n, f in enumerate((F.min, F.max))),
    )
    roots = components(links)
    whole = parts.join(roots, parts["part"] == roots["node"], "left").withColumn("region", F.coalesce("root", "part"))
    sums = [F.sum("tiles").alias("tiles"), F.sum("total").alias("total"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return whole.groupBy("region").agg(*sums).select(F.col("region.label_x").alias("region_x"), F.col("region.label_y").alias("region_y"), "tiles", "total", "x0", "y0", "x1", "y1")
