"""The k nearest points of each point, over a grid whose dense cells are split.

Points that share a place are one place, of which the k + 1 smallest ids are
kept. Places lie in leaves: grid cells of a power of two, halved until a leaf
holds few places. Leaves first meet leaves: a leaf that asks looks at those around
it, ring by ring, each ring twice as wide as the one before, until so many places lie
certainly nearer than anything outside that the k-th distance is settled. Only then
do places meet the places of the leaves that can still hold a nearest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.operators.composite import first_by
from obsframe.sources.store import stored

#: Places of a leaf at most (places too near to one another for the grid apart), and about in a cell of the first grid.
SPLIT = 256
FIRST = 64
#: A cell isn't halved below this share of the largest coordinate, so that cell numbers are exact.
_FINEST = 45


def _cell(c: Column | str, level: Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.pow(F.lit(2.0), level))


def _leaves(places: DataFrame) -> DataFrame:
    """`places` (x, y, ...) with `level`, `cx` and `cy` of its leaf. Each round halves only the cells that are too full."""
    span = places.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    count, wide, high, reach = (float(v or 0) for v in span)
    side = max((max(wide, 1e-300) * max(high, 1e-300) * FIRST / max(count, 1)) ** 0.5, max(wide, high) / 2**20, 1e-300)
    finest = int(np.ceil(np.log2(max(reach, 1e-300)))) - _FINEST
    level = max(int(np.ceil(np.log2(side))), finest)
    done: list[DataFrame] = []
    cell = ["level", "cx", "cy"]
    rest = places.withColumn("level", F.lit(level)).withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level")))
    while True:
        full = stored(rest.groupBy(*cell).agg(F.count("*").alias("_n")).where((F.col("_n") > SPLIT) & (F.col("level") > finest)).drop("_n"), "full")
        done.append(rest.join(full, cell, "left_anti"))
        if full.isEmpty():
            break
        finer = rest.join(full, cell, "left_semi").withColumn("level", F.col("level") - 1)
        rest = stored(finer.withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level"))), "finer")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _gap(a: str, b: str, c: str) -> Column:
    """How far two boxes are apart along a coordinate."""
    return F.greatest(F.col(f"{a}{c}0") - F.col(f"{b}{c}1"), F.col(f"{b}{c}0") - F.col(f"{a}{c}1"), F.lit(0.0))


def _reach(a: str, b: str, c: str) -> Column:
    """How far points of two boxes can be apart along a coordinate."""
    return F.greatest(F.col(f"{a}{c}1") - F.col(f"{b}{c}0"), F.col(f"{b}{c}1") - F.col(f"{a}{c}0"))


def _meeting(leaves: DataFrame, k: int) -> DataFrame:
    """(level, cx, cy, of_level, of_cx, of_cy): for each leaf that asks, the leaves that may hold one of its points' k nearest.
    `leaves`: level, cx, cy, asks, weight and the box x0, x1, y0, y1 of its places."""
    levels = sorted(r[0] for r in leaves.select("level").distinct().collect())  # the range of doubles bounds them
    at = lambda c, up: F.floor(F.col(c) / F.pow(F.lit(2.0), up))
    box = ["x0", "x1", "y0", "y1"]
    named = lambda p: leaves.select(*(F.col(c).alias(f"{p}_{c}") for c in ("level", "cx", "cy", "weight", *box)))
    asking = leaves.where("asks").select("level", "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in box))
    found, ring = [], 0
    total = leaves.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    whole = max(total[1] - total[0], total[3] - total[2]) if levels else 0.0
    while True:
        # the cells around, of the leaf's own level raised by `ring`; a leaf is listed at its level and all above, a coarser one is looked up by the cells' own cells
        wide = F.col("level") + ring
        around = F.explode(F.array(*(F.struct((at("cx", F.lit(ring)) + dx).alias("nx"), (at("cy", F.lit(ring)) + dy).alias("ny")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
        asked = asking.withColumn("_c", around).withColumn("_wide", wide)
        coarser = [F.struct(F.lit(m).alias("m"), F.floor(F.col("_c.nx") / F.pow(F.lit(2.0), F.lit(m) - F.col("_wide"))).alias("nx"), F.floor(F.col("_c.ny") / F.pow(F.lit(2.0), F.lit(m) - F.col("_wide"))).alias("ny"), F.lit(True).alias("own")) for m in levels]
        own = F.struct(F.col("_wide").alias("m"), F.col("_c.nx").alias("nx"), F.col("_c.ny").alias("ny"), F.lit(False).alias("own"))
        keys = F.filter(F.array(own, *coarser), lambda s: ~s["own"] | (s["m"] > F.col("_wide")))
        asked = asked.withColumn("_k", F.explode(keys)).select("level", "cx", "cy", *(f"a_{c}" for c in box), F.col("_k.m").alias("_m"), F.col("_k.nx").alias("_x"), F.col("_k.ny").alias("_y"), F.col("_k.own").alias("_own")).distinct()
        tops = sorted({m + ring for m in levels} | set(levels)) or [0]
        raised = F.filter(F.array(*(F.struct(F.lit(t).alias("m"), (F.lit(t) == F.col("b_level")).alias("own")) for t in tops)), lambda s: s["m"] >= F.col("b_level"))
        listed = named("b").withColumn("_t", F.explode(raised)).withColumn("_m", F.col("_t.m"))
        for c in ("x", "y"):
            listed = listed.withColumn(f"_{c}", F.floor(F.col(f"b_c{c}") / F.pow(F.lit(2.0), F.col("_m") - F.col("b_level"))))
        # by its own cell a leaf is found from finer ones; by any of its cells it is found from that cell's ring
        met = asked.join(listed.withColumn("_same", F.col("_t.own")).drop("_t"), ["_m", "_x", "_y"]).where(~F.col("_own") | F.col("_same"))
        met = met.drop("_m", "_x", "_y", "_own", "_same").distinct()
        near = F.pow(_gap("a_", "b_", "x"), 2) + F.pow(_gap("a_", "b_", "y"), 2)
        far = F.pow(_reach("a_", "b_", "x"), 2) + F.pow(_reach("a_", "b_", "y"), 2)
        met = met.withColumn("_near", near).withColumn("_far", far)
        of_leaf = Window.partitionBy("level", "cx", "cy")
        met = met.withColumn("_sum", F.sum("b_weight").over(of_leaf.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("_kth", F.min(F.when(F.col("_sum") > k, F.col("_far"))).over(of_leaf))
        # everything outside of the ring is farther away than a cell's side, from any place in the leaf
        side = F.pow(F.lit(2.0), wide)
        over = bool(levels) and 2.0 ** (min(levels) + ring) > whole
        sure = F.lit(True) if over or not levels else F.coalesce(F.col("_kth") <= side * side, F.lit(False))
        met = stored(met.withColumn("_sure", sure), "met")
        # a place at the k-th distance itself may win by its id
        kept = met.where("_sure AND (_kth IS NULL OR _near <= _kth * (1 + 1e-12))")
        found.append(kept.select("level", "cx", "cy", *(F.col(f"b_{c}").alias(f"of_{c}") for c in ("level", "cx", "cy"))))
        open_ = met.where("NOT _sure").select("level", "cx", "cy", *(f"a_{c}" for c in box)).distinct()
        if over or open_.isEmpty():
            break
        asking, ring = stored(open_, "open"), ring + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _closest(x: float, y: float, px: np.ndarray, py: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids of the k nearest, by distance and then id."""
    dx, dy = px - x, py - y
    d = dx * dx + dy * dy
    if len(d) > k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[some], ids[some]
    order = np.lexsort((ids, d))[:k]
    return d[order], ids[order]


def nearest(df: DataFrame, k: int, key: str = "vec_id", asks: Column | None = None) -> DataFrame:
    """(query_id, rank, the id, distance): for each point of `df` (key, x, y; those for which `asks` holds) the k nearest points
    of other ids, by Euclidean distance, then id; all others where there are fewer.

    Ids are whole numbers, each with one place; rows that repeat both count once. Points with a null, NaN or infinite
    coordinate, or a null id, take no part; points that share a place have distance 0. Other columns are left out; an
    empty table gives an empty one.

    A third of all points at one place is one place with k + 1 ids; a leaf of any crowded region holds SPLIT places
    at most. What a task holds is one asking leaf and the leaves around it that can't be ruled out.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    whole = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    rows = df.where(whole & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"))
    rows = stored(rows.groupBy("id", "x", "y").agg(F.max("asks").alias("asks")), "points")
    few = first_by(rows, ["x", "y"], [F.asc("id")], k + 1).groupBy("x", "y").agg(F.collect_list("id").alias("ids"))
    asking = rows.where("asks").select("x", "y").distinct().withColumn("asks", F.lit(True))
    places = stored(few.join(asking, ["x", "y"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "places")
    placed = stored(_leaves(places), "placed")
    leaves = placed.groupBy("level", "cx", "cy").agg(F.max("asks").alias("asks"), F.sum(F.size("ids")).alias("weight"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    meeting = _meeting(stored(leaves, "leaves"), k)
    others = placed.select(*(F.col(c).alias(f"of_{c}") for c in ("level", "cx", "cy")), "x", "y", "ids")
    others = meeting.join(others, ["of_level", "of_cx", "of_cy"]).select("level", "cx", "cy", "x", "y", "ids")
    # columns of their own, as both sides come from one table
    asked = placed.where("asks").select(*(F.col(c).alias(c) for c in ("level", "cx", "cy", "x", "y")))

    def search(queries: pa.Table, points: pa.Table) -> pa.Table:
        lists = points.column("ids").combine_chunks()
        ids = lists.flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()) if points.num_rows else np.zeros(0, int)
        px, py = (np.repeat(points.column(c).to_numpy(), sizes) for c in ("x", "y"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for x, y in zip(queries.column("x").to_numpy(), queries.column("y").to_numpy(), strict=True):
            d, best = _closest(x, y, px, py, ids, k + 1)
            for column, values in zip(out, (np.full(len(d), x), np.full(len(d), y), best, d), strict=True):
                column.append(values)
        kinds = (float, float, np.int64, float)
        return pa.table([pa.array(np.concatenate([*c, np.zeros(0, t)]).astype(t)) for c, t in zip(out, kinds, strict=True)], names=["x", "y", "near", "d"])

    best = asked.groupBy("level", "cx", "cy").cogroup(others.groupBy("level", "cx", "cy")).applyInArrow(search, "x double, y double, near long, d double")
    # a place's answer holds k + 1 ids, so k are left whichever of them asks
    answers = rows.where("asks").select("id", "x", "y").join(best, ["x", "y"]).where("id <> near")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("id", "x", "y").orderBy("d", "near"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").cast(df.schema[key].dataType).alias("query_id"), "rank", F.col("near").cast(df.schema[key].dataType).alias(key), F.sqrt("d").alias("distance"))
