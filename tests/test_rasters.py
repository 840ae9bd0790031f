"""Nearest points, windows and regions of tiles against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from obsframe.operators import nearest, tiles
from obsframe.operators.graph import components

POINTS = "vec_id long, x double, y double"


def brute(points, k, asks=lambda i: True):
    out = []
    places = sorted({p for p in points if p[0] is not None and all(c is not None and np.isfinite(c) for c in p[1:])})
    for i, x, y in places:
        if asks(i):
            found = sorted(((px - x) * (px - x) + (py - y) * (py - y), j) for j, px, py in places if j != i)[:k]
            out += [(i, n + 1, j, math.sqrt(d)) for n, (d, j) in enumerate(found)]
    return sorted(out)


def clouds(seed):
    """Points of very different density: a tight cluster, a loose one, a line, far single ones and shared places."""
    rng = random.Random(seed)
    xy = [(rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for _ in range(150)] + [(rng.gauss(3, 1), rng.gauss(-2, 1)) for _ in range(120)]
    xy += [(k / 10, 5.0) for k in range(40)] + [(1000.0, 1000.0), (-900.0, 20.0), (1000.0, 1001.0)] + [(7.0, 7.0)] * 30 + [(-0.0, 0.0), (0.0, 0.0)]
    ids = rng.sample(range(5000), len(xy))
    return [(i, float(x), float(y)) for i, (x, y) in zip(ids, xy, strict=True)]


@pytest.mark.parametrize("split", [4, 256])
def test_nearest_of_uneven_clouds(spark, monkeypatch, split):
    monkeypatch.setattr(nearest, "SPLIT", split)
    monkeypatch.setattr(nearest, "FIRST", split / 2)
    rows = clouds(split)
    got = nearest.nearest(spark.createDataFrame(rows, POINTS), 7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_nearest_for_some_with_nulls_and_repeats(spark):
    rows = clouds(3)[:60] + [(9001, None, 1.0), (9002, float("nan"), 1.0), (9003, float("inf"), 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, "z") for r in rows + rows[:9]], f"{POINTS}, level string")
    got = nearest.nearest(df, 3, asks=df["vec_id"] % 3 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, lambda i: i % 3 == 0)


@pytest.mark.parametrize("rows", [[], [(1, 0.0, 0.0)], [(1, 2.0, 3.0), (2, 2.0, 3.0), (3, 2.0, 3.0)], [(1, 1e300, 0.0), (2, -1e-300, 0.0), (3, 0.0, 5e-324)]])
def test_nearest_of_few(spark, rows):
    assert sorted(map(tuple, nearest.nearest(spark.createDataFrame(rows, POINTS), 5).collect())) == brute(rows, 5)


TILES = "tile_x long, tile_y long, n long"


def scattered(seed, side, share):
    rng = random.Random(seed)
    return [(x, y, rng.randrange(1, 9)) for x in range(-side, side) for y in range(-side, side) if rng.random() < share]


@pytest.mark.parametrize("reach", [0, 1, 3, 20])
def test_focal_over_blocks(spark, monkeypatch, reach):
    monkeypatch.setattr(tiles, "BLOCK", 8)
    rows = scattered(reach, 14, 0.3) + [(10**12, -(10**12), 5)]
    at = {(x, y): n for x, y, n in rows}
    want = sorted((x, y, n, sum(v), len(v)) for (x, y), n in at.items() for v in [[m for (a, b), m in at.items() if abs(a - x) <= reach and abs(b - y) <= reach]])
    assert sorted(map(tuple, tiles.focal(spark.createDataFrame(rows, TILES), reach).collect())) == want


def test_focal_adds_repeats_and_skips_nulls(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (1, 1, -4), (None, 0, 1), (0, None, 1), (5, 5, None)], TILES)
    assert sorted(map(tuple, tiles.focal(df, 1).collect())) == [(0, 0, 3, -1, 2), (1, 1, -4, -1, 2)]
    assert tiles.focal(df.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        tiles.focal(df, tiles.MOST_REACH + 1)


def flood(rows, least):
    at = {(x, y): n for x, y, n in rows if n >= least}
    left, out = set(at), []
    for p in sorted(at):
        if p in left:
            group, todo = [], [p]
            left.discard(p)
            while todo:
                x, y = todo.pop()
                group.append((x, y))
                for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            xs, ys = zip(*group, strict=True)
            out.append((*p, len(group), sum(at[g] for g in group), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.4, 0.62])
def test_regions_over_blocks(spark, monkeypatch, share):
    monkeypatch.setattr(tiles, "BLOCK", 4)
    rows = scattered(5, 12, share)
    assert sorted(map(tuple, tiles.regions(spark.createDataFrame(rows, TILES), 2).collect())) == flood(rows, 2)


def test_regions_wind_through_many_blocks(spark, monkeypatch):
    """A spiral that crosses the same edges many times is one region; a ring around nothing is one too."""
    monkeypatch.setattr(tiles, "BLOCK", 3)
    x = y = 0
    rows, step = [(0, 0, 1)], 1
    for k in range(14):
        dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[k % 4]
        step += k % 2 * 2
        for _ in range(step + 1):
            x, y = x + dx, y + dy
            rows.append((x, y, 1))
    assert sorted(map(tuple, tiles.regions(spark.createDataFrame(rows, TILES)).collect())) == flood(sorted(set(rows)), 1)


def test_regions_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(0, 0, None), (None, 1, 2), (3, 3, 2), (3, 3, 2), (4, 4, 1)], TILES)
    assert sorted(map(tuple, tiles.regions(df, 2).collect())) == [(3, 3, 1, 4, 3, 3, 3, 3)]
    assert tiles.regions(df.limit(0)).collect() == []


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100), (60, 55), (55, 60), (61, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 55: 55, 60: 55, 61: 55} and Counter(got.values())[0] == 41
