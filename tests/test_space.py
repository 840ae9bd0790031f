"""Polygons of very different sizes, with every point against every edge in plain Python."""

import math
import random

import pytest

from obsframe.operators import space

EDGES = "zone int, x1 double, y1 double, x2 double, y2 double"


def ring(zone, corners):
    return [(zone, *corners[k], *corners[(k + 1) % len(corners)]) for k in range(len(corners))]


def star(rng, zone, size, x, y, corners):
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return ring(zone, [(x + size * (0.3 + 0.7 * rng.random()) * math.cos(t), y + size * (0.3 + 0.7 * rng.random()) * math.sin(t)) for t in turns])


def brute(points, edges):
    inside = set()
    for key, x, y in points:
        for zone in {e[0] for e in edges}:
            crossed = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for z, x1, y1, x2, y2 in edges if z == zone)
            if crossed % 2:
                inside.add((key, zone))
    return inside


@pytest.mark.parametrize("seed", range(3))
def test_sizes_from_tiny_to_huge(spark, seed):
    rng = random.Random(seed)
    edges = [e for z in range(30) for e in star(rng, z, 10 ** rng.uniform(-3, 4), rng.uniform(-5, 5), rng.uniform(-5, 5), rng.randrange(3, 9))]
    edges += ring(100, [(0, 0), (1, 0), (1, 1), (0, 1)]) + ring(101, [(-8, -8), (8, -8), (8, 8), (-8, 8)]) + ring(102, [(0, 0), (0, 0), (0, 0)]) + ring(103, [(1, 1), (2, 1)])
    points = [(k, rng.uniform(-8, 8), rng.uniform(-8, 8)) for k in range(150)] + [(900 + k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 1.0), (8.0, -8.0), (0.5, 0.0), (0.0, 0.5), (-8.0, 1.0)])]
    found = space.within(spark.createDataFrame(points, "key int, x double, y double"), spark.createDataFrame([tuple(map(float, e[1:])) and (e[0], *map(float, e[1:])) for e in edges], EDGES), "key")
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, edges)


def test_one_large_polygon_among_small_ones_lists_few_cells(spark):
    small = [e for z in range(1000) for e in ring(z, [(z, 0.0), (z + 1.0, 0.0), (z + 1.0, 1.0), (z, 1.0)])]
    edges = spark.createDataFrame([tuple([e[0], *map(float, e[1:])]) for e in small + ring(5000, [(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6)])], EDGES)
    points = spark.createDataFrame([(k, k * 10 + 0.5, 0.5) for k in range(100)], "key int, x double, y double")
    assert sorted(map(tuple, space.within(points, edges, "key").collect())) == sorted([(k, k * 10) for k in range(100)] + [(k, 5000) for k in range(100)])


def test_nulls_infinities_and_empty_tables(spark):
    edges = spark.createDataFrame([*ring(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, 0.0, None, 1.0, 1.0), (3, 0.0, float("inf"), 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)], EDGES)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 1.0, -float("inf")), (None, 1.0, 1.0)], "key int, x double, y double")
    assert sorted(map(tuple, space.within(points, edges, "key").collect()), key=str) == [(1, 1), (None, 1)]
    assert space.within(points, edges.limit(0), "key").collect() == [] and space.within(points.limit(0), edges, "key").collect() == []
