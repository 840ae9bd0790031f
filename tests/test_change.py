"""Break points, rank trends and stored sketches against all cuts, all pairs and exact figures."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest

from obsframe.operators import change
from obsframe.sources import sketches

SERIES = "site int, day long, value double"


def line_error(x, y):
    fit = np.polynomial.Polynomial.fit(x, y, 1)(x) if len(x) > 1 else y
    return float(((y - fit) ** 2).sum())


def all_cuts(day, value, breaks, least):
    best = None
    for cut in itertools.combinations(range(least, len(day) - least + 1), breaks):
        edges = [0, *cut, len(day)]
        if all(b - a >= least for a, b in itertools.pairwise(edges)):
            error = sum(line_error(day[a:b], value[a:b]) for a, b in itertools.pairwise(edges))
            if best is None or error < best[0] - 1e-9:
                best = error, [int(day[c]) for c in cut]
    return best


@pytest.mark.parametrize(("breaks", "least"), [(1, 2), (2, 3), (3, 4)])
def test_breaks_against_all_cuts(spark, breaks, least):
    rng = np.random.default_rng(breaks)
    rows = []
    for site in range(8):
        day = np.sort(rng.choice(40, 22, replace=False)) + 19000
        rows += [(site, int(d), float(v)) for d, v in zip(day, rng.normal(size=22) + 5 * (day > 19020) * (day - 19020) * (site % 2), strict=True)]
    found = {r.site: r for r in change.break_points(spark.createDataFrame(rows[::-1], SERIES), "site", breaks, least).collect()}
    for site in range(8):
        day, value = (np.array([r[c] for r in rows if r[0] == site]) for c in (1, 2))
        error, cuts = all_cuts(day, value, breaks, least)
        assert found[site].breaks == cuts and found[site].error == pytest.approx(error, abs=1e-8)
        assert found[site].error_without == pytest.approx(line_error(day, value), abs=1e-8)


def test_a_bend_is_found_and_short_series_are_left_out(spark):
    rows = [(1, 100 + k, float(k if k < 10 else 30 - 2 * k)) for k in range(20)] + [(2, k, 1.0) for k in range(9)] + [(3, k, 7.0) for k in range(10)]
    got = {r.site: r for r in change.break_points(spark.createDataFrame(rows, SERIES), "site").collect()}
    assert set(got) == {1, 3} and got[1].breaks in ([110], [109], [111]) and got[1].error == pytest.approx(0, abs=1e-9) and got[3].error == 0
    assert change.break_points(spark.createDataFrame([], SERIES), "site").collect() == []


def all_pairs(day, value):
    pairs = list(itertools.combinations(range(len(day)), 2))
    s = sum(int(np.sign(value[j] - value[i])) for i, j in pairs)
    return s, float(np.median([(value[j] - value[i]) / (day[j] - day[i]) for i, j in pairs])) if pairs else None


@pytest.mark.parametrize("kind", ["noise", "few values", "flat", "steps"])
def test_rank_trend_against_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    make = {"noise": lambda d: rng.normal(size=len(d)), "few values": lambda d: rng.integers(0, 3, len(d)) * 1.0, "flat": lambda d: np.full(len(d), 2.5), "steps": lambda d: d // 20 + 0.0}[kind]
    series = {n: (day := np.sort(rng.choice(900, n, replace=False)) + 19000, make(day)) for n in (1, 2, 3, 60, 250)}
    rows = [(n, int(d), float(v)) for n, (day, value) in series.items() for d, v in zip(day, value, strict=True)]
    for r in change.rank_trend(spark.createDataFrame(rows[::-1], SERIES), "site").collect():
        s, slope = all_pairs(*series[r.site])
        assert (r.n, r.s) == (r.site, s) and r.sen_slope == (None if slope is None else pytest.approx(slope, rel=1e-12, abs=1e-15))
        assert (r.z is None) == (len(set(series[r.site][1])) == 1)


def test_mann_kendall_by_hand():
    # 1 2 2 4: five rising pairs, one tie; variance (4 * 3 * 13 - 2 * 1 * 9) / 18
    s, z, slope = change.mann_kendall(np.array([1, 2, 3, 4]), np.array([1.0, 2.0, 2.0, 4.0]))
    assert s == 5 and z == pytest.approx(4 / (138 / 18) ** 0.5) and slope == 1.0


def test_daily_means_skip_what_has_no_value(spark):
    at = datetime(2024, 1, 1, 5)
    rows = [(1, at, 1.0), (1, at + timedelta(hours=9), 2.0), (1, at, None), (1, at, float("nan")), (None, at, 1.0), (1, None, 1.0), (2, at, None)]
    got = change.daily_means(spark.createDataFrame(rows, "site int, ts timestamp_ntz, value double"), "site").collect()
    assert [tuple(r) for r in got] == [(1, 19723, 1.5)]


EVENTS = "ts timestamp_ntz, user_id long, value double"


def test_ranges_from_stored_sketches(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=int(m)), int(u), float(v)) for m, u, v in zip(rng.integers(0, 14400, 6000), rng.integers(0, 900, 6000), rng.gamma(2, 5, 6000), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (datetime(2024, 1, 3), None, None), (datetime(2024, 1, 3), 5000, None)], EVENTS)
    sketches.write_sketches(df, str(tmp_path))
    got = sketches.read_range(spark, str(tmp_path), "2024-01-03", "2024-01-07", {"p10": 0.1, "p50": 0.5}).first()
    inside = [(u, v) for t, u, v in rows if 3 <= t.day <= 7]
    assert (got.n, got.sites, got.total) == (len(inside), len({u for u, _ in inside}) + 1, pytest.approx(sum(v for _, v in inside), abs=1e-2))
    for p, q in ((0.1, got.p10), (0.5, got.p50)):
        assert abs(np.mean([v <= q for _, v in inside]) - p) <= 2 * sketches.RANK_ERROR
    # a day that comes again replaces itself alone
    sketches.write_sketches(df.where("day(ts) = 5").limit(0).union(spark.createDataFrame([(datetime(2024, 1, 5), 1, 2.0)], EVENTS)), str(tmp_path))
    again = sketches.read_range(spark, str(tmp_path), "2024-01-05", "2024-01-05", {"p50": 0.5}).first()
    assert (again.n, again.sites, again.p50) == (1, 1, 2.0)
    none = sketches.read_range(spark, str(tmp_path), "2025-01-01", "2025-01-02", {"p50": 0.5}).first()
    assert (none.n, none.sites, none.p50) == (0, 0, None)


def test_distinct_counts_below_the_sketch_are_exact_however_merged(spark, tmp_path):
    df = spark.range(40_000).selectExpr("timestampadd(HOUR, cast(id % 240 as int), timestamp_ntz'2024-01-01') AS ts", "id % 4000 AS user_id", "1.0 AS value")
    sketches.write_sketches(df, str(tmp_path))
    assert sketches.read_range(spark, str(tmp_path), "2024-01-01", "2024-01-31", {}).first().sites == 4000


def test_distinct_counts_of_many_sites_are_exact(spark, tmp_path):
    df = spark.range(40_000).selectExpr("timestampadd(HOUR, cast(id % 240 as int), timestamp_ntz'2024-01-01') AS ts", "id % 9001 AS user_id", "1.0 AS value", "nullif(id % 2, 0) AS half")
    sketches.write_sketches(df, str(tmp_path), ["half"])
    got = sketches.read_range(spark, str(tmp_path), "2024-01-01", "2024-01-31", {}, ["half"]).collect()
    assert sorted((r.half or 0, r.n, r.sites) for r in got) == [(0, 20_000, 9001), (1, 20_000, 9001)]
    # a day that comes again without a site has none
    sketches.write_sketches(spark.sql("SELECT timestamp_ntz'2024-01-05' AS ts, cast(null as long) AS user_id, 1.0 AS value, 1L AS half"), str(tmp_path), ["half"])
    assert [tuple(r) for r in sketches.read_range(spark, str(tmp_path), "2024-01-05", "2024-01-05", {}, ["half"]).collect()] == [(1, 1, 1.0, 0)]
