"""Change of a site over days: break points, and trends by rank.

Both work on a series of a value a day, which `daily_means` makes before anything
is put in order: however busy a site is, its series is as long as there are days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.functions import exact_mean

#: Slopes that are listed at most when the middle one is sought.
FEW = 4096


def daily_means(df: DataFrame, site: str, time: str = "ts", value: str = "value") -> DataFrame:
    """(site, day, value): the mean of each site and day that has a value; day is the number of days since 1970."""
    day = F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    known = df.where(F.col(site).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(site, day.alias("day")).agg(exact_mean(value).alias("value"))


def _series(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    day, value = rows.column("day").to_numpy(), rows.column("value").to_numpy()
    order = np.argsort(day, kind="stable")
    return day[order], value[order]


class Segments:
    """Squared errors of the least-squares line over any run of a series, from running sums of its moments. Days and values are
    centred first, so that sums stay small."""

    def __init__(self, day: np.ndarray, value: np.ndarray):
        x, y = (day - day.mean()).astype(float), value - value.mean()
        self.sums = np.vstack([np.zeros(6), np.cumsum(np.stack([np.ones(len(x)), x, y, x * x, x * y, y * y], 1), 0)])

    def errors(self, ends: int, starts: np.ndarray) -> np.ndarray:
        """Of the runs from each of `starts` up to before `ends`."""
        n, x, y, xx, xy, yy = (self.sums[ends] - self.sums[starts]).T
        sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
        slope = np.divide(sxy, sxx, out=np.zeros_like(sxx), where=sxx > 0)
        return np.maximum(syy - slope * sxy, 0.0)


def best_breaks(day: np.ndarray, value: np.ndarray, breaks: int, least: int) -> tuple[list[int], float]:
    """The first places of the 2nd to last segment, and the summed squared error, of the best `breaks` + 1 lines of at
    least `least` days each; of equally good ones the earliest. By dynamic programming over the last segment's start."""
    n, segments = len(day), Segments(day, value)
    cost = np.full((breaks + 1, n + 1), np.inf)
    start = np.zeros((breaks + 1, n + 1), int)
    for ends in range(least, n + 1):
        cost[0, ends] = segments.errors(ends, np.array([0]))[0]
        for b in range(1, breaks + 1):
            starts = np.arange(b * least, ends - least + 1)
            if len(starts):
                total = cost[b - 1, starts] + segments.errors(ends, starts)
                at = int(total.argmin())
                cost[b, ends], start[b, ends] = total[at], starts[at]
    found, ends = [], n
    for b in range(breaks, 0, -1):
        ends = int(start[b, ends])
        found.append(ends)
    return found[::-1], float(cost[breaks, n])


def break_points(series: DataFrame, site: str, breaks: int = 1, least: int = 5) -> DataFrame:
    """(site, breaks, error, error_without): the days (numbers since 1970) on which the 2nd to last of `breaks` + 1 straight lines
    begin that fit a site's series (site, day, value) best, their summed squared error, and that of one line.

    Sites with fewer than (breaks + 1) * `least` days are left out. One row a site and day is expected, as `daily_means`
    gives it. The work of a site grows with the square of its days, not with its rows.
    """
    if breaks < 1 or least < 1:
        raise ValueError("one break and one day a segment at least")
    schema = T.StructType([T.StructField(site, series.schema[site].dataType), T.StructField("breaks", T.ArrayType(T.LongType())), T.StructField("error", T.DoubleType()), T.StructField("error_without", T.DoubleType())])

    def find(rows: pa.Table) -> pa.Table:
        day, value = _series(rows)
        if len(day) < (breaks + 1) * least:
            return rows.select([site]).slice(0, 0).append_column("breaks", pa.array([], pa.list_(pa.int64()))).append_column("error", pa.array([], pa.float64())).append_column("error_without", pa.array([], pa.float64()))
        at, error = best_breaks(day, value, breaks, least)
        whole = float(Segments(day, value).errors(len(day), np.array([0]))[0])
        return pa.table([rows.column(site).slice(0, 1), pa.array([day[at].tolist()], pa.list_(pa.int64())), pa.array([error]), pa.array([whole])], names=schema.names)

    return series.select(site, F.col("day").cast("long").alias("day"), F.col("value").cast("double").alias("value")).groupBy(site).applyInArrow(find, schema)


def _inversions(values: np.ndarray) -> tuple[int, int]:
    """How many pairs of places hold a greater value first, and how many equal ones, by merging runs of doubling length."""
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    counts = np.bincount(ranks)
    ties, greater, width = int((counts * (counts - 1) // 2).sum()), 0, 1
    n, scale = len(ranks), len(counts) + 1
    while width < n:
        # runs are sorted; all left runs, each shifted to a range of its own, are searched for all right ones at once
        run = np.arange(n) // width
        left = run % 2 == 0
        pair = np.arange(n) // (2 * width)
        held, asked = ranks[left] + pair[left] * scale, ranks[~left] + pair[~left] * scale
        ends = np.searchsorted(held, (pair[~left] + 1) * scale)
        greater += int((ends - np.searchsorted(held, asked, side="right")).sum())
        ranks = ranks[np.lexsort((ranks, pair))]
        width *= 2
    return greater, ties


def _crossed(day: np.ndarray, value: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """The pairs (earlier, later) of places whose slope is above `low` and at most `high`: those that change their order
    between the values less the one line and less the other. Insertion meets each such pair once, and no others."""
    order = lambda slope: np.lexsort((-day, value - slope * day))  # noqa: E731  (later days first among equal values)
    place = np.empty(len(day), int)
    place[order(high)] = np.arange(len(day))
    done: list[tuple[int, int]] = []
    pairs = []
    for k in order(low).tolist():
        at = (int(place[k]), k)
        to = len(done)
        while to and done[to - 1] > at:
            to -= 1
            pairs.append(tuple(sorted((k, done[to][1]))))
        done.insert(to, at)
    return pairs


def _kth_slope(day: np.ndarray, value: np.ndarray, k: int) -> float:
    """The slope of rank k (from 0) among all pairs of days, without listing them all: pairs at or below a slope are counted
    by the inversions of the values less that line, until few stand between two bounds, and those are listed."""
    n = len(day)
    top = 2 * float(np.abs(value).max()) + 1.0  # days differ by one at least
    low, high, below, up_to = -top, top, 0, n * (n - 1) // 2
    draw = np.random.default_rng(n)
    while up_to - below > FEW:
        i, j = np.sort(draw.integers(0, n, (2, 64)), axis=0)
        tried = (value[j] - value[i])[i < j] / (day[j] - day[i])[i < j]
        tried = np.sort(tried[(tried > low) & (tried < high)])
        # a slope of the series itself, so that many equal ones are met exactly
        middle = float(tried[len(tried) // 2]) if len(tried) else (low + high) / 2
        if not low < middle < high:
            return high
        falling, level = _inversions(value - middle * day)
        if falling <= k < falling + level:
            return middle
        if falling + level > k:
            high, up_to = middle, falling + level
        else:
            low, below = middle, falling + level
    # a little wider, as counts of lines that nearly agree can err by rounding
    low -= 1e-9 * max(abs(low), 1e-3)
    high += 1e-9 * max(abs(high), 1e-3)
    below = sum(_inversions(value - low * day))
    found = sorted((value[j] - value[i]) / (day[j] - day[i]) for i, j in _crossed(day, value, low, high))
    return float(found[min(max(k - below, 0), len(found) - 1)])


def median_slope(day: np.ndarray, value: np.ndarray) -> float:
    """The median of the slopes of all pairs of days, of which there is one pair at least."""
    n = len(day)
    x, pairs = day.astype(float), n * (n - 1) // 2
    if pairs <= FEW:
        i, j = np.triu_indices(n, 1)
        return float(np.median((value[j] - value[i]) / (x[j] - x[i])))
    return float(np.mean([_kth_slope(x, value, k) for k in sorted({(pairs - 1) // 2, pairs // 2})]))


def mann_kendall(day: np.ndarray, value: np.ndarray) -> tuple[int, float | None, float | None]:
    """S (rising less falling pairs), its standard score with the correction for ties (null without variance), and the
    Theil-Sen slope a day (null for a single day)."""
    n = len(value)
    pairs = n * (n - 1) // 2
    falling, ties = _inversions(value)
    s = pairs - ties - 2 * falling
    groups = np.unique(value, return_counts=True)[1].astype(float)
    variance = (n * (n - 1) * (2 * n + 5) - float((groups * (groups - 1) * (2 * groups + 5)).sum())) / 18
    z = None if variance <= 0 else (s - np.sign(s)) / variance**0.5
    return s, None if z is None else float(z), median_slope(day, value) if pairs else None


def rank_trend(series: DataFrame, site: str) -> DataFrame:
    """(site, n, s, z, sen_slope) of a series (site, day, value): the Mann-Kendall statistic and its standard score, corrected for
    ties, and the Theil-Sen slope, the median of the slopes of all pairs of days.

    Pairs are counted by merging (n log n), and the median is found by bisection over such counts; no list of all pairs is
    made. One row a site and day is expected, as `daily_means` gives it.
    """
    schema = T.StructType([T.StructField(site, series.schema[site].dataType), T.StructField("n", T.LongType()), T.StructField("s", T.LongType()), T.StructField("z", T.DoubleType()), T.StructField("sen_slope", T.DoubleType())])

    def rank(rows: pa.Table) -> pa.Table:
        day, value = _series(rows)
        s, z, slope = mann_kendall(day, value)
        return pa.table([rows.column(site).slice(0, 1), pa.array([len(day)]), pa.array([s]), pa.array([z], pa.float64()), pa.array([slope], pa.float64())], names=schema.names)

    return series.select(site, F.col("day").cast("long").alias("day"), F.col("value").cast("double").alias("value")).groupBy(site).applyInArrow(rank, schema)
