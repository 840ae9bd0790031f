"""Reducers: per group, per zone and per time step.

Means are exact decimal sums over counts, so they don't depend on the order in
which partitions are added up; every sum is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as reduce_all

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsframe.functions import EXACT, exact_mean, exact_sum


def reduce(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean, median, min, max and sample standard deviation of the values that aren't null. The median is found as in
    `percentiles`: no task holds all values of a large group. Rows whose keys are null are groups too."""
    rows = df.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(value).alias(value), F.col(value).cast("double").alias("_v"))
    named, at = rows.columns[: len(keys)], {"median": 0.5}
    groups = rows.groupBy(*named).agg(
        F.count(value).alias("n"),
        exact_mean(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.stddev_samp(value), 6).alias("sd"),
        F.count("_v").alias("_total"),
    )
    values = rows.select(*named, "_v")
    middle = _ordered(values, groups, named, at).unionByName(_ranked(values, groups, named, at)).withColumnsRenamed({n: f"{n}m" for n in named})
    whole = groups.join(middle, _equal(named, "m"), "left")
    return whole.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "n", "mean", "median", "min", "max", "sd")


def value_range(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Largest less smallest value of each group."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("range"))


def reduce_zones(df: DataFrame, zones: DataFrame, site: str, zone: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Count, sum and mean per zone. Rows are summed per site first, so the join with the site-to-zone
    lookup sees one row a site and key however many observations a site has."""
    site_sums = df.groupBy(site, *keys).agg(F.count(value).alias("n"), F.sum(F.col(value).cast(EXACT)).alias("s"))
    joined = site_sums.join(zones.select(site, zone), site)
    total = F.sum("s").cast("double")
    return joined.groupBy(zone, *keys).agg(F.sum("n").alias("n"), total.alias("total"), F.try_divide(total, F.sum("n").cast("double")).alias("mean"))


def resample(df: DataFrame, unit: str, keys: Sequence[str] = (), time: str = "ts", value: str = "value") -> DataFrame:
    """Count and mean per step of `unit` (day, week, month, ...)."""
    return df.groupBy(F.date_trunc(unit, time).cast("timestamp_ntz").alias("step"), *keys).agg(F.count(value).alias("n"), exact_mean(value).alias("mean"))


def sliding(df: DataFrame, size: str, step: str, keys: Sequence[str] = (), time: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum over windows of `size` that start every `step`."""
    span = F.window(time, size, step)
    sums = df.groupBy(span.alias("w"), *keys).agg(F.count(value).alias("n"), exact_sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


#: Groups of up to so many values are put in order by one task each; larger ones are ranked in parts.
SMALL = 100_000
#: Ranks are looked for within this share of the rows around the sketched place (the sketch errs by half of it).
_MARGIN = 0.001


def percentiles(df: DataFrame, keys: Sequence[str], at: Mapping[str, float], value: str = "value", accuracy: int | None = None) -> DataFrame:
    """Interpolated percentiles, exact, or with `accuracy` approximate; nulls are skipped, and a group of nulls has null. NaN
    is the highest value. Results are rounded to 6 digits.

    Groups of up to SMALL values are put in order whole. Larger ones are found by rank: a quantile sketch of each group
    gives bounds a little below and above each place asked for; rows are counted between the bounds, and only those that
    lie in intervals which hold a rank are shuffled and put in order, interval by interval. So of a large group a small
    share moves, whatever its values are like, and the sketch decides how much is put in order, not what comes out."""
    if accuracy is not None:
        return df.groupBy(*keys).agg(*(F.round(F.percentile_approx(value, F.lit(p), accuracy), 6).alias(name) for name, p in at.items()))
    rows = df.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(value).cast("double").alias("_v"))
    named = rows.columns[:-1]
    groups = rows.groupBy(*named).agg(F.count("_v").alias("_total"))
    none = groups.where("_total = 0").select(*named, *(F.lit(None).cast("double").alias(name) for name in at))
    found = _ordered(rows, groups, named, at).unionByName(_ranked(rows, groups, named, at)).unionByName(none)
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), *at)


def _equal(named: Sequence[str], suffix: str) -> Column:
    return reduce_all(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(n + suffix)) for n in named), F.lit(True))


def _ordered(rows: DataFrame, groups: DataFrame, named: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """(keys, percentiles) of the groups of up to SMALL values."""
    small = groups.where(F.col("_total").between(1, SMALL)).select(*(F.col(n).alias(f"{n}s") for n in named))
    mine = rows.join(small, _equal(named, "s")).groupBy(*named).agg(F.percentile("_v", F.array(*map(F.lit, at.values()))).alias("_p"))
    return mine.select(*named, *(F.round(F.get("_p", F.lit(n)), 6).alias(name) for n, name in enumerate(at)))


def _ranked(rows: DataFrame, groups: DataFrame, named: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """(keys, percentiles) of the groups of more than SMALL values."""
    large = groups.where(F.col("_total") > SMALL).select(*(F.col(n).alias(f"{n}l") for n in named))
    rows = rows.where("_v is not null").join(large, _equal(named, "l")).select(*named, "_v")
    around = sorted({min(max(p + side * _MARGIN, 0.0), 1.0) for p in at.values() for side in (-1, 1)})
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, around)), int(2 / _MARGIN)).alias("_bounds")
    bounds = rows.groupBy(*(F.col(n).alias(f"{n}s") for n in named)).agg(sketch)
    # a bound that stands below a place counts from itself on, one above it behind itself, so that both are in between
    bound = lambda k: F.get("_bounds", F.lit(k))
    passed = [F.when((F.col("_v") > bound(k)) | ((F.col("_v") == bound(k)) & F.lit(k % 2 == 0)), 1).otherwise(0) for k in range(len(around))]
    placed = rows.join(bounds, _equal(named, "s")).select(*named, "_v", reduce_all(lambda x, y: x + y, passed).alias("_place"))
    of_group = Window.partitionBy(*named)
    up_to = Window.unboundedPreceding
    parts = placed.groupBy(*named, "_place").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(of_group.orderBy("_place").rowsBetween(up_to, 0)) - F.col("_n"))
    parts = parts.withColumn("_total", F.sum("_n").over(of_group))
    rank = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_n"))
    asked = parts.where(reduce_all(lambda x, y: x | y, (holds(r(rank(p))) for p in at.values() for r in (F.floor, F.ceil))))
    asked = asked.select(*(F.col(n).alias(f"{n}b") for n in named), F.col("_place").alias("_placeb"), F.col("_before").alias("_first"), "_total")
    counts = placed.join(asked, _equal(named, "b") & (F.col("_place") == F.col("_placeb"))).groupBy(*named, "_place", "_first", "_total", "_v").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*named, "_place").orderBy("_v").rowsBetween(up_to, 0)
    values = counts.withColumn("_before", F.col("_first") + F.sum("_n").over(order) - F.col("_n"))
    ends = [F.max(F.when(holds(r(rank(p))), F.col("_v"))).alias(f"{name}{side}") for name, p in at.items() for side, r in (("_a", F.floor), ("_b", F.ceil))]
    found = values.groupBy(*named).agg(F.max("_total").alias("_total"), *ends)

    def between(name: str, p: float) -> Column:
        a, b, r = F.col(f"{name}_a"), F.col(f"{name}_b"), rank(p)
        return F.when(a == b, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b)

    return found.select(*named, *(F.round(between(name, p), 6).alias(name) for name, p in at.items()))


def histogram(df: DataFrame, keys: Sequence[str], width: float, value: str = "value") -> DataFrame:
    """Counts per bucket of `width`; a bucket is named by its number, floor(value / width)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / width).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def to_wide(df: DataFrame, keys: Sequence[str], bands: Sequence[str], band: str = "event_type", value: str = "value") -> DataFrame:
    """One column a band: its sum in each group. The bands are given, so no job looks for them first."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col(band) == b, F.col(value).cast(EXACT))).cast("double").alias(b) for b in bands))


def norm_diff(df: DataFrame, keys: Sequence[str], a: str, b: str, band: str = "event_type", value: str = "value") -> DataFrame:
    """(a - b) / (a + b) of two bands' sums per group; null where a band is missing or the sum is zero."""
    wide = to_wide(df.where(F.col(band).isin(a, b)), keys, [a, b], band, value)
    return wide.select(*keys, F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b)).alias("norm_diff"))


def trend(df: DataFrame, keys: Sequence[str], time: str = "ts", value: str = "value") -> DataFrame:
    """Least-squares line of the value over days since 1970; slope and intercept per group."""
    day = F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    fit = df.where(F.col(value).isNotNull()).select(*keys, day.alias("_x"), F.col(value).alias("_y"))
    return fit.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.regr_slope("_y", "_x"), 4).alias("slope"), F.round(F.regr_intercept("_y", "_x"), 3).alias("intercept"))


def anomaly(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The value less the mean of its group; rows whose keys are null are groups too. The groups' means are
    joined back: groups may be few and large, and a window over them would put each into one task."""
    means = df.groupBy(*(F.col(k).alias(f"_{n}") for n, k in enumerate(keys))).agg(exact_mean(value).alias("_mean"))
    same = reduce_all(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{n}")) for n, k in enumerate(keys)))
    return df.join(means, same, "left").withColumn("anomaly", F.col(value) - F.col("_mean")).drop("_mean", *(f"_{n}" for n in range(len(keys))))
