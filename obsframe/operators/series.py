"""Series of a site over time: grids, gaps, moving sums and matches between bands.

What works on single observations cuts a site's rows by time, so that a busy site
is many tasks' work. What works on a grid has one row a site and day, which
`daily` sums up before the shuffle: however busy, a site has as many as there are days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_grid(sites: DataFrame, start: str, end: str) -> DataFrame:
    """Every site on every day, start to end inclusive."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return sites.distinct().withColumn("day", F.explode(days))


def daily(df: DataFrame, site: str, time: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """The last value of each site and day."""
    day = df.where(F.col(value).isNotNull()).groupBy(site, F.col(time).cast("date").alias("day"))
    return day.agg(F.max_by(value, F.struct(time, tie)).alias(value))


def fill_forward(grid: DataFrame, series: DataFrame, site: str, value: str = "value") -> DataFrame:
    """The series on the grid, each gap filled with the last value before it."""
    before = Window.partitionBy(site).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(series, [site, "day"], "left").withColumn(value, F.last(value, ignorenulls=True).over(before))


def interpolate(grid: DataFrame, series: DataFrame, site: str, value: str = "value") -> DataFrame:
    """The series on the grid, gaps filled on the line between the values around them; null outside."""
    rows = grid.join(series, [site, "day"], "left")
    back = Window.partitionBy(site).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(site).orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("day", value))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    share = F.try_divide(F.datediff("day", "_a.day").cast("double"), F.datediff("_b.day", "_a.day").cast("double"))
    line = F.col(f"_a.{value}") + (F.col(f"_b.{value}") - F.col(f"_a.{value}")) * share
    return rows.select(site, "day", F.coalesce(value, line).alias(value))


def missing(grid: DataFrame, series: DataFrame, site: str) -> DataFrame:
    """Grid days without a value."""
    return grid.join(series.select(site, "day"), [site, "day"], "left_anti")


def moving(df: DataFrame, keys: Sequence[str], days: int, time: str = "ts", value: str = "value") -> DataFrame:
    """Sum and count of the values in the `days` days up to and with each row. A series is cut into slices of
    four times that; the last rows of a slice go along with the next one, whose windows reach back to them."""
    length = days * 86_400_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    own = F.floor(micros / (4 * length))
    reached = (own + 1) * (4 * length) - micros <= length
    dealt = df.withColumn("_own", own).withColumn("_slice", F.explode(F.when(reached, F.array(own, own + 1)).otherwise(F.array(own))))
    span = Window.partitionBy(*keys, "_slice").orderBy(micros).rangeBetween(-length, 0)
    sums = dealt.withColumn("moving_sum", F.sum(F.col(value).cast("decimal(18,6)")).over(span).cast("double")).withColumn("moving_n", F.count(value).over(span))
    return sums.where(F.col("_own").eqNullSafe(F.col("_slice"))).drop("_own", "_slice")


def match_asof(left: DataFrame, right: DataFrame, site: str, time: str = "ts", key: str = "event_id", value: str = "value") -> DataFrame:
    """For each left row the last right row of its site at or before it. Of equal times the right row with the
    larger id counts. Both are sorted together day by day instead of joined by ranges; what a day finds in none
    of its own rows is the last right row of the days before, of which there is one a site and day."""
    side = lambda df, n: df.select(site, time, key, value, F.col(time).cast("date").alias("_day"), F.lit(n).alias("_right"))
    both = side(left, 0).unionByName(side(right, 1))
    seen = F.when(F.col("_right") == 1, F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
    order = Window.partitionBy(site, "_day").orderBy(time, F.desc("_right"), key).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last(seen, ignorenulls=True).over(order)).where("_right = 0")
    latest = F.max(F.when(F.col("_right") == 1, F.struct(F.col(time).alias("t"), F.col(key).alias("k"), F.col(value).alias("v"))))
    before = Window.partitionBy("_s").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    daily_last = both.groupBy(F.col(site).alias("_s"), F.col("_day").alias("_d")).agg(latest.alias("_last"))
    carried = daily_last.select("_s", "_d", F.last("_last", ignorenulls=True).over(before).alias("_c"))
    found = found.join(carried, F.col(site).eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    pick = lambda c: F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(f"_c.{c}"))
    return found.select(site, time, key, value, pick("k").alias("match_id"), pick("v").alias("match_value"))


def match_within(left: DataFrame, right: DataFrame, site: str, seconds: int, time: str = "ts", key: str = "event_id") -> DataFrame:
    """Pairs of one site at most `seconds` apart. A time bucket is part of the join key, so a busy site is
    spread over its buckets; each left row looks into the bucket before and behind its own too."""
    stamp = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(stamp / (seconds * 1_000_000))
    a = left.select(site, F.col(key).alias("left_id"), stamp.alias("_a"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    b = right.select(site, F.col(key).alias("right_id"), stamp.alias("_b"), slot.alias("_slot"))
    near = F.abs(F.col("_a") - F.col("_b")) <= seconds * 1_000_000
    return a.join(b, [site, "_slot"]).where(near).select(site, "left_id", "right_id", (F.col("_b") - F.col("_a")).alias("gap_micros"))
