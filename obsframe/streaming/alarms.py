"""Alarms for what is missing on a stream, as it happens."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Groups of sites whose state is one value each.
GROUPS = 1024


def _day(ms: int) -> date:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)).date()


class GapProcessor(StatefulProcessor):
    """State of a group of sites: the first day for which its timer stands, and of each site the first open day and the open
    days that have a row. It is one value, as each call to the state costs more than many sites do. The timer
    stands at the end of the group's first open day; when it goes off, all days that ended before the watermark are closed."""

    def __init__(self, kind: T.DataType):
        days = T.ArrayType(T.LongType())
        self.schema = T.StructType([T.StructField("next", T.LongType()), T.StructField("sites", T.ArrayType(kind)), T.StructField("open", days), T.StructField("seen", T.ArrayType(days))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def _read(self) -> tuple[int | None, dict[object, tuple[int, set[int]]]]:
        held = self.state.get()
        return (held[0], {s: (d, set(seen)) for s, d, seen in zip(*held[1:], strict=True)}) if held else (None, {})

    def _write(self, timer: int | None, first: int, sites: dict[object, tuple[int, set[int]]]) -> None:
        """Keep the group, with a timer for the day `first` if none stands for it or an earlier one."""
        if timer is None or first < timer:
            self.handle.registerTimer((first + 1) * DAY_MS)
            timer = first
        self.state.update((timer, list(sites), [d for d, _ in sites.values()], [sorted(seen) for _, seen in sites.values()]))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  (Spark's names)
        timer, sites = self._read()
        for site, day in zip(initialState["site"].tolist(), initialState["day"].tolist(), strict=True):
            sites.setdefault(site, (day, set()))
        self._write(timer, min(d for d, _ in sites.values()), sites)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh: dict[object, set[int]] = {}
        for batch in rows:
            days = batch[["site", "day"]].drop_duplicates()
            for site, day in zip(days["site"].tolist(), days["day"].tolist(), strict=True):
                fresh.setdefault(site, set()).add(day)
        timer, sites = self._read()
        for site, days in fresh.items():
            first, seen = sites.setdefault(site, (min(days), set()))
            seen.update(d for d in days if d >= first)
        if fresh:
            self._write(timer, min(sites[s][0] for s in fresh), sites)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer, sites = self._read()
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        if passed <= timer:  # an earlier timer has closed this one's day
            return
        gone = [(s, d) for s, (first, seen) in sites.items() for d in range(first, passed) if d not in seen]
        self._write(None, passed, {s: (max(first, passed), {d for d in seen if d >= passed}) for s, (first, seen) in sites.items()})
        if gone:
            yield pd.DataFrame({"site": [s for s, _ in gone], "day": [_day(d * DAY_MS) for _, d in gone]})


def gap_alarms(df: DataFrame, site: str, delay: str, known: DataFrame | None = None, time: str = "ts", groups: int = GROUPS) -> DataFrame:
    """(site, day) for each day that passes without a row of a site, when the watermark (`delay` behind the latest time)
    passes the day's end. A site is watched from its first row's day on, or, if it is in `known` (site, day), from that
    day on, even if it never has a row. Rows behind the watermark don't count; rows without a site or time are left out.

    The state of a site is its open days, so it doesn't grow with the rows. Sites are kept in `groups` groups by hash, each read
    and written whole in a batch that has rows of it; a stream keeps the number it began with. Append mode; start
    it inside `state_in_rocksdb`.
    """
    number = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    group = F.pmod(F.xxhash64(F.col(site)), F.lit(groups)).alias("group")
    rows = df.where(F.col(site).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay).select(group, F.col(site).alias("site"), time, number(time).alias("day"))
    start = None
    if known is not None:
        start = known.where(F.col(site).isNotNull()).groupBy(group, F.col(site).alias("site")).agg(F.min(number("day")).alias("day")).groupBy("group")
    kind = df.schema[site].dataType
    out = T.StructType([T.StructField("site", kind), T.StructField("day", T.DateType())])
    found = rows.groupBy("group").transformWithStateInPandas(GapProcessor(kind), outputStructType=out, outputMode="Append", timeMode="EventTime", initialState=start)
    return found.select(F.col("site").alias(site), "day")
