"""Plans for pulls: which site and days each request asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_requests(spans: DataFrame, site: str, days: int, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Each site's days from first to last in requests of at most `days` days: start inclusive, end exclusive."""
    starts = F.sequence(F.col(first), F.col(last), F.expr(f"interval {days} days"))
    cut = spans.select(site, F.explode(starts).alias("start"), F.date_add(last, 1).alias("_end"))
    return cut.select(site, "start", F.least(F.date_add("start", days), "_end").alias("end"))
