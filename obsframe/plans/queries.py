"""The registered observation queries, each with the SQL that gives the same rows.

The tables at hand hold no satellite data: `events` stands for observations
(user for site, event type for band) and the first two elements of
`embeddings` for places.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import streaming
from obsframe.functions import exact_sum, meta, point
from obsframe.operators import change, composite, reduce, select, series, space, tiles
from obsframe.operators.nearest import nearest
from obsframe.plans.requests import expand_requests
from obsframe.sources import paged, sketches, store
from obsframe.streaming.alarms import gap_alarms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FIRST, LAST = "2024-01-01", "2024-01-30"
#: An even polygon fixture: (zone, corners). The last one is not convex.
POLYGONS = {1: [(-0.2, -0.2), (0.2, -0.2), (0.0, 0.2)], 2: [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)], 3: [(0.0, 0.0), (0.3, 0.0), (0.3, 0.3), (0.15, 0.1), (0.0, 0.3)]}
EDGES = [(z, *corners[k], *corners[(k + 1) % len(corners)]) for z, corners in POLYGONS.items() for k in range(len(corners))]


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    """Days as text, which compares alike wherever the rows are read."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("day",)})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *point("embedding"))


def site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site to zone: customer, its nation, its region. Nation and region are small; Spark sees their size."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return named.select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("zone"))


@query("""SELECT r_name AS zone, event_type, count(value)::BIGINT AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total,
    sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean
    FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY ALL""")
def c07_reduce_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = select.filter_date(events(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 25))
    return reduce.reduce_zones(dated, site_zones(spark, sf_dir), "user_id", "zone", ["event_type"])


@query("""SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' END AS event_type, value
    FROM events WHERE event_type IN ('click', 'view')""")
def c01_select_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select.select_bands(events(spark, sf_dir), {"click": "tap", "view": "look"})
    return chosen.select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT event_id, ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def c02_filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_date(events(spark, sf_dir), datetime(2024, 1, 8), datetime(2024, 1, 15)).select("event_id", "ts", "event_type", "value")


@query("""SELECT event_id, value, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    WHERE k BETWEEN 10 AND 60 AND k IN (5, 10, 20, 35, 60, 99)""")
def c03_filter_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.filter_meta(events(spark, sf_dir), "$.k", 10, 60, [5, 10, 20, 35, 60, 99])
    return kept.select("event_id", "value", meta("$.k").cast("bigint").alias("k"))


@query("""SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
    WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.15 AND embedding[2]::DOUBLE BETWEEN -0.05 AND 0.2""")
def c04_filter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.filter_bounds(points(spark, sf_dir), (-0.1, -0.05, 0.15, 0.2))


@query(f"""WITH edges(zone, x1, y1, x2, y2) AS (VALUES {", ".join(f"({z}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for z, a, b, c, d in EDGES)}),
    p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
    SELECT vec_id, zone FROM p JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    GROUP BY vec_id, zone HAVING count(*) % 2 = 1""")
def c05_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(EDGES, "zone int, x1 double, y1 double, x2 double, y2 double")
    return space.within(points(spark, sf_dir), edges, "vec_id")


@query("""SELECT user_id, event_type, count(value)::BIGINT AS n, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean,
    round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS sd
    FROM events GROUP BY user_id, event_type""")
def c06_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce(events(spark, sf_dir), ["user_id", "event_type"])


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS step, event_type, count(value)::BIGINT AS n,
    sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean FROM events GROUP BY ALL""")
def c08_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.resample(events(spark, sf_dir), "day", ["event_type"])


_WIDE = ", ".join(f"sum(value::DECIMAL(18,6)) FILTER (event_type = '{b}')::DOUBLE AS {b}" for b in ("click", "purchase", "view"))


@query(f"SELECT user_id, ts::DATE::VARCHAR AS day, {_WIDE} FROM events GROUP BY ALL")
def c09_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = events(spark, sf_dir).withColumn("day", F.col("ts").cast("date").cast("string"))
    return reduce.to_wide(dated, ["user_id", "day"], ["click", "purchase", "view"])


@query("""SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def c10_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.latest(events(spark, sf_dir).drop("props"), ["user_id", "event_type"])


@query("""SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) = 1""")
def c11_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.best(events(spark, sf_dir).drop("props"), ["user_id", "event_type"])


@query("""SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def c12_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.percentiles(events(spark, sf_dir), ["event_type"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("SELECT event_type, floor(value / 5.0)::BIGINT AS bucket, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def c13_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.histogram(events(spark, sf_dir), ["event_type"], 5.0)


@query("""SELECT user_id, (a - b) / nullif(a + b, 0) AS norm_diff FROM (SELECT user_id,
    sum(value::DECIMAL(18,6)) FILTER (event_type = 'view')::DOUBLE AS a, sum(value::DECIMAL(18,6)) FILTER (event_type = 'click')::DOUBLE AS b
    FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)""")
def c14_norm_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.norm_diff(events(spark, sf_dir), ["user_id"], "view", "click")


@query("SELECT event_id, event_type, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 50 THEN value END AS value FROM events")
def c15_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.mask(events(spark, sf_dir), meta("$.k").cast("bigint") < 50).select("event_id", "event_type", "value")


_GRID = f"""grid AS (SELECT user_id, d::DATE AS day FROM (SELECT DISTINCT user_id FROM events), range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 1 DAY) r(d)),
    s AS (SELECT user_id, ts::DATE AS day, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"""


def grid_and_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = events(spark, sf_dir)
    return series.day_grid(seen.select("user_id"), FIRST, LAST), series.daily(seen, "user_id")


@query(f"""WITH {_GRID} SELECT user_id, day::VARCHAR AS day, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS value
    FROM grid LEFT JOIN s USING (user_id, day)""")
def c16_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(series.fill_forward(*grid_and_series(spark, sf_dir), "user_id"))


@query(f"WITH {_GRID} SELECT user_id, day::VARCHAR AS day FROM grid ANTI JOIN s USING (user_id, day)")
def c17_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(series.missing(*grid_and_series(spark, sf_dir), "user_id"))


@query("""SELECT event_id, user_id, event_type, ts, sum(value::DECIMAL(18,6)) OVER w ::DOUBLE AS moving_sum, count(value) OVER w AS moving_n FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def c18_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving(events(spark, sf_dir), ["user_id", "event_type"], 7).select("event_id", "user_id", "event_type", "ts", "moving_sum", "moving_n")


@query("""WITH m AS (SELECT event_type, dayofweek(ts) AS d, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS mean FROM events GROUP BY ALL)
    SELECT event_id, value, value - mean AS anomaly FROM events e LEFT JOIN m ON e.event_type IS NOT DISTINCT FROM m.event_type AND dayofweek(e.ts) IS NOT DISTINCT FROM m.d""")
def c19_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = events(spark, sf_dir).withColumn("weekday", F.dayofweek("ts"))
    return reduce.anomaly(dated, ["event_type", "weekday"]).select("event_id", "value", "anomaly")


@query("""SELECT user_id, count(*)::BIGINT AS n, round(regr_slope(value, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE), 4) AS slope,
    round(regr_intercept(value, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE), 3) AS intercept
    FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def c20_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.trend(events(spark, sf_dir), ["user_id"])


@query("""SELECT l.user_id, l.ts, l.event_id, l.value, coalesce(r.event_id, -1) AS match_id, r.value AS match_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def c21_match_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir)
    return series.match_asof(seen.where("event_type = 'purchase'"), seen.where("event_type = 'click'"), "user_id").fillna(-1, "match_id")


_PAIRS = """SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id{more}
    FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 6 HOURS AND l.ts + INTERVAL 6 HOURS
    WHERE l.event_type = 'purchase' AND r.event_type = 'click'"""


@query(_PAIRS.format(more=", epoch_us(r.ts) - epoch_us(l.ts) AS gap_micros"))
def c22_match_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir)
    return series.match_within(seen.where("event_type = 'purchase'"), seen.where("event_type = 'click'"), "user_id", 6 * 3600)


@query("SELECT event_id, event_type, value FROM events WHERE substr(md5(event_id::VARCHAR), 1, 8) < '40000000'")
def c23_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.sample_hash(events(spark, sf_dir), "event_id", 0.25).select("event_id", "event_type", "value")


@query("""SELECT event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) <= 20""")
def c24_sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.sample_strata(events(spark, sf_dir).select("event_type", "event_id", "value"), ["event_type"], 20, "event_id")


@query("""SELECT floor(embedding[1]::DOUBLE / 0.05)::BIGINT AS tile_x, floor(embedding[2]::DOUBLE / 0.05)::BIGINT AS tile_y, count(*)::BIGINT AS n
    FROM embeddings GROUP BY ALL""")
def c25_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.tile(points(spark, sf_dir), 0.05)


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN ts END AS ts, value,
    CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN event_type END AS event_type FROM events""")
def c26_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir)
    early = seen.where("ts < TIMESTAMP_NTZ '2024-01-20'").select("event_id", "ts", "value")
    late = seen.where("ts >= TIMESTAMP_NTZ '2024-01-10'").select("event_id", "value", "event_type")
    return composite.merge(early, late, "event_id")


@query("SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def c27_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir)
    return composite.new_rows(seen.select("event_id", "event_type", "value"), seen.where("ts < TIMESTAMP_NTZ '2024-01-16'"), "event_id")


@query("""SELECT s AS window_start, s + INTERVAL 7 DAYS AS window_end, event_type, count(value)::BIGINT AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total
    FROM (SELECT *, unnest(range(0, 7)) AS k FROM events), LATERAL (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(k::INTEGER) AS s) GROUP BY ALL""")
def c28_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.sliding(events(spark, sf_dir), "7 days", "1 day", ["event_type"])


def _paged(spark: SparkSession, rows: DataFrame, column: str, name: str) -> str:
    """A format that pulls `rows` page by page from a folder that stands for a remote service, by the values of `column`, ascending."""
    folder = streaming.shared_folder(spark, name)
    # as the service has them: pages of some thousand rows
    rows.write.option("parquet.block.size", 1 << 16).partitionBy(column).parquet(folder)
    keys = sorted(r[0] for r in rows.select(column).distinct().collect())
    kept = T.StructType([*(f for f in rows.schema if f.name != column), rows.schema[column]])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    paged.register_pages(spark, name, paged.Service(ddl, keys, paged.FolderPages(folder, column, kept), column))
    return name


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "value", F.col("ts").cast("date").cast("string").alias("day"))


@query("SELECT event_id, user_id, value, ts::DATE::VARCHAR AS day FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'")
def k01_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulled = spark.read.format(_paged(spark, _by_day(spark, sf_dir), "day", "pull_days")).load()
    return pulled.where((F.col("day") >= "2024-01-10") & (F.col("day") < "2024-01-21"))


@query("""WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL)
    SELECT day, n, total, CASE WHEN k > 14 THEN n END AS n_again, CASE WHEN k > 14 THEN total END AS total_again
    FROM (SELECT *, row_number() OVER (ORDER BY day) AS k FROM d)""")
def k01_pull_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days as a stream of a week a batch, and once more from the offset behind two weeks."""
    name = _paged(spark, _by_day(spark, sf_dir), "day", "stream_days")
    folder = streaming.shared_folder(spark, "pulled")
    daily = []
    for start in (0, 14):
        stream = spark.readStream.format(name).option("perBatch", 7).option("start", start).load()
        streaming.store_new(stream, f"{folder}/{start}", f"{folder}/state-{start}", steps=True)
        daily.append(spark.read.parquet(f"{folder}/{start}").groupBy("day").agg(F.count("*").alias("n"), exact_sum("value").alias("total")))
    again = daily[1].withColumnsRenamed({"n": "n_again", "total": "total_again"})
    return daily[0].join(again, "day", "left")


_POINTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_TILES = f"""{_POINTS}, t AS (SELECT floor(x / 0.05)::BIGINT AS tile_x, floor(y / 0.05)::BIGINT AS tile_y, count(*)::BIGINT AS n FROM p GROUP BY ALL)"""


@query(f"""WITH {_POINTS} SELECT query_id, rank, vec_id, sqrt(d) AS distance FROM (
        SELECT a.vec_id AS query_id, b.vec_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.vec_id)::INTEGER AS rank
        FROM p a JOIN p b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def c29_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(points(spark, sf_dir), 5)


@query(f"""WITH {_TILES} SELECT a.tile_x, a.tile_y, a.n, sum(b.n)::BIGINT AS window_sum, count(*)::BIGINT AS window_tiles
    FROM t a JOIN t b ON b.tile_x BETWEEN a.tile_x - 2 AND a.tile_x + 2 AND b.tile_y BETWEEN a.tile_y - 2 AND a.tile_y + 2 GROUP BY ALL""")
def c30_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.focal(space.tile(points(spark, sf_dir), 0.05), 2)


@query(f"""WITH RECURSIVE {_TILES}, kept AS (SELECT * FROM t WHERE n >= 3),
    reached AS (SELECT tile_x, tile_y, tile_x AS fx, tile_y AS fy FROM kept
        UNION SELECT k.tile_x, k.tile_y, r.fx, r.fy FROM reached r JOIN kept k ON abs(k.tile_x - r.tile_x) + abs(k.tile_y - r.tile_y) = 1),
    named AS (SELECT tile_x, tile_y, min((fx, fy)) AS f FROM reached GROUP BY ALL)
    SELECT f[1] AS region_x, f[2] AS region_y, count(*)::BIGINT AS tiles, sum(n)::BIGINT AS total, min(tile_x) AS x0, min(tile_y) AS y0, max(tile_x) AS x1, max(tile_y) AS y1
    FROM named JOIN kept USING (tile_x, tile_y) GROUP BY f""")
def c31_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.regions(space.tile(points(spark, sf_dir), 0.05), 3)


_DAILY = """d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS day, sum(value::DECIMAL(18,6))::DOUBLE / count(value) AS value
        FROM events WHERE value IS NOT NULL GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d)"""


@query(f"""WITH {_DAILY}, runs AS (
        SELECT a.user_id, a.n, a.i AS low, b.i + 1 AS high, a.day AS starts, regr_syy(c.value, c.day) - regr_sxy(c.value, c.day) ** 2 / regr_sxx(c.value, c.day) AS error
        FROM s a JOIN s b ON a.user_id = b.user_id AND b.i >= a.i + 4 JOIN s c ON c.user_id = a.user_id AND c.i BETWEEN a.i AND b.i
        WHERE a.i = 0 OR a.i >= 5 GROUP BY ALL),
    cuts AS (SELECT user_id, y.starts AS first, z.starts AS second, x.error + y.error + z.error AS error FROM runs x JOIN runs y USING (user_id) JOIN runs z USING (user_id)
        WHERE x.low = 0 AND y.low = x.high AND z.low = y.high AND z.high = z.n),
    whole AS (SELECT user_id, error FROM runs WHERE low = 0 AND high = n)
    SELECT user_id, (DATE '1970-01-01' + c.first::INTEGER)::VARCHAR AS first_break, (DATE '1970-01-01' + c.second::INTEGER)::VARCHAR AS second_break, round(c.error, 4) AS error, round(w.error, 4) AS error_without
    FROM (SELECT user_id, unnest(min_by(c, error)) FROM cuts c GROUP BY user_id) c JOIN whole w USING (user_id)""")
def c32_break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = change.break_points(change.daily_means(events(spark, sf_dir), "user_id"), "user_id", 2)
    day = lambda k: F.date_add(F.lit("1970-01-01").cast("date"), F.get("breaks", F.lit(k)).cast("int")).cast("string")
    return found.select("user_id", day(0).alias("first_break"), day(1).alias("second_break"), F.round("error", 4).alias("error"), F.round("error_without", 4).alias("error_without"))


@query(f"""WITH {_DAILY}, pairs AS (
        SELECT a.user_id, sign(b.value - a.value)::BIGINT AS s, (b.value - a.value) / (b.day - a.day) AS slope FROM s a JOIN s b ON a.user_id = b.user_id AND b.i > a.i),
    ties AS (SELECT user_id, sum(k * (k - 1) * (2 * k + 5))::DOUBLE AS t FROM (SELECT user_id, count(*) AS k FROM s GROUP BY user_id, value) GROUP BY user_id),
    sums AS (SELECT user_id, sum(s)::BIGINT AS s, quantile_cont(slope, 0.5) AS sen FROM pairs GROUP BY user_id),
    counts AS (SELECT user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id)
    SELECT user_id, n, coalesce(s, 0) AS s, round(CASE WHEN n * (n - 1) * (2 * n + 5) > t THEN (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - t) / 18) END, 6) AS z, round(sen, 6) AS sen_slope
    FROM counts JOIN ties USING (user_id) LEFT JOIN sums USING (user_id)""")
def c33_rank_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = change.rank_trend(change.daily_means(events(spark, sf_dir), "user_id"), "user_id")
    return found.withColumns({c: F.round(c, 6) for c in ("z", "sen_slope")})


@query("""SELECT event_type, count(value)::BIGINT AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total, count(DISTINCT user_id)::BIGINT AS sites, true AS p50_in_bounds, true AS p90_in_bounds
    FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY event_type""")
def k04_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks from stored sketches; the observations are read again only to see whether the quantiles keep their bounds."""
    path = streaming.shared_folder(spark, "sketches")
    sketches.write_sketches(events(spark, sf_dir), path, ["event_type"])
    found = sketches.read_range(spark, path, "2024-01-08", "2024-01-21", {"p50": 0.5, "p90": 0.9}, ["event_type"])
    seen = select.filter_date(events(spark, sf_dir), datetime(2024, 1, 8), datetime(2024, 1, 22)).select("event_type", "value")
    both = found.join(seen.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")))
    # three times the usual bound, which one in a hundred quantiles may miss
    slack = 3 * sketches.RANK_ERROR
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    inside = lambda q, p: (share(F.col("value") < F.col(q)) <= p + slack) & (share(F.col("value") <= F.col(q)) >= p - slack)
    return both.groupBy("event_type", "n", "total", "sites").agg(inside("p50", 0.5).alias("p50_in_bounds"), inside("p90", 0.9).alias("p90_in_bounds"))


@query("SELECT event_id, ts, value * 2 AS value, ts::DATE::VARCHAR AS day FROM events WHERE ts::DATE = DATE '2024-01-10' UNION ALL SELECT event_id, ts, value, ts::DATE::VARCHAR AS day FROM events WHERE ts::DATE <> DATE '2024-01-10'")
def k02_replace_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = streaming.shared_folder(spark, "days")
    rows = events(spark, sf_dir).select("event_id", "ts", "value")
    store.write_days(rows, path)
    day = select.filter_date(rows, datetime(2024, 1, 10), datetime(2024, 1, 11))
    store.write_days(day.withColumn("value", F.col("value") * 2), path)
    return day_text(store.read_days(spark, path))


def _exchange(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, rows = streaming.shared_folder(spark, kind), events(spark, sf_dir)
        store.export(rows, path, kind)
        return store.read_export(spark, path, kind, rows.schema)

    run.__name__ = f"k03_{kind}"
    return run


for _kind in ("csv", "json", "orc"):
    query("SELECT * FROM events")(_exchange(_kind))


@query("""SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL)
    WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def s01_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet")
    out = streaming.drain(streaming.tumbling_counts(stream, "1 day", "1 hour", ["event_type"]), "tumbling")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


#: Of ten rows one arrives one, five or nine days late; all others arrive on their day.
_ARRIVAL = "date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + CASE WHEN event_id % 10 = 3 THEN 1 + event_id % 3 * 4 ELSE 0 END"


@query(f"""WITH a AS (SELECT event_type, ts, date_trunc('day', ts)::TIMESTAMP AS window_start, (dense_rank() OVER (ORDER BY {_ARRIVAL}) - 1) // 3 AS batch FROM events),
    m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch) - INTERVAL 6 HOURS AS mark FROM a GROUP BY batch)
    SELECT window_start, event_type, (count(*) FILTER (mark IS NULL OR window_start + INTERVAL 1 DAY > mark))::BIGINT AS n,
        (count(*) FILTER (window_start + INTERVAL 1 DAY <= mark))::BIGINT AS late
    FROM a LEFT JOIN m ON m.batch = a.batch - 2 WHERE window_start + INTERVAL 1 DAY <= (SELECT max(mark) FROM m) GROUP BY ALL""")
def s02_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts over rows replayed in the order of their arrival, three days a batch, and how many rows came too late for
    them: those whose day the watermark, which a batch hands to the next but one, had passed."""
    seen = events(spark, sf_dir)
    first = seen.agg(F.min(F.col("ts").cast("date"))).scalar()
    late = F.when(F.col("event_id") % 10 == 3, 1 + F.col("event_id") % 3 * 4).otherwise(0)
    arrived = seen.select("ts", "event_type", (F.datediff("ts", first) + late).cast("int").alias("arrival"))
    stream = spark.readStream.format(_paged(spark, arrived, "arrival", "replay")).option("perBatch", 3).load()
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = streaming.drain(streaming.tumbling_counts(stream, "1 day", "6 hours", ["event_type"]), "late", steps=True)
    closed = F.col("window_start") + F.expr("INTERVAL 1 DAY") <= seen.agg(F.max("ts")).scalar() - F.expr("INTERVAL 6 HOURS")
    whole = seen.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("all")).where(closed)
    kept = kept.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    counted = whole.join(kept, ["window_start", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.select("window_start", "event_type", "n", (F.col("all") - F.col("n")).alias("late"))


@query(f"""WITH {_GRID} SELECT user_id, day::VARCHAR AS day FROM grid ANTI JOIN (SELECT DISTINCT user_id, ts::DATE AS day FROM events) USING (user_id, day)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def s09_gap_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = events(spark, sf_dir).select("user_id").distinct().withColumn("day", F.lit(FIRST).cast("date"))
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet")
    with streaming.state_in_rocksdb(spark):
        return day_text(streaming.drain(gap_alarms(stream, "user_id", "1 hour", known), "gaps"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k
    HAVING session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def s03_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet")
    out = streaming.drain(streaming.sessions(stream, "6 hours", "1 hour", "user_id"), "sessions")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"), "n")


@query("SELECT event_id, user_id, value FROM events")
def s04_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    twice = streaming.read_stream(spark, path).union(streaming.read_stream(spark, path))
    return streaming.drain(streaming.drop_repeats(twice.select("event_id", "ts", "user_id", "value"), "event_id", "1 hour"), "repeats").drop("ts")


@query(_PAIRS.format(more=""))
def s05_match_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    left = streaming.read_stream(spark, path).where("event_type = 'purchase'")
    right = streaming.read_stream(spark, path).where("event_type = 'click'")
    return streaming.drain(streaming.match_within(left, right, "user_id", "6 hours"), "pairs")


@query("""SELECT event_id, r_name AS zone, value FROM events
    JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def s06_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.drain(stream.join(site_zones(spark, sf_dir), "user_id").select("event_id", "zone", "value"), "enriched")


@query("SELECT event_id, value FROM events")
def s07_store_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = streaming.shared_folder(spark, "stored")
    for _ in range(2):  # the second run finds nothing new
        streaming.store_new(streaming.read_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "value"), f"{folder}/rows", f"{folder}/state")
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def s08_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet")
    return streaming.drain_latest(streaming.running_counts(stream, "user_id"), "user_id", "n", "running")


@query(f"""WITH {_GRID}, b AS (SELECT user_id, day, value,
        max(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day) AS da,
        min(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS db
        FROM grid LEFT JOIN s USING (user_id, day))
    SELECT b.user_id, b.day::VARCHAR AS day, coalesce(b.value, a.value + (c.value - a.value) * (date_diff('day', da, b.day)::DOUBLE / nullif(date_diff('day', da, db), 0)::DOUBLE)) AS value
    FROM b LEFT JOIN s a ON a.user_id = b.user_id AND a.day = da LEFT JOIN s c ON c.user_id = b.user_id AND c.day = db""")
def u01_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(series.interpolate(*grid_and_series(spark, sf_dir), "user_id"))


@query("SELECT user_id, event_type, max(value) - min(value) AS range FROM events GROUP BY ALL")
def u02_value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.value_range(events(spark, sf_dir), ["user_id", "event_type"])


@query("""WITH span AS (SELECT user_id, min(ts)::DATE AS f, max(ts)::DATE AS l FROM events GROUP BY user_id)
    SELECT user_id, s::DATE::VARCHAR AS start, least(s::DATE + 7, l + 1)::DATE::VARCHAR AS "end" FROM (SELECT *, unnest(range(f, l + 1, INTERVAL 7 DAYS)) AS s FROM span)""")
def u03_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"))
    return day_text(expand_requests(spans, "user_id", 7), "start", "end")
