"""Cases that the tables don't hold: nulls, ties, empty groups, late rows, edges."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from obsframe import streaming
from obsframe.operators import composite, reduce, select, series, space
from obsframe.plans.requests import expand_requests
from obsframe.sources import store
from obsframe.sources.remote import register_pull

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def few(spark):
    rows = [
        (1, T0, 1, "a", 1.0, '{"k": 1}'),
        (2, T0, 1, "a", None, '{"k": "x"}'),
        (3, T0, 1, "a", 5.0, "broken"),
        (4, datetime(2024, 1, 3), 1, "b", 5.0, None),
        (5, datetime(2024, 1, 2), 2, "b", None, "{}"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_meta_filter_skips_other_values(few):
    assert [r.event_id for r in select.filter_meta(few, "$.k", 0, 9).collect()] == [1]


def test_reducers_skip_nulls(few):
    got = {(r.user_id, r.event_type): r for r in reduce.reduce(few, ["user_id", "event_type"]).collect()}
    assert (got[1, "a"].n, got[1, "a"].mean, got[1, "a"].median) == (2, 3.0, 3.0)
    assert (got[2, "b"].n, got[2, "b"].mean, got[2, "b"].sd) == (0, None, None)


def test_ties(few):
    assert composite.latest(few.where("event_type = 'a'"), ["user_id"]).first().event_id == 3
    assert composite.best(few.where("user_id = 1"), ["user_id"]).first().event_id == 3


def test_norm_diff_without_a_band_is_null(few):
    got = {r.user_id: r.norm_diff for r in reduce.norm_diff(few, ["user_id"], "a", "b").collect()}
    assert got == {1: (6 - 5) / 11, 2: None}


def test_fill_and_interpolate(spark, few):
    grid = series.day_grid(spark.createDataFrame([(1,)], "user_id long"), "2024-01-01", "2024-01-04")
    known = spark.createDataFrame([(1, date(2024, 1, 1), 1.0), (1, date(2024, 1, 3), 5.0)], "user_id long, day date, value double")
    values = lambda df: [r.value for r in df.orderBy("day").collect()]
    assert values(series.fill_forward(grid, known, "user_id")) == [1.0, 1.0, 5.0, 5.0]
    assert values(series.interpolate(grid, known, "user_id")) == [1.0, 3.0, 5.0, None]
    assert series.missing(grid, known, "user_id").count() == 2
    assert series.daily(few, "user_id").where("user_id = 1").orderBy("day").first().value == 5.0


def test_asof_takes_equal_times(few):
    got = series.match_asof(few.where("event_id = 4"), few.where("event_type = 'a'"), "user_id").first()
    assert got.match_id == 3
    assert series.match_asof(few.where("event_id = 1"), few.where("event_id = 3"), "user_id").first().match_id == 3


def test_within_each_edge(spark):
    square = [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "zone int, x1 double, y1 double, x2 double, y2 double")
    points = [(1, 0.5, 0.5), (2, 0.0, 0.5), (3, 1.0, 0.5), (4, 0.5, 0.0), (5, 0.5, 1.0), (6, 2.0, 0.5), (7, None, 0.5)]
    got = space.within(spark.createDataFrame(points, "id int, x double, y double"), edges, "id")
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]


def test_merge_and_new_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "id int, a double")
    b = spark.createDataFrame([(2, 3.0), (2, 4.0)], "id int, b double")
    assert sorted(map(tuple, composite.merge(a, b, "id").collect()), key=str) == [(1, 1.0, None), (2, None, 4.0)]
    assert [r.id for r in composite.new_rows(a, b, "id").collect()] == [1]


def test_requests_end_with_the_span(spark):
    spans = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 1, 8))], "s int, first_day date, last_day date")
    assert [(r.start.day, r.end.day) for r in expand_requests(spans, "s", 7).collect()] == [(1, 8), (8, 9)]


def test_store_replaces_only_given_days(spark, few, tmp_path):
    store.write_days(few, str(tmp_path))
    store.write_days(few.where("event_id = 4").withColumn("value", F.lit(9.0)), str(tmp_path))
    assert store.read_days(spark, str(tmp_path)).count() == 5
    assert [r.value for r in store.read_days(spark, str(tmp_path), "2024-01-03", "2024-01-03").collect()] == [9.0]


@pytest.mark.parametrize("kind", ["csv", "json", "orc", "parquet"])
def test_exchange_round_trip(spark, tmp_path, kind):
    rows = [(1, 'a "b", \n', None), (2, "", T0.replace(microsecond=123456)), (3, None, T0)]
    df = spark.createDataFrame(rows, "id long, t string, ts timestamp_ntz")
    store.export(df.where("id <> 1") if kind == "csv" else df, str(tmp_path / kind), kind)
    got = store.read_export(spark, str(tmp_path / kind), kind, df.schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[1:] if kind == "csv" else rows, key=str)


def test_pull_drops_requests_and_tries_again(spark, tmp_path):
    seen = tmp_path / "seen"

    def fetch(day):
        with seen.open("a") as f:
            f.write(f"{day}\n")
        if seen.read_text().split().count("8") == 1 and day == 8:
            raise OSError("later")
        return iter([(site, day, float(day)) for site in range(2)])

    register_pull(spark, "fake_pull", "site int, day int, value double", range(10), fetch)
    got = spark.read.format("fake_pull").load().where("day >= 7")
    assert got.rdd.getNumPartitions() == 3 and sorted({r.day for r in got.collect()}) == [7, 8, 9]
    assert set(seen.read_text().split()) == {"7", "8", "9"}


def _files(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{folder}/{k}")


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    _files(spark, tmp_path, [[(1, at(1), 1), (2, at(3), 1)], [(3, at(4), 1)], [(4, at(1), 1), (5, at(5), 1)], [(6, at(7), 1)]])
    schema = spark.read.parquet(str(tmp_path / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.drain(streaming.tumbling_counts(stream, "1 day", "1 hour", ["user_id"]), "late").collect()
    assert sum(r.n for r in got if r.window_start.day == 1) == 1  # row 4 came after the day was closed


def test_store_new_is_idempotent(spark, tmp_path):
    _files(spark, tmp_path / "in", [[(1, T0, 1)], [(2, T0, 1)]])
    for _ in range(2):
        stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").parquet(str(tmp_path / "in" / "*"))
        streaming.store_new(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_anomaly_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, None, 7.0)], "event_id long, event_type string, value double")
    got = {r.event_id: r.anomaly for r in reduce.anomaly(df, ["event_type"]).collect()}
    assert got == {1: -1.0, 2: 1.0, 3: -1.0, 4: 1.0}


@pytest.mark.parametrize("small", [0, 5, 100_000])
def test_percentiles_agree_with_the_builtin(spark, monkeypatch, small):
    monkeypatch.setattr(reduce, "SMALL", small)  # groups are put in order whole, found by rank, or some of each
    values = [None, 0.0, -0.5, 1e-300, 7.25, 7.25, 3e8, -4.0, float("inf"), 2.0, 2.0000001]
    rows = [(k if k < 3 else None, v) for k in range(4) for v in values[: 3 * k + 1]]
    df = spark.createDataFrame(rows, "g int, value double")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.77, "e": 1.0}
    builtin = df.groupBy("g").agg(*(F.round(F.percentile("value", F.lit(p)), 6).alias(n) for n, p in at.items()))
    key = lambda r: (r.g is None, r.g)
    assert sorted(reduce.percentiles(df, ["g"], at).collect(), key=key) == sorted(builtin.collect(), key=key)
    assert reduce.percentiles(df.limit(0), ["g"], at).collect() == []


def test_series_cut_by_time_agree_with_whole_ones(spark):
    rows = [(n, n % 3 if n % 7 else None, n * 7919 % 90 * 8, float(n)) for n in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id int, hour int, value double")
    df = df.withColumn("ts", F.expr("timestampadd(HOUR, hour, timestamp_ntz'2024-01-01')"))
    got = {r.event_id: (r.moving_sum, r.moving_n) for r in series.moving(df, ["user_id"], 2).collect()}
    matched = {r.event_id: r.match_id for r in series.match_asof(df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"), "user_id").collect()}
    for n, site, hour, _ in rows:
        near = [v for _, s, h, v in rows if s == site and hour - 48 <= h <= hour]
        assert got[n] == (sum(near), len(near))
        if n % 2 == 0:
            before = [(h, k) for k, s, h, _ in rows if k % 2 and s == site and h <= hour]
            assert matched[n] == (max(before)[1] if before else None)
