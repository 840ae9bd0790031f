"""The paged source: pages, tries, filters, and streams that go on, start over or replay a fixed order."""

import sys
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe import streaming
from obsframe.sources import paged
from obsframe.streaming.alarms import gap_alarms

SCHEMA = "day int, n int"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import it


def pages_of(day, cursor):
    """Three pages of two rows a day."""
    at = cursor or 0
    rows = [10 * day + 2 * at, 10 * day + 2 * at + 1]
    return pa.RecordBatch.from_arrays([pa.array([day] * 2, pa.int32()), pa.array(rows, pa.int32())], names=["day", "n"]), at + 1 if at < 2 else None


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def every(days):
    return sorted((d, 10 * d + k) for d in days for k in range(6))


def test_all_pages_of_all_keys(spark, pushed):
    paged.register_pages(spark, "three_pages", paged.Service(SCHEMA, range(5), pages_of))
    assert sorted(map(tuple, spark.read.format("three_pages").load().collect())) == every(range(5))


def test_filters_drop_keys_before_they_are_fetched(spark, pushed, tmp_path):
    def fetch(day, cursor):
        (tmp_path / str(day)).touch()
        return pages_of(day, cursor)

    paged.register_pages(spark, "filtered", paged.Service(SCHEMA, range(9), fetch))
    got = spark.read.format("filtered").load().where("day >= 3 AND day IN (1, 3, 4, 7) AND day <> 7 AND n % 2 = 0")
    assert sorted(r.n for r in got.collect()) == [30, 32, 34, 40, 42, 44]
    assert sorted(p.name for p in tmp_path.iterdir()) in (["3", "4"], ["3", "4", "7"])


def test_no_pushdown_without_the_setting(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    paged.register_pages(spark, "unfiltered", paged.Service(SCHEMA, range(3), pages_of))
    got = spark.read.format("unfiltered").load().where("day = 1")
    assert sorted(map(tuple, got.collect())) == every([1])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_a_page_is_tried_again_alone(spark, pushed, tmp_path):
    def fetch(day, cursor):
        with (tmp_path / "log").open("a") as log:
            log.write(f"{day}/{cursor}\n")
        if day == 1 and cursor == 1 and (tmp_path / "log").read_text().split().count("1/1") < 3:
            raise OSError("later")
        return pages_of(day, cursor)

    paged.register_pages(spark, "flaky", paged.Service(SCHEMA, range(2), fetch, pause=0.0))
    assert sorted(map(tuple, spark.read.format("flaky").load().collect())) == every(range(2))
    log = (tmp_path / "log").read_text().split()
    assert log.count("1/1") == 3 and log.count("1/None") == 1


def test_a_page_that_never_comes_fails_the_read(spark, pushed):
    def fetch(day, cursor):
        raise OSError("never")

    paged.register_pages(spark, "dead", paged.Service(SCHEMA, [1], fetch, tries=2, pause=0.0))
    with pytest.raises(Exception, match="never"):
        spark.read.format("dead").load().collect()


def test_no_keys(spark, pushed):
    paged.register_pages(spark, "nothing", paged.Service(SCHEMA, [], pages_of))
    assert spark.read.format("nothing").load().collect() == []


def stored(spark, folder):
    return sorted((r.batch, r.day, r.n) for r in spark.read.parquet(folder).collect())


def test_stream_in_steps_goes_on_and_starts_over(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(name, days, **options):
        paged.register_pages(spark, name, paged.Service(SCHEMA, range(days), pages_of))
        stream = spark.readStream.format(name).options(perBatch=2, **options).load()
        streaming.store_new(stream, options.pop("out", out), state, steps=True)

    assert paged.committed(spark, state) == 0
    run("steps", 3)
    assert stored(spark, out) == sorted((d // 2, d, n) for d, n in every(range(3))) and paged.committed(spark, state) == 3
    run("more_steps", 6, start=paged.committed(spark, state))  # goes on behind what is committed
    assert stored(spark, out) == sorted(({0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}[d], d, n) for d, n in every(range(6)))
    again = str(tmp_path / "again")
    paged.register_pages(spark, "old_offset", paged.Service(SCHEMA, range(6), pages_of))
    stream = spark.readStream.format("old_offset").options(perBatch=2, start=3).load()
    streaming.store_new(stream, again, str(tmp_path / "fresh"), steps=True)
    assert [(d, n) for _, d, n in stored(spark, again)] == every(range(3, 6))


def test_a_batch_that_was_not_committed_runs_again_with_the_same_rows(spark, tmp_path):
    out, state = str(tmp_path / "out"), tmp_path / "state"
    paged.register_pages(spark, "rerun", paged.Service(SCHEMA, range(4), pages_of))
    run = lambda start: streaming.store_new(spark.readStream.format("rerun").options(perBatch=2, start=start).load(), out, str(state), steps=True)
    run(0)
    before = stored(spark, out)
    for name in ("1", ".1.crc"):
        (state / "commits" / name).unlink(missing_ok=True)
    assert paged.committed(spark, str(state)) == 2
    run(2)
    assert stored(spark, out) == before


def test_folder_pages(spark, pushed, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") % 3).cast("int").alias("part"), F.when(F.col("id") % 7 > 0, F.lit(datetime(2024, 1, 1))).alias("at"))
    rows = rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
    rows.repartition(2).write.option("parquet.block.size", 1 << 12).partitionBy("part").parquet(str(tmp_path / "p"))
    kept = T.StructType([rows.schema["id"], rows.schema["at"], rows.schema["part"]])
    service = paged.Service("id long, at timestamp_ntz, part int", [0, 1, 2, 9], paged.FolderPages(f"file:{tmp_path}/p", "part", kept), "part")
    assert len(list(service.pages(0))) >= 2 and [b.num_rows for b in service.pages(9)] == [0]
    paged.register_pages(spark, "folder", service)
    got = spark.read.format("folder").load()
    assert got.exceptAll(rows.select("id", "at", "part")).count() == 0 and got.count() == 5000


def alarms(spark, tmp_path, batches, known=None):
    """Alarms over batches of (site, time), each an arrival of its own."""
    flat = [(k, site, at) for k, rows in enumerate(batches) for site, at in rows]
    spark.createDataFrame(flat, "step int, site int, ts timestamp_ntz").write.partitionBy("step").parquet(str(tmp_path / "a"))
    kept = T._parse_datatype_string("site int, ts timestamp_ntz, step int")
    paged.register_pages(spark, "alarm_rows", paged.Service("site int, ts timestamp_ntz, step int", range(len(batches)), paged.FolderPages(f"file:{tmp_path}/a", "step", kept), "step"))
    stream = spark.readStream.format("alarm_rows").option("perBatch", 1).load().withColumn("ts", F.col("ts").cast("timestamp"))
    known = known and spark.createDataFrame(known, "site int, day date")
    with streaming.state_in_rocksdb(spark):
        return sorted((r.site, r.day.day) for r in streaming.drain(gap_alarms(stream, "site", "1 hour", known), "alarms", steps=True).collect())


def at(day, hour=12):
    return datetime(2024, 1, day, hour)


def test_alarms_come_when_a_day_has_passed(spark, tmp_path):
    batches = [[(1, at(1)), (2, at(2)), (None, at(1))], [(1, at(3)), (1, None)], [(1, at(6)), (2, at(4)), (2, at(6))], [(1, at(7, 0))]]
    # the watermark ends at 23:00 of day 6: days up to 5 are closed; site 2 is watched from day 2 on
    assert alarms(spark, tmp_path, batches) == [(1, 2), (1, 4), (1, 5), (2, 3), (2, 5)]


def test_known_sites_are_watched_without_a_row(spark, tmp_path):
    batches = [[(1, at(2))], [(1, at(4, 2))]]
    assert alarms(spark, tmp_path, batches, [(1, date(2024, 1, 1)), (9, date(2024, 1, 2)), (9, date(2024, 1, 3)), (None, date(2024, 1, 1))]) == [(1, 1), (1, 3), (9, 2), (9, 3)]


def test_alarms_of_many_sites_in_few_groups(spark, tmp_path, monkeypatch):
    """Sites that share a group's state and timer, each with its own first day."""
    monkeypatch.setattr(gap_alarms, "__defaults__", (None, "ts", 3))
    batches = [[(s, at(d)) for s in range(300) for d in range(1 + 3 * b, 4 + 3 * b) if d > s % 5 and (s + d) % 4] for b in range(3)] + [[(0, at(11))]]
    seen = {(s, t.day) for rows in batches for s, t in rows}
    first = {s: min(d for x, d in seen if x == s) for s, _ in seen}
    first |= {s: 1 for s in range(290, 310)}
    known = [(s, date(2024, 1, 1)) for s in range(290, 310)]
    assert alarms(spark, tmp_path, batches, known) == [(s, d) for s in sorted(first) for d in range(first[s], 11) if (s, d) not in seen]
