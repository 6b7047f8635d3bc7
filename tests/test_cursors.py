"""Cursors of feeds outside the usual nine, in the stream and in the batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regfeed.operators import liveness, schema
from regfeed.session import work_path
from regfeed.streaming import jobs, tables

SCHEMA = "stream_path string, timepoint bigint, received timestamp_ntz, event_id bigint"


def test_cursors_of_every_feed(spark):
    at = dt.datetime(2024, 1, 10)
    first = [("orders", 3, at, 1), ("companies", 8, at, 2), (None, 1, at, 3), ("orders", 2, at - dt.timedelta(hours=1), 4)]
    later = [("orders", 9, at + dt.timedelta(hours=1), 5), ("old", 1, at - dt.timedelta(days=9), 6)]
    folder, checkpoint = work_path(spark, "in"), work_path(spark, "checkpoint")
    for rows in (first, later):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        cells = jobs.cursors(tables.source(spark, folder, spark.createDataFrame([], SCHEMA).schema), spark, checkpoint)
    streamed = {r.stream_path: r.timepoint for r in cells.collect()}
    assert streamed == {"orders": 9, "companies": 8, "old": 1}

    log = spark.createDataFrame(first + later, SCHEMA)
    now = F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    assert {r.stream_path: r.timepoint for r in liveness.latest_cursor(log, now).collect()} == {"orders": 9, "companies": 8}
    assert {r.stream_path for r in liveness.latest_cursor(log, now, ("companies",)).collect()} == {"companies"}


def feed_batches(spark, batches, schema_text, job):
    """Run a job once per batch on one checkpoint; the result of its last start."""
    folder, checkpoint = work_path(spark, "in"), work_path(spark, "checkpoint")
    for rows in batches:
        df = spark.createDataFrame(rows, schema_text)
        df.coalesce(1).write.mode("append").parquet(folder)
        done = job(tables.source(spark, folder, df.schema), checkpoint)
    return done


def test_cursors_expire_in_the_table(spark):
    at = dt.datetime(2024, 1, 10)
    hours = lambda n: at + dt.timedelta(hours=n)
    first = [("a", 1, hours(0), 1), ("b", 1, hours(1), 2)]
    later = [("b", 2, hours(5), 3), ("c", 1, hours(2), 4), (None, 1, hours(9), 5)]
    back = [("a", 2, hours(4), 6), ("a", 1, hours(0), 7)]
    for batches in ([first, later, back], [first + later + back], [back, later, first]):
        cells = feed_batches(spark, batches, SCHEMA, lambda live, at: jobs.cursors(live, spark, at, "2 hours"))
        assert {r.stream_path: r.timepoint for r in cells.collect()} == {"a": 2, "b": 2}


def test_health_changes_are_told_once(spark):
    at = dt.datetime(2024, 1, 10)
    text = "stream_path string, received timestamp_ntz"
    second = lambda n: at + dt.timedelta(seconds=n)
    batches = [[("a", second(0)), ("b", second(10))], [("a", second(65))], [("a", second(100)), (None, second(500))], [("b", second(120))]]
    now, changes = feed_batches(spark, batches, text, lambda live, at: jobs.health(live, spark, at, ("a", "b", "c")))
    assert {r.stream_path: r.healthy for r in now.collect()} == {"a": True, "b": True, "c": False}
    told = [(r.batch_id, r.stream_path, r.healthy, r["at"]) for r in changes.orderBy("batch_id", "stream_path").collect()]
    assert told == [(0, "a", True, second(10)), (0, "b", True, second(10)), (2, "b", False, second(100)), (3, "b", True, second(120))]


def test_a_batch_shows_when_all_its_parts_are_written(spark, monkeypatch):
    done = jobs.FanOut(spark)
    text = "stream_path string, resource_kind string, company_number string, data string, line string"
    batch = [spark.createDataFrame([("companies", "k", f"1234567{i}", '{"a":1}', "{}")], text) for i in range(2)]
    done.save(batch[0], 0)
    with monkeypatch.context() as broken:
        broken.setattr(schema, "type_counts", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            done.save(batch[1], 1)
    assert (done.committed(), done.messages().count(), done.pooled().count()) == (0, 1, 1)
    done.save(batch[1], 1)
    assert (done.committed(), done.messages().count(), done.pooled().count()) == (1, 2, 2)
    assert {(r.path, r.nodes) for r in done.schema_counts().collect()} == {("$", 2), ("$.a", 2)}
