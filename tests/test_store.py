"""Export with reconciliation, archive reads, streaming restarts, and the service object."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from regfeed.operators import export, schema
from regfeed.plans.api import FeedService
from regfeed.plans.nightly import Buffer, run_export
from regfeed.session import materialise, work_path
from regfeed.streaming import jobs, tables

DAY = dt.date(2024, 2, 1)
FEED, OTHER = "companies", "filings"


def buffer_rows():
    """Two feeds over three days; one event has no kind, and one day was published out of order."""
    rows = []
    for i in range(30):
        published = dt.datetime(2024, 1, 1 + i // 10)
        rows.append((FEED, i, published, None if i == 4 else ("a" if i % 2 else "b"), "{}"))
    for i in range(20):
        # The earlier positions carry the later day.
        rows.append((OTHER, i, dt.datetime(2024, 1, 9) if i < 10 else dt.datetime(2024, 1, 3), "f", "{}"))
    return rows


@pytest.fixture(scope="module")
def buffered(spark):
    schema_text = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, event_data string"
    return materialise(spark.createDataFrame(buffer_rows(), schema_text), "buffer")


def test_export_and_remaining_are_the_input(spark, buffered):
    done = run_export(buffered, DAY, records_per_file=4)
    archive = [(r.stream, r.timepoint) for r in export.read_archive(spark, done.path).collect()]
    left = [(r.stream_path, r.timepoint) for r in done.remaining.collect()]
    assert sorted(archive + left) == sorted((r[0], r[1]) for r in buffer_rows())
    # The day with the greatest position stays: the third one here, and the second half of the other feed.
    assert sorted(left) == [(FEED, i) for i in range(20, 30)] + [(OTHER, i) for i in range(10, 20)]
    assert export.overlapping_parts(done.files).count() == 0
    assert {(r.resource_kind, r.exported) for r in done.reconciled.where(F.col("stream_path") == FEED).collect()} == {("a", 10), ("b", 9), (export.NO_KIND, 1)}


def test_export_again_replaces_and_keeps_other_days(spark, buffered):
    path = work_path(spark, "archive")
    run_export(buffered, DAY, path)
    run_export(buffered, DAY + dt.timedelta(days=1), path)
    again = run_export(buffered, DAY, path)
    assert export.read_archive(spark, path).count() == 60
    assert again.reconciled.where(~F.col("can_delete")).count() == 0


def test_kinds_with_unequal_counts_stay(spark, buffered):
    done = run_export(buffered, DAY)
    short = done.files.withColumn("events", F.when(F.col("resource_kind") == "a", F.col("events") - 1).otherwise(F.col("events")))
    checked = export.reconcile(short, export.kind_counts(export.eligible(buffered, done.cutoff)))
    assert [(r.resource_kind, r.can_delete) for r in checked.where(~F.col("can_delete")).collect()] == [("a", False)]
    left = export.remaining(buffered, done.cutoff, checked)
    assert left.where((F.col("timepoint") < 20) & (F.col("stream_path") == FEED)).select("resource_kind").distinct().first()[0] == "a"


def test_archive_filter_prunes_folders(spark, buffered):
    done = run_export(buffered, DAY)
    plan = export.read_archive(spark, done.path).where((F.col("stream") == FEED) & (F.col("timepoint") > 5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stream" in plan and "PushedFilters" in plan


def test_files_with_other_columns(spark):
    one, two = work_path(spark, "one"), work_path(spark, "two")
    spark.range(2).select("id", F.lit("x").alias("extra")).write.parquet(one)
    spark.range(2).select("id", F.lit("y").alias("name")).write.parquet(two)
    got = export.register_lenient(spark, [one, two], "id bigint, name string")
    assert sorted((r.id, str(r.name)) for r in got.collect()) == [(0, "None"), (0, "y"), (1, "None"), (1, "y")]
    empty = export.empty_like(got)
    assert empty.count() == 0 and empty.columns == ["id", "name"]


LINE = '{"resource_kind":"k","resource_id":"1","resource_uri":"/x","event":{"timepoint":%d,"published_at":"2024-01-01T00:00:00","type":"changed"},"data":{}}'


def lines(spark, texts):
    rows = [(FEED, t, dt.datetime(2024, 1, 1)) for t in texts]
    return spark.createDataFrame(rows, "stream_path string, line string, received timestamp_ntz")


def test_ingest_resumes_from_its_checkpoint(spark):
    folder, out, checkpoint = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "checkpoint")
    first = lines(spark, [LINE % 1, "", "broken"])
    first.write.parquet(folder)
    source = tables.source(spark, folder, first.schema)
    jobs.ingest(source, out, spark, checkpoint)
    jobs.ingest(source, out, spark, checkpoint)
    assert spark.read.parquet(out).count() == 2
    lines(spark, [LINE % 2]).write.mode("append").parquet(folder)
    jobs.ingest(source, out, spark, checkpoint)
    got = spark.read.parquet(out)
    assert sorted(r.timepoint for r in got.where("reject_reason is null").collect()) == [1, 2]


def test_replayed_batch_changes_nothing(spark):
    done = jobs.FanOut(spark)
    batch = spark.createDataFrame([(FEED, "k", "12345678", '{"a":1}', LINE % 1)], "stream_path string, resource_kind string, company_number string, data string, line string")
    for batch_id in (0, 1, 1):
        done.save(batch, batch_id)
    assert done.topics.read(spark).count() == 2
    assert [r.company_number for r in done.pool.last(spark).collect()] == ["12345678"]
    assert {(r.path, r.nodes) for r in done.schema_counts().collect()} == {("$", 2), ("$.a", 2)}
    topic = json.loads(done.topics.read(spark).first().value)
    assert list(topic)[0] == "streamPath" and topic["streamPath"] == FEED and topic["event"]["timepoint"] == 1


def test_watermark_dedup(spark):
    rows = [(FEED, 1, dt.datetime(2024, 1, 1)), (FEED, 1, dt.datetime(2024, 1, 1, 0, 1)), (FEED, 2, dt.datetime(2024, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "stream_path string, timepoint bigint, received timestamp_ntz")
    folder, out = work_path(spark, "in"), work_path(spark, "out")
    df.repartition(3).write.parquet(folder)
    stream = jobs.dedup_within(tables.source(spark, folder, df.schema), "1 hour")
    tables.drain(stream.writeStream.format("parquet").option("path", out), spark, "dedup")
    assert sorted(r.timepoint for r in spark.read.parquet(out).collect()) == [1, 2]


@pytest.fixture(scope="module")
def service(spark):
    events = spark.createDataFrame(
        [(FEED, i, "k", dt.datetime(2024, 1, 1 + i // 5), f"{i % 4:08d}", json.dumps({"n": i}), i, json.dumps({"a": i})) for i in range(10)],
        "stream_path string, timepoint bigint, resource_kind string, received timestamp_ntz, company_number string, line string, event_id bigint, data string",
    )
    responses = spark.createDataFrame([(i, FEED, "response_started", '{"h":"v"}' if i % 2 else None) for i in range(30)], "seq bigint, stream_path string, type string, headers string")
    visits = spark.createDataFrame([(str(i % 3), dt.date(2024, 1, 1 + i % 2)) for i in range(12)], "ip string, day date")
    connections = spark.createDataFrame([(0, 1), (1, 1), (2, -1)], "event_id bigint, delta int")
    return FeedService(events, events, responses, visits, connections, schema.profile(schema.type_counts(events)))


def test_service_reads(service):
    assert [r.timepoint for r in service.download_history(FEED, 3).orderBy("rank").collect()] == [9, 8, 7]
    assert service.download_history(FEED).count() == 10
    assert json.loads(service.latest_sample_event(FEED).first().pretty) == {"n": 9}
    assert [(str(r.day), r.events) for r in service.stats(FEED).collect()] == [("2024-01-01", 5), ("2024-01-02", 5)]
    assert [(r.resource_kind, r.events) for r in service.resource_kinds(FEED).collect()] == [("k", 10)]
    assert service.random_company_numbers(100).count() == 4
    assert service.random_company_numbers(2, "s").collect() == service.random_company_numbers(2, "s").collect()
    newest = [json.loads(r.response) for r in service.recent_responses().collect()]
    assert len(newest) == 20 and newest[0]["headers"] == {"h": "v"} and "headers" not in newest[1]
    assert tuple(service.visitors(dt.date(2024, 1, 1)).first()) == (3, 3)
    assert service.visitors(dt.date(2030, 1, 1)).first().today == 0
    assert service.visitors_on(dt.date(2024, 1, 2)).first().visitors == 3
    health = {r.stream_path: r.healthy for r in service.health(F.lit("2024-01-02 00:00:59").cast("timestamp_ntz")).collect()}
    assert len(health) == 9 and health[FEED] and not health[OTHER]
    assert not service.health(F.lit("2024-01-02 00:01:00").cast("timestamp_ntz")).where("healthy").count()
    assert service.current_connections().first().connections == 1
    assert [r.resource_kind for r in service.all_resource_kinds().collect()] == ["k"]


def test_service_refuses(service):
    for call in (
        lambda: service.download_history("nothing"),
        lambda: service.download_history(FEED, 10_001),
        lambda: service.download_history(FEED, -5),
        lambda: service.random_company_numbers(0),
        lambda: service.random_company_numbers(101, maximum=100),
        lambda: service.schema("nothing"),
        lambda: service.visitors_on(dt.date(2023, 9, 1)),
        lambda: service.stats("nothing"),
    ):
        with pytest.raises(ValueError):
            call()


def test_second_window_of_a_day_adds_to_the_first(spark, buffered):
    path, rows = work_path(spark, "archive"), buffered.where("timepoint < 15")
    schema_text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in buffered.schema)
    store = Buffer(spark, schema_text, work_path(spark, "store"))
    store.append(rows)
    store.export(DAY, path)
    store.append(buffered.where("timepoint >= 15"))
    done = store.export(DAY, path)
    assert done.reconciled.where("not can_delete").count() == 0
    archive = [(r.stream, r.timepoint) for r in export.read_archive(spark, path).collect()]
    left = [(r.stream_path, r.timepoint) for r in store.read().collect()]
    assert sorted(archive + left) == sorted((r[0], r[1]) for r in buffer_rows())


def test_empty_kind_is_exported(spark):
    schema_text = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, event_data string"
    rows = spark.createDataFrame([("f", i, dt.datetime(2024, 1, 1 + i), "", "{}") for i in range(3)], schema_text)
    done = run_export(materialise(rows, "buffer"), DAY)
    assert [(r.resource_kind, r.can_delete) for r in done.reconciled.collect()] == [(export.NO_KIND, True)]
    assert done.remaining.count() == 1


def test_jobs_resume_with_their_tables(spark):
    folder, checkpoint = work_path(spark, "in"), work_path(spark, "checkpoint")
    make = lambda rows: spark.createDataFrame(rows, "stream_path string, timepoint bigint, arrival bigint")
    make([("f", 1, 1), ("f", 2, 2)]).coalesce(1).write.parquet(folder)
    source = tables.source(spark, folder, make([]).schema)
    jobs.dedup(source, ["stream_path", "timepoint"], ["arrival"], spark, checkpoint)
    make([("f", 2, 3), ("f", 3, 4)]).coalesce(1).write.mode("append").parquet(folder)
    got = jobs.dedup(source, ["stream_path", "timepoint"], ["arrival"], spark, checkpoint)
    assert sorted((r.timepoint, r.arrival) for r in got.collect()) == [(1, 1), (2, 2), (3, 4)]
