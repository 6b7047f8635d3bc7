"""Archive parts by bytes: bounds, order and edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from regfeed.operators import export
from regfeed.session import work_path

DAY = dt.date(2024, 2, 1)
SCHEMA = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, event_data string"


def _files(spark, rows, part_bytes, block_bytes):
    path = work_path(spark, "archive")
    export.write_archive(spark.createDataFrame(rows, SCHEMA), path, "r", DAY, part_bytes=part_bytes, block_bytes=block_bytes)
    archive = export.read_archive(spark, path, run="r")
    return archive, export.part_sizes(archive)


def test_parts_stay_under_the_bound(spark):
    draw = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    # A dense feed, one with far positions, one with long records, NULL texts and repeated positions.
    rows = [("dense", k, at, "a" if k % 3 else "b", "x" * draw.randint(1, 90)) for k in range(4_000)]
    rows += [("far", k * 10_007, at, None, "é" * draw.randint(1, 90)) for k in range(500)]
    rows += [("long", k, at, "a", "y" * draw.choice((10, 400, 990, 1_000, 2_500))) for k in range(300)]
    rows += [("odd", k // 40, at, "", None if k % 2 else "z" * 30) for k in range(400)]
    archive, sizes = _files(spark, rows, 1_000, 20_000)
    got = sorted((r.stream, r.timepoint, r.resource_kind, r.event_data or "") for r in archive.collect())
    assert got == sorted((s, t, kind or "__none__", text or "") for s, t, _, kind, text in rows)
    files = sizes.collect()
    assert export.overlapping_parts(sizes).isEmpty()
    assert all(f.bytes <= 1_000 or f.min_timepoint == f.max_timepoint for f in files)
    whole = sum(f.bytes for f in files if f.stream == "dense")
    assert whole / 1_000 <= sum(f.stream == "dense" for f in files) <= whole / 650 + 60
    assert any("part=b1-" in f.file for f in files if f.stream == "dense")


def test_zones_stay_few(spark, monkeypatch):
    monkeypatch.setattr(export, "ZONES", 50)
    rows = spark.range(20_000).select(
        F.lit("s").alias("stream"), F.lit("k").alias("resource_kind"), (F.col("id") * 1_000).alias("timepoint"), F.lit("x" * 10).alias("event_data")
    )
    kinds = rows.groupBy("stream", "resource_kind").agg(F.min("timepoint").alias("min_timepoint"), F.max("timepoint").alias("max_timepoint"))
    table, _ = export.blocks(rows, kinds, 10_000)
    assert 20 <= table.count() <= 52
    assert table.select("_block").distinct().count() >= 15


def test_texts_move_once(spark):
    rows = spark.createDataFrame([("s", 1, None, "k", "x")], SCHEMA)
    kinds = export.window_kinds(rows)
    plan = export.into_parts(rows.withColumnRenamed("stream_path", "stream"), kinds)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_block" in line]
    assert len(moved) == 1 and "BroadcastHashJoin" in plan and "rangepartitioning" not in plan


def test_nothing_to_write(spark):
    path = work_path(spark, "archive")
    export.write_archive(spark.createDataFrame([], SCHEMA), path, "r", DAY)
    assert export.read_archive(spark, path, run="r").count() == 0
