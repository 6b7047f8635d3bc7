"""Archive parts as files of one folder: names, cuts, other file systems, reading."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from regfeed.operators import export
from regfeed.session import many_files, work_path
from regfeed.sources import folders, part_files

DAY = dt.date(2024, 2, 1)
SCHEMA = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, event_data string"
AT = dt.datetime(2024, 1, 1, 2, 3, 4, 567_891)


def _written(spark, rows, **options):
    path = work_path(spark, "archive")
    export.write_archive(spark.createDataFrame(rows, SCHEMA), path, "r", DAY, **options)
    archive = export.read_archive(spark, path, run="r")
    got = [(r.stream, r.timepoint, r.published_at, r.resource_kind, r.event_data) for r in archive.select("*").collect()]
    return path, archive, sorted(got, key=repr)


def _as_read(rows):
    return sorted(((s, t, at, kind or "__none__", text) for s, t, at, kind, text in rows), key=repr)


def _texts(n, widest=90):
    draw = random.Random(5)
    return [("s", k, AT if k % 5 else None, "ab"[k % 2], None if k % 31 == 0 else "x" * draw.randint(1, widest)) for k in range(n)]


def test_a_block_has_one_folder(spark):
    """Each part had a folder of its own, and the reader listed them all."""
    rows = _texts(6_000)
    path, archive, got = _written(spark, rows, part_bytes=1_000)
    assert got == _as_read(rows)
    files = [r.file for r in export.part_sizes(archive).collect()]
    assert len(files) > 200 and len({os.path.dirname(f) for f in files}) <= 4
    assert folders.names(spark, f"{path}/run=r") == ["_SUCCESS", "stream=s"]


def test_small_parts_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(export, "BLOCK_PARTS", 20)
    _, archive, _ = _written(spark, _texts(6_000), part_bytes=1_000)
    sizes = export.part_sizes(archive)
    assert len({os.path.dirname(f.file) for f in sizes.collect()}) > 6
    assert export.overlapping_parts(sizes).isEmpty() and sizes.where("bytes > 1000").isEmpty()


def test_parts_of_wide_events_stay_in_one_block(spark, monkeypatch):
    """Each more block leaves a part unfilled, which only fuller parts make up for."""
    monkeypatch.setattr(export, "BLOCK_PARTS", 20)
    _, archive, _ = _written(spark, [("s", k, AT, "a", "x" * 250) for k in range(800)], part_bytes=1_000)
    files = [r.file for r in export.part_sizes(archive).collect()]
    assert len(files) <= 800 * 250 // 750 + 1 and len({os.path.dirname(f) for f in files}) == 1


def test_narrow_positions_fill_parts(spark):
    """A part was closed at three quarters, however narrow its positions are."""
    _, archive, _ = _written(spark, [("s", k, AT, "a", "x" * 10) for k in range(2_000)], part_bytes=1_000)
    assert export.part_sizes(archive).count() <= 22


def test_names_as_spark_writes_them(spark):
    values = [*map(chr, range(1, 300)), "", "a/b=c%2F d", "^{[]}", "é😀", None]
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    assert [part_files.folder("k", v) for v in values] == [named("k", v) for v in values]
    rows = [(stream, k, AT, kind, "{}") for k, (stream, kind) in enumerate([("a/b", "x=y"), ("c%20d", "é: ü"), ("a b", None), ("p", ""), ("p", "2024-01-01")])]
    assert _written(spark, rows)[2] == _as_read(rows)


@pytest.mark.parametrize("local", [True, False])
def test_every_row_once_in_files_of_few(spark, monkeypatch, local):
    if not local:
        monkeypatch.setattr(folders, "file_path", lambda spark, path: None)
    rows = _texts(700) + [("s", 3, AT, "a", "again"), ("s", 3, AT, "a", "again"), ("t", 1, AT, None, "y" * 5_000)]
    _, archive, got = _written(spark, rows, part_bytes=1_000, records_per_file=7)
    assert got == _as_read(rows)
    assert max(r.events for r in export.part_sizes(archive).collect()) == 7


def test_both_writers_cut_alike(spark, monkeypatch):
    rows = _texts(900, 600)
    parts = lambda archive: sorted((r.stream, r.resource_kind, r.min_timepoint, r.max_timepoint, r.bytes) for r in export.part_sizes(archive).collect())
    here = parts(_written(spark, rows, part_bytes=1_000)[1])
    monkeypatch.setattr(folders, "file_path", lambda spark, path: None)
    assert here == parts(_written(spark, rows, part_bytes=1_000)[1])


def test_other_columns_and_types(spark):
    path = work_path(spark, "archive")
    rows = spark.createDataFrame(_texts(40), SCHEMA).withColumn("n", F.lit(2.5).cast("decimal(9,2)")).withColumn("day", F.lit(DAY))
    export.write_archive(rows, path, "plain", DAY)
    export.write_archive(rows.withColumn("tags", F.array("stream_path")), path, "nested", DAY)
    got = export.read_archive(spark, path, None, run="plain")
    assert dict(got.dtypes)["published_at"] == "timestamp_ntz" and dict(got.dtypes)["n"] == "decimal(9,2)"
    assert got.where("n = 2.5 and day = date '2024-02-01'").count() == 40
    assert export.read_archive(spark, path, None, run="nested").where("tags[0] = 's'").count() == 40


def test_a_path_is_written_once(spark):
    path, _, got = _written(spark, _texts(20))
    with pytest.raises(FileExistsError):
        export.write_archive(spark.createDataFrame(_texts(5), SCHEMA), path, "r", DAY)
    assert export.read_archive(spark, path, run="r").count() == len(got)


def test_a_failed_write_leaves_nothing_to_read(spark):
    path = work_path(spark, "archive")
    rows = spark.createDataFrame(_texts(300), SCHEMA).withColumn("event_data", F.when(F.col("timepoint") == 299, F.raise_error(F.lit("broken"))).otherwise(F.col("event_data")))
    kinds = export.window_kinds(spark.createDataFrame(_texts(300), SCHEMA))
    with pytest.raises(Exception, match="broken"):
        export.write_archive(rows, path, "r", DAY, kinds=kinds)
    assert folders.names(spark, f"{path}/run=r") == []


def test_many_files_take_few_tasks(spark):
    path = work_path(spark, "files")
    spark.range(640).repartition(64).write.parquet(path)
    key, size = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before, most = spark.conf.get(key), spark.conf.get(size)
    spark.conf.set(size, "16m")
    try:
        with pytest.raises(KeyError), many_files(spark):
            assert spark.read.parquet(path).rdd.getNumPartitions() <= 8
            raise KeyError
        assert spark.conf.get(key) == before and spark.read.parquet(path).rdd.getNumPartitions() >= 16
    finally:
        spark.conf.set(size, most)
