"""The committed table: overlapping appends, ranges, crashes, what is read and what is written; export over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from regfeed.operators import export
from regfeed.plans.nightly import Buffer, run_export
from regfeed.session import work_path
from regfeed.sources import committed, folders
from regfeed.sources.committed import CommittedTable

SCHEMA = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, event_data string"
RANGE = "stream_path string, resource_kind string, low bigint, high bigint"
DAY = dt.date(2024, 2, 1)


def rows(spark, positions, tag="a", feed="f", kind="k"):
    at = lambda p: dt.datetime(2024, 1, 1 + max(p or 0, 0) // 10)
    return spark.createDataFrame([(feed, p, at(p), kind, f"{tag}{p}") for p in positions], SCHEMA)


def seen(table):
    return sorted((str(r.stream_path), str(r.timepoint), r.event_data) for r in table.read().collect())


@pytest.fixture
def table(spark):
    return CommittedTable(spark, SCHEMA, work_path(spark, "table"))


def test_first_writer_wins_over_appends(spark, table):
    table.append(rows(spark, [1, 2, 2]))
    table.append(rows(spark, [2, 3], "b"))
    assert seen(table) == [("f", "1", "a1"), ("f", "2", "a2"), ("f", "3", "b3")]
    # NULL feeds and positions are keys like any other.
    table.append(rows(spark, [None, 7], feed=None, kind=None))
    table.append(rows(spark, [7, None], "c", feed=None, kind=None))
    assert [r for r in seen(table) if r[0] == "None"] == [("None", "7", "a7"), ("None", "None", "aNone")]
    assert [r.timepoint for r in table.read(1).orderBy("timepoint").collect()] == [1, 2]


def test_a_run_counts_once_and_only_when_committed(spark, table):
    table.append(rows(spark, [1]))
    staged = table.stage(rows(spark, [2]), run="second")
    assert [r[1] for r in seen(table)] == ["1"]
    # The job ended here; another one goes on, and the rest of the first is of no use any more.
    table.append(rows(spark, [3]))
    with pytest.raises(RuntimeError):
        table.commit(staged)
    table.append(rows(spark, [2], "b"), run="second")
    version = table.append(rows(spark, [4], "c"), run="second")
    assert version == table.version() == 3 and [r[2] for r in seen(table)] == ["a1", "b2", "a3"]


def test_unfinished_version_is_replaced(spark, table):
    table.append(rows(spark, [1]))
    # A version without its marker: the job ended while it wrote it.
    spark.createDataFrame([], committed.CHANGES).write.parquet(f"{table.log.path}/version=2.append.gone")
    folders.remove(spark, f"{table.log.path}/version=2.append.gone/_SUCCESS")
    assert table.version() == 1
    table.append(rows(spark, [2]))
    assert table.version() == 2 and len(seen(table)) == 2


def test_ranges_hold_for_older_rows_only(spark, table):
    table.append(rows(spark, range(10)))
    table.append(rows(spark, range(10, 20), kind="other"))
    before = table.version()
    table.append(rows(spark, [30]))
    cut = spark.createDataFrame([("f", "k", 3, 40)], RANGE)
    table.delete(cut, as_of=before)
    assert [r[1] for r in seen(table)] == sorted(map(str, [0, 1, 2, *range(10, 20), 30]))
    table.append(rows(spark, [5], "again"))
    want = seen(table)
    assert ("f", "5", "again5") in want
    table.compact()
    assert seen(table) == want and table.cuts() is None and table.zones().select("file").distinct().count() == 1
    # Files of the runs before, and what crashed attempts left.
    table.stage(rows(spark, [99]), run="crashed")
    assert len(table.vacuum()) == 5 and seen(table) == want
    table.delete(spark.createDataFrame([("f", "k", 0, 100), ("f", "other", 0, 100)], RANGE))
    assert seen(table) == [] and table.zones().count() == 0


def test_random_changes_against_a_dictionary(spark, table, monkeypatch):
    monkeypatch.setattr(committed, "SNAPSHOT_EVERY", 4)
    rnd, want = random.Random(5), {}
    for step in range(9):
        low = rnd.randrange(40)
        if step % 4 == 3:
            table.delete(spark.createDataFrame([("f", "k", low, low + 15)], RANGE))
            want = {p: v for p, v in want.items() if not low <= p <= low + 15}
        elif step == 5:
            table.compact()
        else:
            batch = [rnd.randrange(low, low + 25) for _ in range(12)]
            table.append(rows(spark, batch, f"s{step}-"))
            for p in batch:
                want.setdefault(p, f"s{step}-{p}")
    assert seen(table) == sorted(("f", str(p), v) for p, v in want.items())


def test_a_batch_reads_only_files_that_may_hold_its_keys(spark, table, monkeypatch):
    """Files read stay constant while the table grows, and an append writes its own rows only."""
    monkeypatch.setattr(committed, "SMALL_FILE_ROWS", 0)
    read = []
    real = table.may_hold
    table.may_hold = lambda *a: (read.append(real(*a)), read[-1])[1]
    for k in range(8):
        before = set(folders.names(spark, f"{table.path}/data"))
        table.append(rows(spark, range(20 * k, 20 * k + 22, 2)))
        new = set(folders.names(spark, f"{table.path}/data")) - before
        assert len(new) == 1
    assert [len(f) for f in read] == [0] + [1] * 7
    # Odd positions lie in the zones of all files, but the filters know that none holds them.
    table.append(rows(spark, range(1, 150, 2)))
    assert len(read[-1]) <= 1
    assert table.read().count() == 8 * 11 - 7 + 75


def test_filters_never_miss_a_key(spark):
    keys = spark.range(5_000).select(F.lit("f").alias("stream_path"), F.col("id").alias("timepoint"))
    bits = keys.select(committed.bloom_bits("stream_path", "timepoint").alias("b"), committed.bloom_word("stream_path", "timepoint").alias("w"))
    got = bits.select(F.bit_count("b").alias("n"), "w").collect()
    assert all(1 <= r.n <= committed.BITS and 0 <= r.w < committed.WORDS for r in got)
    assert sum(r.n for r in got) > 3.8 * len(got) and len({r.w for r in got}) > 4_800


def archived(spark, path):
    return sorted((r.timepoint, r.event_data) for r in export.read_archive(spark, path).collect())


def test_position_that_comes_again_takes_nothing_away(spark):
    store, path = Buffer(spark, SCHEMA, work_path(spark, "buffer")), work_path(spark, "archive")
    store.append(rows(spark, range(15)))
    store.export(DAY, path)
    store.append(rows(spark, [0], "again"))
    done = store.export(DAY, path)
    assert archived(spark, path) == sorted([(p, f"a{p}") for p in range(10)] + [(0, "again0")])
    assert done.visible and [r.timepoint for r in store.read().orderBy("timepoint").collect()] == list(range(10, 15))


def test_crash_between_archive_and_buffer(spark):
    """The archive lists a run, the buffer has not deleted it: nothing is exported twice, nothing that came later is lost."""
    store, path = Buffer(spark, SCHEMA, work_path(spark, "buffer")), work_path(spark, "archive")
    store.append(rows(spark, range(15)))
    version = store.table.version()
    run_export(store.table.read(version), DAY, path, source=store.path, buffer_version=version)
    store.append(rows(spark, range(15, 35)))
    done = store.export(DAY, path)
    assert done.visible and archived(spark, path) == sorted((p, f"a{p}") for p in range(30))
    assert [r.timepoint for r in store.read().orderBy("timepoint").collect()] == list(range(30, 35))


def test_runs_are_seen_whole_or_not_at_all(spark):
    buffer, path = rows(spark, range(25)), work_path(spark, "archive")
    window = buffer.where("timepoint < 20")
    # An attempt that ended before its entry.
    export.write_archive(window, path, "attempt", DAY)
    assert archived(spark, path) == []
    first, again = run_export(buffer, DAY, path), run_export(buffer, DAY, path)
    assert len(archived(spark, path)) == 20 and len(export.visible_runs(spark, path)) == 1
    assert sorted(export.unlisted_runs(spark, path)) == sorted(f"run={r}" for r in ("attempt", first.attempt))
    assert again.windows.first().contiguous
    store = Buffer(spark, SCHEMA, work_path(spark, "buffer"))
    store.tidy(path)
    assert export.unlisted_runs(spark, path) == [] and len(archived(spark, path)) == 20
    nothing = run_export(buffer.limit(0), DAY, path)
    assert not nothing.visible and len(archived(spark, path)) == 20
