"""Export of the buffer to the partitioned archive, with reconciliation.

All feeds and kinds go in one job. The window is everything before the first position of the day that owns the
greatest position: days are compared by position because published dates may be out of order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regfeed import feeds as feed_names
from regfeed.functions.timeutil import utc_day
from regfeed.session import broadcast_if_small
from regfeed.sources import folders, part_files
from regfeed.sources.committed import Log, Version

NO_KIND = "__none__"
PARTITIONS = ("run", "stream", "resource_kind", "uploaded_day")
# An archive file holds events of at most so many bytes of JSON, and of at most so many records.
PART_BYTES = 25 * 1024 * 1024
RECORDS_PER_FILE = 1_000_000
# What one task writes, about: its rows are sorted and summed together.
BLOCK_BYTES = 1024**3
# Most parts of a block, about, of a feed and kind whose events have an eighth of a part at most: a file costs a task more than its bytes if
# there are few of them. Parts of such events are fuller than three quarters by more than the one that each block leaves unfilled.
BLOCK_PARTS = 256
# Most zones that positions are counted in, and the fewest positions of a zone as a power of two.
ZONES = 150_000
ZONE_BITS = 8


def published_day_summary(buffer: DataFrame) -> DataFrame:
    return buffer.groupBy("stream_path", utc_day(F.col("published_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.max("timepoint").alias("max_timepoint"), F.min("timepoint").alias("min_timepoint")
    )


def export_cutoff(summary: DataFrame) -> DataFrame:
    """First position that is not exported yet, per feed."""
    return summary.groupBy("stream_path").agg(F.max_by("min_timepoint", "max_timepoint").alias("cutoff"))


def cutoffs(buffer: DataFrame, feeds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per feed: of all feeds in the buffer, or of those named."""
    return export_cutoff(published_day_summary(buffer if feeds is None else feed_names.known_only(buffer, feeds)))


def eligible(buffer: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows before their feed's cutoff; ``cutoff`` has one row per feed."""
    return buffer.join(broadcast_if_small(cutoff), "stream_path").where(F.col("timepoint") < F.col("cutoff")).drop("cutoff")


def window_check(rows: DataFrame) -> DataFrame:
    """Size and span of the export window per feed, and whether it has no holes and no repeats."""
    return rows.groupBy("stream_path").agg(
        F.count(F.lit(1)).alias("events"), F.min("timepoint").alias("min_timepoint"), F.max("timepoint").alias("max_timepoint")
    ).withColumn("contiguous", F.col("events") == F.col("max_timepoint") - F.col("min_timepoint") + 1)


def with_kind(buffer: DataFrame) -> DataFrame:
    """Events without a kind, or with an empty one, keep a place of their own: a folder cannot be named after either."""
    return buffer.withColumn("resource_kind", F.when(F.col("resource_kind") != "", F.col("resource_kind")).otherwise(NO_KIND))


def kind_counts(rows: DataFrame) -> DataFrame:
    return with_kind(rows).groupBy("stream_path", "resource_kind").agg(F.count(F.lit(1)).alias("events"))


def window_kinds(rows: DataFrame) -> DataFrame:
    """Per feed and kind what is to be exported: rows, first and last position, and a digest of keys and texts.

    Windows, counts and the name of the run all follow from this one pass. The digest does not depend on the order of rows.
    """
    text = F.xxhash64("stream_path", "timepoint", "published_at", "event_data")
    return with_kind(rows).groupBy("stream_path", "resource_kind").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("timepoint").alias("min_timepoint"),
        F.max("timepoint").alias("max_timepoint"),
        F.bit_xor(text).alias("digest"),
    )


def windows(kinds: DataFrame) -> DataFrame:
    """``window_check`` from the sums per kind."""
    return kinds.groupBy("stream_path").agg(
        F.sum("events").alias("events"), F.min("min_timepoint").alias("min_timepoint"), F.max("max_timepoint").alias("max_timepoint")
    ).withColumn("contiguous", F.col("events") == F.col("max_timepoint") - F.col("min_timepoint") + 1)


def run_name(kinds: DataFrame, uploaded_day: dt.date) -> str | None:
    """Name of what is exported: the day and a digest of all rows, so only the same rows of the same day have the same name. None if nothing is."""
    each = F.xxhash64("stream_path", "resource_kind", "events", "min_timepoint", "max_timepoint", "digest")
    total = kinds.agg(F.bit_xor(each).alias("x"), F.sum("events").alias("n")).first()
    return f"{uploaded_day:%Y%m%d}-{total['n']}-{total['x'] & (1 << 64) - 1:016x}" if total["n"] else None


def _bytes() -> Column:
    return F.coalesce(F.octet_length("event_data"), F.lit(0)).cast("bigint")


def blocks(keyed: DataFrame, kinds: DataFrame, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> tuple[DataFrame, Column]:
    """``stream, resource_kind, _zone, _block``: zones of positions joined up to blocks of about ``block_bytes``, and the zone of a row.

    Zones are as wide as it takes to have no more than ``ZONES`` of them (and two for each feed and kind), whatever the
    size of the buffer, so the table may be broadcast. Blocks follow from the bytes counted in each zone: a feed that is busy in a few
    places is cut there. They are smaller if they would hold over ``BLOCK_PARTS`` small parts.
    """
    span = kinds.agg(F.sum(F.col("max_timepoint") - F.col("min_timepoint") + 1).alias("n")).first()["n"] or 0
    zone = F.shiftright("timepoint", max(ZONE_BITS, (int(span) // ZONES).bit_length()))
    sizes = keyed.groupBy("stream", "resource_kind", zone.alias("_zone")).agg(F.sum(_bytes()).alias("_bytes"), F.max(_bytes()).alias("_widest"))
    whole = Window.partitionBy("stream", "resource_kind")
    earlier = whole.orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_bytes").over(earlier), F.lit(0))
    narrow = F.max("_widest").over(whole) * 8 <= part_bytes
    each = F.when(narrow, min(block_bytes, part_bytes * BLOCK_PARTS)).otherwise(block_bytes)
    return sizes.select("stream", "resource_kind", "_zone", F.floor(start / each).alias("_block")), zone


def into_parts(keyed: DataFrame, kinds: DataFrame, part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows with ``part``: runs of neighbouring positions of a feed and kind, each of at most ``part_bytes`` of JSON.

    Texts are shuffled once, to blocks. Inside a block a running sum says in which step a position starts. A step is as much shorter than
    ``part_bytes`` as the block's widest position is wide, so that what starts in it ends before the part is full; but not shorter than three
    quarters: a position that begins there and reaches beyond the whole (it has over a quarter itself) is a part of its own. So a part is
    too large only if a single position is. All rows of one position share a part.
    """
    table, zone = blocks(keyed, kinds, block_bytes, part_bytes)
    placed = keyed.withColumn("_zone", zone).join(F.broadcast(table), ["stream", "resource_kind", "_zone"], "left")
    # A position that came after the zones were counted is written as well; the comparison afterwards tells of it.
    placed = placed.withColumn("_block", F.coalesce("_block", F.lit(-1))).withColumn("_bytes", _bytes())
    whole = Window.partitionBy("stream", "resource_kind", "_block")
    by_position = whole.orderBy("timepoint")
    end = F.sum("_bytes").over(by_position.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("_bytes").over(by_position.rangeBetween(Window.currentRow, Window.currentRow))
    summed = placed.withColumn("_end", end).withColumn("_own", own).withColumn("_widest", F.max("_own").over(whole))
    size = F.greatest(F.lit(max(1, part_bytes * 3 // 4)), F.lit(part_bytes) - F.col("_widest"))
    summed = summed.withColumn("_size", size).withColumn("_step", F.floor((F.col("_end") - F.col("_own")) / F.col("_size")))
    alone = (F.col("_end") - F.col("_step") * F.col("_size") > part_bytes).cast("int")
    part = F.format_string("b%d-p%d", "_block", F.col("_step") * 2 + alone)
    return summed.withColumn("part", part).drop("_zone", "_block", "_bytes", "_end", "_own", "_widest", "_size", "_step")


def write_archive(
    rows: DataFrame,
    path: str,
    run: str,
    uploaded_day: dt.date,
    records_per_file: int = RECORDS_PER_FILE,
    kinds: DataFrame | None = None,
    part_bytes: int = PART_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Write rows under run= / stream= / resource_kind= / uploaded_day= / part=, in position order. They are not visible before the run is logged.

    ``kinds`` is ``window_kinds`` of the rows, if it is known. Blocks spread one busy feed over many tasks, and the files of a feed and
    kind are apart in position. In a local or mounted file system a folder part= holds the files of a block; in others, where only Spark
    writes, each part has a folder.
    """
    folders_ = (*PARTITIONS[1:], "part")
    kinds = window_kinds(rows) if kinds is None else kinds
    keyed = with_kind(rows).withColumnRenamed("stream_path", "stream").withColumn("uploaded_day", F.lit(uploaded_day))
    parts = into_parts(keyed, kinds, part_bytes, block_bytes).sortWithinPartitions(*folders_, "timepoint")
    if part_files.can_write(parts, f"{path}/run={run}"):
        part_files.write(parts, f"{path}/run={run}", folders_[:-1], records_per_file)
    else:
        parts.write.mode("errorifexists").option("maxRecordsPerFile", records_per_file).partitionBy(*folders_).parquet(f"{path}/run={run}")


ARCHIVE_SCHEMA = (
    "timepoint bigint, published_at timestamp_ntz, event_data string, run string, stream string, resource_kind string, uploaded_day date"
)
MANIFEST_SCHEMA = "stream string, resource_kind string, file string, events bigint, min_timepoint bigint, max_timepoint bigint, difference bigint, matches boolean"
# What the log of an archive says of each feed and kind of a run, and of the buffer it came from.
RUN_SCHEMA = "source string, buffer_version bigint, stream_path string, resource_kind string, low bigint, high bigint"


def archive_log(spark: SparkSession, path: str) -> Log:
    """Runs of an archive. A version's kind is the name of what was exported, its run the attempt whose files hold it."""
    return Log(spark, f"{path}/_log", RUN_SCHEMA)


def visible_runs(spark: SparkSession, path: str) -> list[Version]:
    """One attempt for each name: a later attempt at the same rows replaces the one before it."""
    newest = {v.kind: v for v in archive_log(spark, path).versions()}
    return sorted(newest.values(), key=lambda v: v.number)


def read_archive(spark: SparkSession, path: str, schema: str | None = ARCHIVE_SCHEMA, run: str | None = None) -> DataFrame:
    """The visible runs of the archive (or one run) with partition columns from the path; filters on them skip whole folders."""
    runs = [run] if run else [v.run for v in visible_runs(spark, path)]
    # A run without rows has no folders.
    paths = [f"{path}/run={r}" for r in runs if any(n.startswith("stream=") for n in folders.names(spark, f"{path}/run={r}"))]
    if not paths:
        return spark.createDataFrame([], schema or ARCHIVE_SCHEMA)
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*paths).drop("part")


def unlisted_runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of attempts that failed or were replaced; nothing reads them any more."""
    listed = {f"run={v.run}" for v in visible_runs(spark, path)}
    return [n for n in folders.names(spark, path) if n.startswith("run=") and n not in listed]


def _column_names(spark: SparkSession, schema: str) -> list[str]:
    return spark.createDataFrame([], schema).columns


def register_lenient(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Existing files under a table schema: missing columns are NULL, extra and folder columns are left out."""
    table = spark.read.schema(schema)
    return table.parquet(*paths).select(*_column_names(spark, schema))


def empty_like(sample: DataFrame) -> DataFrame:
    """An empty table with the columns of the sample."""
    return sample.sparkSession.createDataFrame([], sample.schema)


def without_partitions(archive: DataFrame) -> DataFrame:
    return archive.drop(*PARTITIONS)


def manifest(archive: DataFrame) -> DataFrame:
    """One row per archive file: rows, first and last position, and whether the file has no holes."""
    files = archive.groupBy("stream", "resource_kind", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("events"), F.min("timepoint").alias("min_timepoint"), F.max("timepoint").alias("max_timepoint")
    )
    return files.withColumn("difference", F.col("max_timepoint") - F.col("min_timepoint")).withColumn(
        "matches", F.col("difference") + 1 == F.col("events")
    )


def part_sizes(archive: DataFrame) -> DataFrame:
    """One row per archive file: its events, positions and bytes of JSON."""
    return archive.groupBy("stream", "resource_kind", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("timepoint").alias("min_timepoint"),
        F.max("timepoint").alias("max_timepoint"),
        F.sum(_bytes()).alias("bytes"),
    )


def overlapping_parts(files: DataFrame) -> DataFrame:
    """Files of a feed and kind that reach into the next one, by position. One row per file, so windows are small."""
    by_start = Window.partitionBy("stream", "resource_kind").orderBy("min_timepoint", "max_timepoint")
    next_start = F.lead("min_timepoint").over(by_start)
    return files.withColumn("next_min", next_start).where(F.col("next_min") <= F.col("max_timepoint"))


def settled_ranges(reconciled: DataFrame, kinds: DataFrame) -> DataFrame:
    """Positions that may be deleted, per feed and kind as the buffer has it: NULL and empty kinds were exported under one name."""
    of = kinds.join(broadcast_if_small(reconciled.where("can_delete").select("stream_path", "resource_kind")), ["stream_path", "resource_kind"], "left_semi")
    named = F.when(F.col("resource_kind") == NO_KIND, F.array(F.lit(None).cast("string"), F.lit(""), F.lit(NO_KIND))).otherwise(F.array("resource_kind"))
    return of.select("stream_path", F.explode(named).alias("resource_kind"), F.col("min_timepoint").alias("low"), F.col("max_timepoint").alias("high"))


def reconcile(files: DataFrame, buffered: DataFrame) -> DataFrame:
    """Exported against buffered rows per feed and kind; only equal ones may be deleted."""
    exported = files.groupBy(F.col("stream").alias("stream_path"), "resource_kind").agg(F.sum("events").alias("exported"))
    both = exported.join(buffered.withColumnRenamed("events", "buffered"), ["stream_path", "resource_kind"], "full")
    counts = both.select(
        "stream_path",
        "resource_kind",
        F.coalesce("exported", F.lit(0)).cast("bigint").alias("exported"),
        F.coalesce("buffered", F.lit(0)).cast("bigint").alias("buffered"),
    )
    return counts.withColumn("can_delete", F.col("exported") == F.col("buffered"))


def remaining(buffer: DataFrame, cutoff: DataFrame, reconciled: DataFrame) -> DataFrame:
    """The buffer after export: rows past the cutoff, and rows of kinds whose counts differed."""
    settled = broadcast_if_small(reconciled.where("can_delete").select("stream_path", "resource_kind", F.lit(True).alias("_settled")))
    marked = with_kind(buffer).join(broadcast_if_small(cutoff), "stream_path", "left").join(settled, ["stream_path", "resource_kind"], "left")
    gone = F.coalesce(F.col("timepoint") < F.col("cutoff"), F.lit(False)) & F.coalesce("_settled", F.lit(False))
    return marked.where(~gone).drop("cutoff", "_settled")
