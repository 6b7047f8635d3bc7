"""The export job from start to end, and the buffer it empties."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.operators import export
from regfeed.session import many_files, materialise, work_path
from regfeed.sources import folders
from regfeed.sources.committed import CommittedTable


@dataclass
class ExportResult:
    """What an export left behind: the archive, its files, the comparison, and the rows still in the buffer.

    ``windows`` tells for each feed what was to be exported, and whether its positions were contiguous. ``attempt`` names the
    run's folder. ``visible`` is whether the archive lists it: only if there are rows, and the files hold as many of every kind as they should.
    """

    path: str
    attempt: str
    visible: bool
    cutoff: DataFrame
    windows: DataFrame
    kinds: DataFrame
    files: DataFrame
    reconciled: DataFrame
    remaining: DataFrame


def run_export(
    buffer: DataFrame,
    uploaded_day: dt.date,
    path: str | None = None,
    feeds: tuple[str, ...] | None = None,
    records_per_file: int = export.RECORDS_PER_FILE,
    part_bytes: int = export.PART_BYTES,
    block_bytes: int = export.BLOCK_BYTES,
    source: str | None = None,
    buffer_version: int | None = None,
) -> ExportResult:
    """Export every feed (or those named) and kind up to its cutoff, then compare the files with what was to be exported.

    The cutoff is stored first, so the write and the comparison use the same window even if the buffer grows meanwhile.
    Counts come from the files of this run, never from the plan that wrote them. Files become visible all at once, by one entry in the
    archive's log after the comparison. The same rows exported again on the same day replace themselves; any other rows are added,
    so a position that comes again after its export takes nothing away.
    """
    spark = buffer.sparkSession
    path = path or work_path(spark, "archive")
    cutoff = materialise(export.cutoffs(buffer, feeds), "cutoff")
    window = export.eligible(buffer, cutoff)
    kinds = materialise(export.window_kinds(window), "kinds")
    name, attempt = export.run_name(kinds, uploaded_day), uuid.uuid4().hex
    if name is None:
        files = spark.createDataFrame([], export.MANIFEST_SCHEMA)
    else:
        export.write_archive(window, path, attempt, uploaded_day, records_per_file, kinds, part_bytes, block_bytes)
        with many_files(spark):
            files = materialise(export.manifest(export.read_archive(spark, path, run=attempt)), "manifest")
    reconciled = materialise(export.reconcile(files, kinds.select("stream_path", "resource_kind", "events")), "reconciled")
    visible = name is not None and reconciled.where("not can_delete").isEmpty()
    if visible:
        log = export.archive_log(spark, path)
        origin = [F.lit(source).cast("string").alias("source"), F.lit(buffer_version).cast("bigint").alias("buffer_version")]
        entry = export.settled_ranges(reconciled, kinds).select(*origin, "stream_path", "resource_kind", "low", "high")
        log.write(entry, name, attempt, max([0, *[v.number for v in log.versions()]]))
    remaining = export.remaining(buffer, cutoff, reconciled if visible else reconciled.where("false"))
    return ExportResult(path, attempt, visible, cutoff, export.windows(kinds), kinds, files, reconciled, remaining)


class Buffer:
    """Received events that are not exported yet: one row for each feed and position, the first to arrive.

    Export is two commits: the archive lists the run, then the buffer deletes its positions as of the version that was exported. If the
    job ends between them, the next append or export finds the listed run and deletes its positions first, so no row is exported twice
    and none that came later is lost.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str):
        self.spark, self.path = spark, path
        self.table = CommittedTable(spark, schema, path)

    def read(self) -> DataFrame:
        return self.table.read()

    def append(self, rows: DataFrame, order: tuple[str, ...] = ("published_at", "resource_kind", "event_data"), run: str | None = None) -> None:
        """Add rows; of those with one key the first by ``order`` stays, and one that the buffer holds stays as it is."""
        self.table.append(rows, order, run)

    def settle(self, path: str) -> None:
        """Delete what the archive lists as exported from this buffer and is still here."""
        log = export.archive_log(self.spark, path)
        done = self.table.runs()
        for version in [v for v in log.versions() if v.run not in done]:
            entry = log.read([version]).where(F.col("source") == self.path)
            first = entry.select("buffer_version").first()
            if first:
                self.table.delete(entry, version.run, first.buffer_version)

    def export(self, uploaded_day: dt.date, path: str, **options) -> ExportResult:
        """Export, then delete what the archive has."""
        self.settle(path)
        version = self.table.version()
        done = run_export(self.table.read(version), uploaded_day, path, source=self.path, buffer_version=version, **options)
        if done.visible:
            self.table.delete(export.settled_ranges(done.reconciled, done.kinds), done.attempt, version)
        return done

    def tidy(self, path: str | None = None) -> None:
        """Join small files up and delete what nothing names: of the buffer, and of an archive if one is given."""
        self.table.compact()
        self.table.vacuum()
        for name in export.unlisted_runs(self.spark, path) if path else []:
            folders.remove(self.spark, f"{path}/{name}")
