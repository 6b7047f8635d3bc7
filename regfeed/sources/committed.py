"""A stored table of events whose every change is one commit.

Rows lie in Parquet files under ``data/run=<id>``. What is valid is told by the log alone: a version is a small table of changes, zones of
files that came or went and ranges of positions that were deleted. It counts once Spark has put its ``_SUCCESS`` beside it, so a job
that ends between writing rows and writing its version has changed nothing. A run that a version names is not applied again, which makes a
repeated micro-batch harmless.

* **Append** keeps the first row of each key and leaves out keys that the table holds. It writes its own rows and nothing else.
  Only files whose zone (feed, kind, first and last position) meets the batch are considered, and of the large ones only those whose
  Bloom filter knows one of its keys are read. Small files have no filter: it would be as long as their keys.
* **Delete** adds ranges of positions per feed and kind. A range holds for files that were there before it, so a position that
  arrives again later is a new row.
* **Compact** joins small files up and applies the ranges; **vacuum** deletes files that no version names.

One job at a time may change a table; any number may read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regfeed.operators.buffer import KEY, first_of_each
from regfeed.session import broadcast_if_small, materialise
from regfeed.sources import folders

# Changes of a version: a zone of a file that came ("add") or went ("drop"), or a deleted range ("cut"). ``since`` is the version of a
# zone, and for a range the first version it does not hold for.
CHANGES = "action string, run string, file string, stream_path string, resource_kind string, low bigint, high bigint, rows bigint, since bigint"
INDEX = "file string, stream_path string, word bigint, bits bigint"
# Versions after which the log is written whole, so that a reader folds no more than that many.
SNAPSHOT_EVERY = 20
# Rows of a file at most, and 64-bit words of its filter; a key sets some bits of one word. In a full file about 1 key in 50 that is
# not there is taken for one that might be, in smaller ones fewer; words without bits are not stored.
FILE_ROWS, WORDS, BITS = 1 << 20, 1 << 17, 4
# Rows up to which a file is small, and an append is one file without a filter.
SMALL_FILE_ROWS = 100_000
# Feeds whose spans a filter names; a batch with more is one span over all feeds.
MANY_FEEDS = 100


@dataclass(frozen=True)
class Version:
    number: int
    kind: str
    run: str

    @property
    def folder(self) -> str:
        return f"version={self.number}.{self.kind}.{self.run}"


class Log:
    """Numbered versions in a folder; each is a Parquet table whose folder's name tells its number, kind and run."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def versions(self) -> list[Version]:
        found = []
        for name in folders.names(self.spark, self.path):
            if name.startswith("version="):
                number, kind, run = name.removeprefix("version=").split(".", 2)
                found.append(Version(int(number), kind, run))
        found.sort(key=lambda v: v.number)
        # A version with another after it is finished; the last one may be what an ended job left.
        while found and not folders.exists(self.spark, f"{self.path}/{found[-1].folder}/_SUCCESS"):
            found.pop()
        return found

    def read(self, versions: Sequence[Version]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{v.folder}" for v in versions])

    def write(self, rows: DataFrame, kind: str, run: str, after: int) -> Version:
        """The version after number ``after``. Unfinished folders of that number, left by a job that ended, are removed first."""
        version = Version(after + 1, kind, run)
        for name in folders.names(self.spark, self.path):
            if name.startswith(f"version={version.number}."):
                folders.remove(self.spark, f"{self.path}/{name}")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/{version.folder}")
        return version


def bloom_word(*key: str) -> Column:
    """The word of a file's filter that a key belongs to: all its bits lie there."""
    return F.pmod(F.xxhash64(*key), F.lit(WORDS))


def bloom_bits(*key: str) -> Column:
    """The bits a key sets in its word: six bits of a second hash choose one of 64."""
    seed = F.xxhash64(F.lit("bits"), *key)
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        place = F.shiftrightunsigned(seed, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return out


@dataclass
class Staged:
    """Rows that are written but not valid yet."""

    run: str
    after: int
    zones: DataFrame | None


class CommittedTable:
    """``schema`` has the columns of ``key`` (feed and position) and may have ``resource_kind``; all may be NULL in a row.

    A NULL feed or position is a key like any other.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str, key: Sequence[str] = KEY):
        self.spark, self.schema, self.path, self.key = spark, schema, path.rstrip("/"), tuple(key)
        self.feed, self.position = self.key
        self.columns = spark.createDataFrame([], schema).columns
        self.kind = F.col("resource_kind") if "resource_kind" in self.columns else F.lit(None).cast("string")
        self.log = Log(spark, f"{self.path}/log", CHANGES)
        self.whole = Log(spark, f"{self.path}/whole", CHANGES)

    # --- what is valid --------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        return max([0, *[v.number for v in self.log.versions()]])

    def runs(self) -> set[str]:
        return {v.run for v in self.log.versions()}

    def changes(self, version: int | None = None) -> DataFrame:
        """All changes up to a version, from the last whole copy of the log on."""
        upto = [v for v in self.log.versions() if version is None or v.number <= version]
        start = [v for v in self.whole.versions() if v.number <= (upto[-1].number if upto else 0)][-1:]
        recent = self.log.read([v for v in upto if not start or v.number > start[0].number])
        return recent.unionByName(self.whole.read(start)) if start else recent

    def zones(self, version: int | None = None) -> DataFrame:
        """Zones of the valid files: those that came and did not go."""
        zone = F.when(F.col("action") == "add", F.struct("run", "low", "high", "rows", "since"))
        every = self.changes(version).where("action in ('add', 'drop')").groupBy("file", "stream_path", "resource_kind").agg(
            F.max(zone).alias("z"), F.max(F.col("action") == "drop").alias("gone")
        )
        return every.where("not gone").select("file", "stream_path", "resource_kind", "z.*")

    def cuts(self, version: int | None = None) -> DataFrame | None:
        """Deleted ranges that some valid file may still hold; None if there are none. Compaction applies all that came before it."""
        upto = [v for v in self.log.versions() if version is None or v.number <= version]
        settled = max([0, *[v.number for v in upto if v.kind == "compact"]])
        recent = [v for v in upto if v.kind == "delete" and v.number > settled]
        return self.log.read(recent).where("action = 'cut'") if recent else None

    def _rows(self, known: list[tuple[str, int]], columns: Sequence[str], version: int | None) -> DataFrame:
        """Rows of these files (name and version) without those that later ranges delete. File names go through the driver, as for any scan."""
        if not known:
            return self.spark.createDataFrame([], self.schema).select(*columns)
        read = self.spark.read.schema(self.schema).parquet(*[f for f, _ in known])
        cuts = self.cuts(version)
        if cuts is None:
            return read.select(*columns)
        cut = broadcast_if_small(cuts.select(*[F.col(c).alias(f"_{c}") for c in ("stream_path", "resource_kind", "low", "high", "since")]))
        since = broadcast_if_small(self.spark.createDataFrame(known, "_file string, _at bigint"))
        gone = (
            F.col(self.feed).eqNullSafe(F.col("_stream_path"))
            & self.kind.eqNullSafe(F.col("_resource_kind"))
            & F.col(self.position).between(F.col("_low"), F.col("_high"))
            & (F.col("_at") < F.col("_since"))
        )
        placed = read.select(*self.columns, F.col("_metadata.file_path").alias("_file")).join(since, "_file")
        return placed.join(cut, gone, "left_anti").select(*columns)

    @staticmethod
    def _files(zones: DataFrame) -> list[tuple[str, int]]:
        return [(r.file, r.since) for r in zones.select("file", "since").distinct().collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a version whose files are still there."""
        return self._rows(self._files(self.zones(version)), self.columns, version)

    # --- changes ----------------------------------------------------------------------------------------------------------

    def _store(self, rows: DataFrame, run: str, few: bool) -> DataFrame:
        """Write rows and their index; the zones of the new files. What an unfinished attempt of the run left is replaced."""
        data, index = f"{self.path}/data/run={run}", f"{self.path}/index/run={run}"
        by = [F.col(self.feed), self.kind, F.col(self.position)]
        rows = rows.select(*self.columns)
        placed = rows.coalesce(1) if few else rows.repartitionByRange(*by)
        placed.sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(data)
        stored = self.spark.read.schema(self.schema).parquet(data)
        # A small run is counted in one task.
        stored = stored.coalesce(1) if few else stored
        file = F.col("_metadata.file_path").alias("file")
        if not few:
            # A row for each word of a filter, made by OR in the tasks before the shuffle.
            words = stored.select(file, F.col(self.feed).alias("stream_path"), bloom_word(*self.key).alias("word"), bloom_bits(*self.key).alias("bits"))
            words.groupBy("file", "stream_path", "word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(index)
        zones = stored.select(file, F.col(self.feed).alias("stream_path"), self.kind.alias("resource_kind"), F.col(self.position).alias("_at"))
        # A zone with a NULL position has no bounds: it may hold any key, and no range covers it.
        bounded = F.count("_at") == F.count(F.lit(1))
        return zones.groupBy("file", "stream_path", "resource_kind").agg(
            F.when(bounded, F.min("_at")).alias("low"), F.when(bounded, F.max("_at")).alias("high"), F.count(F.lit(1)).alias("rows")
        )

    def _commit(self, changes: Sequence[DataFrame], kind: str, run: str, after: int) -> int:
        columns = dict(c.split() for c in CHANGES.split(", "))
        every = [p.select(*[F.col(c).cast(t) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]) for p in changes]
        version = self.log.write(reduce(DataFrame.unionByName, every), kind, run, after)
        if version.number % SNAPSHOT_EVERY == 0:
            self.whole.write(self.zones(version.number).withColumn("action", F.lit("add")).select(*columns), "zones", run, version.number - 1)
        return version.number

    def near(self, fresh: DataFrame) -> tuple[list, int]:
        """Zones whose positions the batch spans, and its number of rows. Zones of other positions never leave the log."""
        span = [F.min(self.position).alias("_low"), F.max(self.position).alias("_high"), F.count(F.lit(1)).alias("_n")]
        spans = fresh.groupBy(F.col(self.feed).alias("_feed")).agg(*span).limit(MANY_FEEDS + 1).collect()
        if not spans:
            return [], 0
        if len(spans) > MANY_FEEDS:
            spans = fresh.agg(F.lit(None).alias("_feed"), *span).collect()
        alike = [F.col("stream_path").eqNullSafe(F.lit(x._feed)) if len(spans) > 1 or x._feed is not None else F.lit(True) for x in spans]
        # A zone with a NULL position may hold any key, and so may a NULL one.
        overlaps = [F.lit(True) if x._low is None else F.coalesce((F.col("low") <= x._high) & (F.col("high") >= x._low), F.lit(True)) for x in spans]
        meets = reduce(Column.__or__, [same & near for same, near in zip(alike, overlaps, strict=True)])
        # A change that takes a zone away names its bounds as well, so what is near can be folded by itself.
        found = self.changes().where(F.col("action").isin("add", "drop") & meets).collect()
        gone = {(z.file, z.stream_path, z.resource_kind) for z in found if z.action == "drop"}
        return [z for z in found if (z.file, z.stream_path, z.resource_kind) not in gone], sum(x._n for x in spans)

    def may_hold(self, fresh: DataFrame, near: list) -> set[str]:
        """Of the files with these zones, the small ones and those whose filter knows one of the keys."""
        filtered = set(folders.names(self.spark, f"{self.path}/index"))
        spans: dict[tuple, list] = {}
        for z in near:
            if f"run={z.run}" in filtered:
                spans.setdefault((z.file, z.stream_path), []).append(z)
        small = {z.file for z in near if f"run={z.run}" not in filtered}
        if not spans:
            return small
        wide = []
        for (file, feed), zs in spans.items():
            bounded = all(z.low is not None for z in zs)
            wide.append((file, feed, min(z.low for z in zs) if bounded else None, max(z.high for z in zs) if bounded else None))
        asked = broadcast_if_small(self.spark.createDataFrame(wide, "file string, _feed string, _low bigint, _high bigint"))
        inside = F.col(self.feed).eqNullSafe(F.col("_feed")) & F.coalesce(F.col(self.position).between(F.col("_low"), F.col("_high")), F.lit(True))
        keys = fresh.select(*self.key).join(asked, inside)
        keys = keys.select("file", "_feed", bloom_word(*self.key).alias("word"), bloom_bits(*self.key).alias("wanted")).distinct()
        runs = sorted({z.run for zs in spans.values() for z in zs})
        filters = self.spark.read.schema(INDEX).parquet(*[f"{self.path}/index/run={r}" for r in runs])
        met = keys.join(filters, ["file", "word"]).where(F.col("stream_path").eqNullSafe(F.col("_feed")) & (F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted")))
        return small | {r.file for r in met.select("file").distinct().collect()}

    def stage(self, rows: DataFrame, order: Sequence[str] = (), run: str | None = None) -> Staged:
        """First half of an append: the new rows are written, and not yet valid. Without ``order`` any row of a key may be the first."""
        run = run or uuid.uuid4().hex
        versions = self.log.versions()
        after = max([0, *[v.number for v in versions]])
        if run in {v.run for v in versions}:
            return Staged(run, after, None)
        # Kept for its three uses; a lost block is made again from the batch.
        fresh = first_of_each(rows.select(*dict.fromkeys([*self.columns, *order])), self.key, order or self.key).persist()
        near, many = self.near(fresh)
        files = self.may_hold(fresh, near)
        held = sorted({(z.file, z.since) for z in near if z.file in files})
        new = fresh
        if held:
            old = self._rows(held, self.key, None).select(*[F.col(c).alias(f"_{c}") for c in self.key])
            same = F.col(self.feed).eqNullSafe(F.col(f"_{self.feed}")) & F.col(self.position).eqNullSafe(F.col(f"_{self.position}"))
            new = fresh.join(old, same, "left_anti")
        zones = self._store(new, run, many <= SMALL_FILE_ROWS)
        fresh.unpersist()
        return Staged(run, after, zones)

    def commit(self, staged: Staged) -> int:
        """Second half: one new version makes the rows valid, all or none."""
        if staged.zones is None:
            return staged.after
        if self.version() != staged.after:
            raise RuntimeError("the table has changed since these rows were staged; stage them again")
        new = staged.zones.withColumns({"action": F.lit("add"), "run": F.lit(staged.run), "since": F.lit(staged.after + 1)})
        return self._commit([new], "append", staged.run, staged.after)

    def append(self, rows: DataFrame, order: Sequence[str] = (), run: str | None = None) -> int:
        """Add the first row (by ``order``) of each key that the table does not hold. A run that was applied before changes nothing."""
        return self.commit(self.stage(rows, order, run))

    def delete(self, ranges: DataFrame, run: str | None = None, as_of: int | None = None) -> int:
        """Delete rows of (``stream_path``, ``resource_kind``) from ``low`` to ``high`` that were there at version ``as_of`` (the newest).

        Files that lie in the ranges altogether go with this version, the others when they are compacted.
        """
        run, versions = run or uuid.uuid4().hex, self.log.versions()
        after = max([0, *[v.number for v in versions]])
        if run in {v.run for v in versions}:
            return after
        upto = after if as_of is None else as_of
        ranges = materialise(ranges.select("stream_path", "resource_kind", "low", "high"), "ranges")
        named = broadcast_if_small(ranges.select(*[F.col(c).alias(f"_{c}") for c in ranges.columns]))
        covered = (
            F.col("stream_path").eqNullSafe(F.col("_stream_path"))
            & F.col("resource_kind").eqNullSafe(F.col("_resource_kind"))
            & (F.col("low") >= F.col("_low"))
            & (F.col("high") <= F.col("_high"))
            & (F.col("since") <= upto)
        )
        zones = materialise(self.zones(), "zones")
        staying = zones.join(named, covered, "left_anti").select("file").distinct()
        gone = zones.join(broadcast_if_small(materialise(staying, "staying")), "file", "left_anti").withColumn("action", F.lit("drop"))
        cut = ranges.withColumns({"action": F.lit("cut"), "since": F.lit(upto + 1)})
        return self._commit([gone, cut], "delete", run, after)

    def compact(self, small: int = SMALL_FILE_ROWS) -> int:
        """Join up files of fewer than ``small`` rows and those that ranges have cut. The rows stay the same."""
        version = self.version()
        zones = materialise(self.zones(version), "zones")
        thin = zones.groupBy("file").agg(F.sum("rows").alias("n")).where(F.col("n") < small).select("file")
        cuts = self.cuts(version)
        if cuts is not None:
            cut = broadcast_if_small(cuts.select(*[F.col(c).alias(f"_{c}") for c in ("stream_path", "resource_kind", "low", "high", "since")]))
            meets = (
                F.col("stream_path").eqNullSafe(F.col("_stream_path"))
                & F.col("resource_kind").eqNullSafe(F.col("_resource_kind"))
                & (F.col("low") <= F.col("_high"))
                & (F.col("high") >= F.col("_low"))
                & (F.col("since") < F.col("_since"))
            )
            thin = thin.unionByName(zones.join(cut, meets, "left_semi").select("file"))
        old = materialise(zones.join(broadcast_if_small(materialise(thin.distinct(), "thin")), "file", "left_semi"), "old")
        run = uuid.uuid4().hex
        many = old.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        new = self._store(self._rows(self._files(old), self.columns, version), run, many <= SMALL_FILE_ROWS)
        new = new.withColumns({"action": F.lit("add"), "run": F.lit(run), "since": F.lit(version + 1)})
        return self._commit([new, old.withColumn("action", F.lit("drop"))], "compact", run, version)

    def vacuum(self) -> list[str]:
        """Delete the files of runs that no valid file belongs to, among them what unfinished attempts left. Their names."""
        live = {r.run for r in self.zones().select("run").distinct().collect()}
        dead = [n for n in folders.names(self.spark, f"{self.path}/data") if n.removeprefix("run=") not in live]
        for name in dead:
            folders.remove(self.spark, f"{self.path}/data/{name}")
            folders.remove(self.spark, f"{self.path}/index/{name}")
        return dead
