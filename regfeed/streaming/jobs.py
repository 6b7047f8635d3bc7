"""Live twins of the batch operators.

Ingest is a plain streaming write. The others run the batch operator on each micro-batch and carry a small table (one
row per feed, day, kind or path) from batch to batch: keyed state would put a busy feed into one task. These tables lie
beside the job's checkpoint, so a restarted job goes on with both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regfeed import feeds as feed_names
from regfeed.operators import buffer, counts, history, liveness, sample, schema
from regfeed.session import tune, work_path
from regfeed.sources import ndjson
from regfeed.sources.committed import CommittedTable
from regfeed.streaming.tables import BatchTable, beside, drain

Batch = Callable[[DataFrame], DataFrame]

# Micro-batches after which the small files of a stored table are joined up.
COMPACT_EVERY = 100


@contextmanager
def cached(batch: DataFrame) -> Iterator[DataFrame]:
    """A micro-batch that is used more than once; lost blocks are read again from the source."""
    held = batch.persist()
    try:
        yield held
    finally:
        held.unpersist()


def stamped(lines: DataFrame) -> DataFrame:
    """Lines with their arrival time, taken when the batch starts."""
    return lines if "received" in lines.columns else lines.withColumn("received", F.current_timestamp())


def ingest(lines: DataFrame, path: str, spark: SparkSession, checkpoint: str | None = None) -> None:
    """Lines to the stored form, rejected lines beside the good ones: one pass, one exactly-once file sink.

    A folder per feed, so that reading one feed skips the others.
    """
    writer = ndjson.bronze(stamped(lines)).writeStream.format("parquet").option("path", path).partitionBy("stream_path").outputMode("append")
    drain(writer, spark, "ingest", checkpoint)


def _counter(events: DataFrame, count: Batch, schema_text: str, spark: SparkSession, checkpoint: str | None) -> DataFrame:
    """Totals so far plus the counts of each micro-batch.

    The totals are one row per feed and day or kind. They are carried as a small table, since keyed state would be
    committed for every shuffle partition in every batch.
    """
    table = BatchTable(spark, schema_text, "counter", beside(checkpoint, "counter"))
    keys = [c for c in table.state_before(spark, 0).columns if c != "events"]

    def save(batch: DataFrame, batch_id: int) -> None:
        before = table.state_before(tune(batch.sparkSession), batch_id)
        every = count(batch).select(*keys, "events").union(before)
        table.write(every.groupBy(*keys).agg(F.sum("events").alias("events")), batch_id)

    drain(events.writeStream.foreachBatch(save), spark, "counter", checkpoint)
    return table.last(spark)


def daily_counters(events: DataFrame, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Counts per feed and arrival day."""
    return _counter(events, counts.daily_counts, "stream_path string, day date, events bigint", spark, checkpoint)


def kind_counters(events: DataFrame, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Counts per feed and kind."""
    return _counter(events, counts.kind_counts, "stream_path string, resource_kind string, events bigint", spark, checkpoint)


def dedup(events: DataFrame, key: list[str], order: list[str], spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """First writer wins, inside a micro-batch and against everything stored before it. ``key``: the columns of feed and position.

    A micro-batch is one commit of the stored table; a repeated one finds its own number there. What a batch reads of the table
    depends on the positions it spans and not on how much is stored; small files are joined up from time to time.
    """
    schema_text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    path = beside(checkpoint, "buffer") or work_path(spark, "buffer")

    def save(batch: DataFrame, batch_id: int) -> None:
        table = CommittedTable(tune(batch.sparkSession), schema_text, path, key)
        table.append(batch, order, f"batch-{batch_id}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            table.compact()

    drain(events.writeStream.foreachBatch(save), spark, "dedup", checkpoint)
    return CommittedTable(spark, schema_text, path, key).read()


def dedup_within(events: DataFrame, delay: str, event_time: str = "received") -> DataFrame:
    """Distinct keys where repeats come within ``delay`` of the first; state is bounded by the delay."""
    timed = events.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(buffer.KEY))


def late_rejects(arrivals: DataFrame, spark: SparkSession, checkpoint: str | None = None) -> DataFrame:
    """Accept or reject each arrival by the greatest position before it; one maximum per feed is carried over."""
    out = BatchTable(spark, "stream_path string, timepoint bigint, arrival bigint, accepted boolean", "flags", beside(checkpoint, "flags"))
    held = BatchTable(spark, "stream_path string, timepoint bigint", "highest", beside(checkpoint, "highest"))

    def save(batch: DataFrame, batch_id: int) -> None:
        session = tune(batch.sparkSession)
        before = held.state_before(session, batch_id)
        with cached(batch) as rows:
            flagged = history.late_flags(rows, before)
            out.write(flagged.select("stream_path", "timepoint", "arrival", "accepted"), batch_id)
            every = rows.select("stream_path", "timepoint").union(before)
            held.write(every.groupBy("stream_path").agg(F.max("timepoint").alias("timepoint")), batch_id)

    drain(arrivals.writeStream.foreachBatch(save), spark, "late", checkpoint)
    return out.read(spark).drop("batch_id")


def cursors(events: DataFrame, spark: SparkSession, checkpoint: str | None = None, ttl: str | None = None) -> DataFrame:
    """The event written last per feed, whatever its name, kept over batches.

    ``ttl`` (such as ``"7 days"``): cursors that are that much older than the newest arrival leave the table and an event that old does
    not enter it, so the table grows with the feeds that are alive. The limit only moves on, so results do not depend on batches.
    """
    cells = BatchTable(spark, "stream_path string, timepoint bigint, received timestamp_ntz, event_id bigint", "cursors", beside(checkpoint, "cursors"))
    columns = ["stream_path", "timepoint", "received", "event_id"]

    def save(batch: DataFrame, batch_id: int) -> None:
        before = cells.state_before(tune(batch.sparkSession), batch_id)
        every = batch.select(*columns).union(before).where("stream_path is not null")
        last = F.max(F.struct("received", "event_id", "timepoint")).alias("c")
        newest = every.groupBy("stream_path").agg(last).select("stream_path", "c.timepoint", "c.received", "c.event_id")
        if ttl is not None:
            # One row per feed; the newest of all is never dropped, so the next batch knows the limit too.
            limit = F.max("received").over(Window.partitionBy()) - F.expr(f"interval {ttl}")
            newest = newest.withColumn("_limit", limit).where(F.col("received") >= F.col("_limit")).drop("_limit")
        cells.write(newest, batch_id)

    drain(events.writeStream.foreachBatch(save), spark, "cursors", checkpoint)
    return cells.last(spark)


def health(
    lines: DataFrame,
    spark: SparkSession,
    checkpoint: str | None = None,
    feeds: tuple[str, ...] = feed_names.FEEDS,
    seconds: int = liveness.HEARTBEAT_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """Health of each feed after the last batch, and its changes: (stream_path, healthy, at, batch_id).

    The clock is the newest arrival so far. A feed that has never been heard begins as unhealthy; a change is told in the batch that
    shows it. State is one row per feed.
    """
    beats = BatchTable(spark, "stream_path string, last_seen timestamp_ntz", "beats", beside(checkpoint, "beats"))
    states = BatchTable(spark, "stream_path string, healthy boolean", "health", beside(checkpoint, "health"))
    changes = BatchTable(spark, "stream_path string, healthy boolean, at timestamp_ntz", "changes", beside(checkpoint, "changes"))

    def save(batch: DataFrame, batch_id: int) -> None:
        session = tune(batch.sparkSession)
        heard = liveness.heartbeats(batch).where("stream_path is not null")
        every = heard.select("stream_path", "last_seen").union(beats.state_before(session, batch_id))
        beats.write(every.groupBy("stream_path").agg(F.max("last_seen").alias("last_seen")), batch_id)
        known = beats.state_before(session, batch_id + 1)
        now = F.lit(known.agg(F.max("last_seen").cast("string")).first()[0]).cast("timestamp_ntz")
        states.write(liveness.feed_health(known, now, feeds, seconds), batch_id)
        before = states.state_before(session, batch_id).select("stream_path", F.col("healthy").alias("_was"))
        both = states.state_before(session, batch_id + 1).join(before, "stream_path", "left")
        changed = both.where(F.col("healthy") != F.coalesce("_was", F.lit(False)))
        changes.write(changed.select("stream_path", "healthy", now.alias("at")), batch_id)

    drain(lines.writeStream.foreachBatch(save), spark, "health", checkpoint)
    return states.last(spark), changes.read(spark).where("batch_id >= 0")


TOPIC_SCHEMA = "topic string, value string"
COUNTS_SCHEMA = "resource_kind string, parent string, path string, type string, nodes bigint"


class FanOut:
    """Everything done with a live event: publish it, pool its company number, learn its schema.

    The micro-batch is cached and used by every part, so it is read and parsed once. When all parts are written, a marker commits the
    batch; what is read back is what committed batches wrote, so nobody sees a batch's messages without its schema.
    """

    def __init__(
        self,
        spark: SparkSession,
        parts: tuple[str, ...] = ("topics", "pool", "schema"),
        pool_size: int = sample.POOL_SIZE,
        checkpoint: str | None = None,
    ):
        self.spark, self.parts, self.pool_size, self.checkpoint = spark, parts, pool_size, checkpoint
        self.topics = BatchTable(spark, TOPIC_SCHEMA, "topics", beside(checkpoint, "topics"))
        self.pool = BatchTable(spark, "company_number string", "pool", beside(checkpoint, "pool"))
        self.schemas = BatchTable(spark, COUNTS_SCHEMA, "schemas", beside(checkpoint, "schemas"))
        self.commits = BatchTable(spark, "part string", "commits", beside(checkpoint, "commits"))

    def save(self, batch: DataFrame, batch_id: int) -> None:
        session = tune(batch.sparkSession)
        with cached(batch) as rows:
            if "topics" in self.parts:
                self.topics.write(history.topic_messages(rows, "line").select("topic", "value"), batch_id)
            if "pool" in self.parts:
                merged = sample.merge_pools(self.pool.state_before(session, batch_id), sample.company_numbers(rows), self.pool_size)
                self.pool.write(merged.select("company_number"), batch_id)
            if "schema" in self.parts:
                self.schemas.write(schema.type_counts(rows), batch_id)
        self.commits.write(session.createDataFrame([(p,) for p in self.parts], "part string"), batch_id)

    def run(self, events: DataFrame) -> FanOut:
        drain(events.writeStream.foreachBatch(self.save), self.spark, "fanout", self.checkpoint)
        return self

    def committed(self) -> int:
        """Number of the newest batch of which every part is written, -1 before the first."""
        return self.commits.newest(self.spark)

    def messages(self) -> DataFrame:
        """Published messages of committed batches."""
        return self.topics.read(self.spark, self.committed() + 1).where("batch_id >= 0").drop("batch_id")

    def pooled(self) -> DataFrame:
        """The pool as the newest committed batch left it."""
        return self.pool.state_before(self.spark, self.committed() + 1)

    def schema_counts(self) -> DataFrame:
        """Profile over all committed batches: counts add up."""
        return schema.merge_counts(self.schemas.read(self.spark, self.committed() + 1).drop("batch_id"))
