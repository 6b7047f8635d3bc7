"""Cursors, heartbeats, health and the connection gauge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfeed import feeds as feed_names
from regfeed.functions.timeutil import delay_minutes, utc_day
from regfeed.operators.scan import running_total
from regfeed.operators.topn import rows_at_max

# How long a cursor is kept, and how long a silent feed counts as live.
CURSOR_DAYS = 7
HEARTBEAT_SECONDS = 60


def latest_cursor(log: DataFrame, now: Column, feeds: tuple[str, ...] | None = None, seq: str = "event_id") -> DataFrame:
    """Position of the event written last per feed, if it is younger than the expiry: of every feed in the log, or of those named."""
    named = log.where("stream_path is not null") if feeds is None else feed_names.known_only(log, feeds)
    last = rows_at_max(named, ["stream_path"], "received")
    latest = last.groupBy("stream_path").agg(F.max_by("timepoint", seq).alias("timepoint"), F.max("received").alias("received"))
    return latest.where(F.col("received") >= now - F.expr(f"interval {CURSOR_DAYS} days"))


def heartbeats(raw_lines: DataFrame) -> DataFrame:
    """Last sign of life per feed; blank keep-alive lines count."""
    return raw_lines.groupBy("stream_path").agg(F.max("received").alias("last_seen"))


def feed_health(beats: DataFrame, now: Column, feeds: tuple[str, ...] = feed_names.FEEDS, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Whether each feed was heard within the limit; a feed never heard is not healthy."""
    known = feed_names.feed_list(beats.sparkSession, feeds)
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    healthy = F.coalesce(quiet < seconds * 1_000_000, F.lit(False))
    # At most one row per feed on either side.
    return known.join(F.broadcast(feed_names.known_only(beats, feeds)), "stream_path", "left").select("stream_path", healthy.alias("healthy"))


def publication_delay(events: DataFrame, seq: str = "event_id") -> DataFrame:
    """Delay of the latest event per feed in minutes, one decimal."""
    delay = delay_minutes(F.col("ts"), F.col("received"))
    last = rows_at_max(events, ["stream_path"], "received")
    return last.groupBy("stream_path").agg(F.round(F.max_by(delay, seq), 1).alias("delay_minutes"))


def connections_current(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("bigint").alias("connections"))


def connections_running(changes: DataFrame) -> DataFrame:
    """Open connections after every change. One gauge over everything, so it is scanned in ordered buckets."""
    gauge = changes.withColumn("_gauge", F.lit("all"))
    return running_total(gauge, ["_gauge"], ["ts", "event_id"], F.col("delta"), "connections").drop("_gauge")


def connections_daily(changes: DataFrame) -> DataFrame:
    return changes.groupBy(utc_day(F.col("ts")).alias("day")).agg(F.sum("delta").cast("bigint").alias("net"))
