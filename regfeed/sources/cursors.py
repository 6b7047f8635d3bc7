"""Reading on from what is already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed import feeds as feed_names
from regfeed.operators.topn import MAX_LITERAL_GROUPS, first_rows

# Fixed value: events per feed and read.
READ_SIZE = 1_000


def _after(log: DataFrame, starts: dict[str, int], default: int | None) -> DataFrame:
    """Rows from each feed's start position on; feeds without one start at ``default``, or not at all.

    The starts are literals in the filter, so partitions and row groups before them are not read. With more feeds than a
    filter should name, they are joined instead; the rows are the same.
    """
    feed, position = F.col("stream_path"), F.col("timepoint")
    if len(starts) > MAX_LITERAL_GROUPS:
        table = log.sparkSession.createDataFrame(list(starts.items()), "_feed string, _start bigint")
        joined = log.join(F.broadcast(table), feed == F.col("_feed"), "left")
        start = F.col("_start") if default is None else F.coalesce("_start", F.lit(default))
        return joined.where(position >= start).drop("_feed", "_start")
    wanted = F.lit(False)
    for name, start in starts.items():
        wanted = wanted | ((feed == name) & (position >= start))
    if default is not None:
        known = feed.isin(*starts) if starts else F.lit(False)
        wanted = wanted | (~known & (position >= default))
    return log.where(wanted)


def _per_feed(table: DataFrame, feeds: tuple[str, ...]) -> dict[str, int]:
    """One number per feed on the driver: at most ``len(feeds)`` rows."""
    peaks = feed_names.known_only(table, feeds).groupBy("stream_path").agg(F.max("timepoint").alias("timepoint"))
    return {r.stream_path: r.timepoint for r in peaks.collect()}


def resume(log: DataFrame, cursors: DataFrame, feeds: tuple[str, ...] = feed_names.FEEDS) -> DataFrame:
    """Events after each feed's cursor. A feed without a cursor starts at its live end: nothing yet."""
    starts = {name: last + 1 for name, last in _per_feed(cursors, feeds).items()}
    return _after(feed_names.known_only(log, feeds), starts, default=None)


def next_batch(log: DataFrame, stored: DataFrame, size: int = READ_SIZE, feeds: tuple[str, ...] = feed_names.FEEDS) -> DataFrame:
    """The next ``size`` events per feed after the greatest stored position, from the start if none is stored."""
    starts = {name: last + 1 for name, last in _per_feed(stored, feeds).items()}
    waiting = _after(feed_names.known_only(log, feeds), starts, default=0)
    return first_rows(waiting, ["stream_path"], "timepoint", size, newest=False)
