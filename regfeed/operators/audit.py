"""Completeness audit of an archive by position.

Raw rows are reduced to one row per feed and day in a single hash aggregate; everything after it works on days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(rows: DataFrame) -> DataFrame:
    """Rows, span and day per feed; ``span`` is the row count a complete day would have."""
    return _per_day(rows, "day")


def daily_from_parts(rows: DataFrame) -> DataFrame:
    """The same for an archive whose folders give the day as year, month and day of month."""
    parts = ["year", "month", "day"]
    return _per_day(rows, *parts).select("stream_path", F.make_date(*parts).alias("day"), "events", "min_timepoint", "max_timepoint", "span")


def _per_day(rows: DataFrame, *day: str) -> DataFrame:
    return (
        rows.groupBy("stream_path", *day)
        .agg(F.count(F.lit(1)).alias("events"), F.min("timepoint").alias("min_timepoint"), F.max("timepoint").alias("max_timepoint"))
        .withColumn("span", F.col("max_timepoint") - F.col("min_timepoint") + 1)
    )


def day_status(days: DataFrame) -> DataFrame:
    """``ok``, or why the day's row count is not its span."""
    status = (
        F.when(F.col("events") == F.col("span"), "ok")
        .when(F.col("events") % F.col("span") == 0, "duplicate_files")
        .when(F.col("events") < F.col("span"), "missing")
        .otherwise("duplicate_events")
    )
    return days.withColumn("status", status)


def boundaries(days: DataFrame) -> DataFrame:
    """Compare each day's first position with the last of the day before."""
    last = F.lag("max_timepoint").over(Window.partitionBy("stream_path").orderBy("day"))
    # A previous maximum of 0 counts as no previous day.
    marked = days.withColumn("previous_max", last)
    boundary = (
        F.when(F.coalesce(F.col("previous_max"), F.lit(0)) == 0, "first")
        .when(F.col("min_timepoint") > F.col("previous_max") + 1, "gap")
        .when(F.col("min_timepoint") < F.col("previous_max") + 1, "overlap")
        .otherwise("ok")
    )
    return marked.withColumn("boundary", boundary)


def report(rows: DataFrame) -> DataFrame:
    """Status and boundary per feed and day."""
    return boundaries(day_status(daily(rows)))


def correct_total(days: DataFrame) -> DataFrame:
    """Events since the last irregular day of each feed; the irregular day itself counts nothing."""
    bad = (F.col("status") != "ok") | F.col("boundary").isin("gap", "overlap")
    last_bad = F.max(F.when(bad, F.col("day"))).over(Window.partitionBy("stream_path"))
    counted = F.when(F.col("_last_bad").isNull() | (F.col("day") > F.col("_last_bad")), F.col("events")).otherwise(F.lit(0))
    return days.withColumn("_last_bad", last_bad).groupBy("stream_path").agg(F.sum(counted).alias("correct_events"))


def distinct_positions(rows: DataFrame) -> DataFrame:
    """Different positions per feed and day: tells a complete day from one where a repeat hides a gap."""
    return rows.groupBy("stream_path", "day").agg(F.count_distinct("timepoint").alias("distinct_timepoints"))
