"""Counters over the event log: days, kinds, series, and the rules on request arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.functions.timeutil import utc_day

# Limits on quantities in requests.
HISTORY_DEFAULT = 100
HISTORY_MAX = 10_000


def daily_counts(events: DataFrame, arrived: str = "received") -> DataFrame:
    """Events per feed and UTC arrival day; repeated events count again."""
    return events.groupBy("stream_path", utc_day(F.col(arrived)).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def kind_counts(events: DataFrame) -> DataFrame:
    """Events per feed and resource kind, with the kind's share of its feed."""
    counts = events.groupBy("stream_path", "resource_kind").agg(F.count(F.lit(1)).alias("events"))
    # The window runs over counts: one row per kind.
    share = F.col("events") / F.sum("events").over(Window.partitionBy("stream_path"))
    return counts.withColumn("share", share)


def distinct_kinds(events: DataFrame) -> DataFrame:
    return events.select("resource_kind").where(F.col("resource_kind").isNotNull()).distinct()


def daily_series(counts: DataFrame) -> DataFrame:
    """Counts in day order, with the position of each day in its feed."""
    in_order = Window.partitionBy("stream_path").orderBy("day")
    return counts.withColumn("position", F.row_number().over(in_order).cast("bigint"))


def daily_count_json(counts: DataFrame) -> DataFrame:
    """One ``{"day": count}`` object per feed, days ascending. A feed has one entry per day, so the list is short."""
    entry = F.struct(F.col("day").cast("string").alias("day"), F.col("events"))
    days = F.sort_array(F.collect_list(entry))
    return counts.groupBy("stream_path").agg(F.to_json(F.map_from_entries(days)).alias("counts"))


def history_quantity(text: Column) -> Column:
    """Leading integer of the text; absent, zero or not a number means the default."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.coalesce(F.nullif(number, F.lit(0)), F.lit(HISTORY_DEFAULT))


def history_requests(requests: DataFrame) -> DataFrame:
    """Resolve the quantity of each request and say whether it is allowed."""
    allowed = F.col("quantity").between(1, HISTORY_MAX)
    return requests.withColumn("quantity", history_quantity(F.col("qty"))).withColumn("accepted", allowed)


def sample_quantity(count: int = 1, maximum: int = 1000) -> int:
    """Check the size of a random sample."""
    if not 1 <= count <= maximum:
        raise ValueError(f"quantity must be between 1 and {maximum}, got {count}")
    return count
