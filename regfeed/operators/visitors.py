"""Unique visitors per day and in all, exact or by mergeable sketch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: first day with records.
FIRST_DAY = dt.date(2023, 9, 12)


def require_day(day: dt.date) -> dt.date:
    if day < FIRST_DAY:
        raise ValueError(f"visitors are counted from {FIRST_DAY.isoformat()} on, not on {day.isoformat()}")
    return day


def _counted(visits: DataFrame) -> DataFrame:
    """Visits with an address, on days with records."""
    return visits.where(F.col("ip").isNotNull() & (F.col("day") >= F.lit(FIRST_DAY)))


def daily_exact(visits: DataFrame) -> DataFrame:
    return _counted(visits).groupBy("day").agg(F.count_distinct("ip").alias("visitors"))


def daily_sketches(visits: DataFrame) -> DataFrame:
    """One sketch per day: partial sketches are built before the shuffle, so a busy day moves only kilobytes."""
    return _counted(visits).groupBy("day").agg(F.hll_sketch_agg("ip").alias("sketch"))


def daily_approximate(sketches: DataFrame) -> DataFrame:
    return sketches.select("day", F.hll_sketch_estimate("sketch").alias("visitors"))


def total_merged(sketches: DataFrame) -> DataFrame:
    """All-time visitors from the stored daily sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))


def total_exact(visits: DataFrame) -> DataFrame:
    return _counted(visits).agg(F.count_distinct("ip").alias("visitors"))
