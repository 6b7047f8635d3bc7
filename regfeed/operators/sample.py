"""Random company numbers, the bounded pool, and fixed-size row samples.

Randomness is a seeded md5 order: repeatable, the same on any number of partitions, and mergeable - the k smallest of
two merged k-smallest sets are the k smallest of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfeed.operators.topn import bottom_k

# Pool size and the feed that fills it.
POOL_SIZE = 5_000
POOL_FEED = "companies"


def token(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def company_numbers(events: DataFrame, stream_path: str = POOL_FEED) -> DataFrame:
    """Distinct company numbers seen on the feed."""
    # NULL fails the comparison too.
    return events.where((F.col("stream_path") == stream_path) & (F.col("company_number") != "")).select("company_number").distinct()


def pool(numbers: DataFrame, size: int = POOL_SIZE, seed: str = "") -> DataFrame:
    """At most ``size`` distinct numbers."""
    return bottom_k(numbers, token(F.col("company_number"), seed), size)


def merge_pools(left: DataFrame, right: DataFrame, size: int = POOL_SIZE, seed: str = "") -> DataFrame:
    both = left.select("company_number").union(right.select("company_number")).distinct()
    return pool(both, size, seed)


def random_companies(numbers: DataFrame, count: int = 1, seed: str = "") -> DataFrame:
    """``count`` distinct numbers, or all of them if there are fewer."""
    return bottom_k(numbers, token(F.col("company_number"), seed), count)


def first_seen(events: DataFrame) -> DataFrame:
    """The event that added each company number, so every other event of it added nothing.

    An aggregate rather than a window: copies of one number are reduced before the shuffle.
    """
    valid = events.where((F.col("stream_path") == POOL_FEED) & (F.col("company_number") != ""))
    return valid.groupBy("company_number").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("events"))


def mark_new(events: DataFrame) -> DataFrame:
    """Whether each event of the pool's feed brought a number not seen before.

    Joined on the event, which is unique, rather than on the number, which may be a busy one.
    """
    brought = first_seen(events).select("event_id", F.lit(True).alias("_new"))
    marked = events.where(F.col("stream_path") == POOL_FEED).join(brought, "event_id", "left")
    return marked.withColumn("is_new", F.coalesce("_new", F.lit(False))).drop("_new")


def sample_rows(df: DataFrame, key: Column, size: int = 1_000, seed: str = "") -> DataFrame:
    """A fixed-size uniform sample of rows, in one pass."""
    return bottom_k(df, token(key, seed), size)
