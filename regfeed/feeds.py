"""The nine feeds: membership, topic keys and table names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The feed names.
FEEDS = (
    "companies",
    "filings",
    "officers",
    "persons-with-significant-control",
    "charges",
    "insolvency-cases",
    "disqualified-officers",
    "company-exemptions",
    "persons-with-significant-control-statements",
)

# Fixed value: prefix of a feed's log key.
LOG_KEY_PREFIX = "events"


def require_feed(stream_path: str) -> str:
    """Return the feed name, or raise naming the valid ones."""
    if stream_path not in FEEDS:
        raise ValueError(f"no feed named {stream_path!r}; the feeds are {', '.join(FEEDS)}")
    return stream_path


def known_only(df: DataFrame, feeds: tuple[str, ...] = FEEDS) -> DataFrame:
    """Rows of known feeds. Anything grouped by ``stream_path`` after this has at most ``len(feeds)`` rows."""
    return df.where(F.col("stream_path").isin(*feeds))


def feed_list(spark, feeds: tuple[str, ...] = FEEDS) -> DataFrame:
    return spark.createDataFrame([(f,) for f in feeds], "stream_path string")


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests for a feed that does not exist, with the list of valid feeds."""
    return requests.where(~F.coalesce(F.col("stream_path").isin(*FEEDS), F.lit(False))).withColumn(
        "possible_options", F.lit(",".join(FEEDS))
    )


def log_key(stream_path: Column) -> Column:
    return F.concat(F.lit(LOG_KEY_PREFIX + ":"), stream_path)


def feed_from_log_key(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(2))


def table_name(stream_path: Column) -> Column:
    """Feed name to buffer table name: every non-letter becomes an underscore."""
    return F.concat(F.regexp_replace(stream_path, "(?i)[^a-z]", "_"), F.lit("_events"))
