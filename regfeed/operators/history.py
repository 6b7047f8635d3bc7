"""The event log and the response log: append, retention, newest N."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed import feeds as feed_names
from regfeed.operators.scan import max_before, running_number
from regfeed.operators.topn import first_rows, rows_at_max
from regfeed.session import broadcast_if_small

# Log sizes.
LOG_CAP = 10_000
RESPONSE_CAP = 1_000
RECENT_RESPONSES = 20


@F.pandas_udf(T.StringType())
def _pretty(texts: pd.Series) -> pd.Series:
    """JSON text indented by two; used on one event per feed."""
    return texts.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore")


def event_log(arrivals: DataFrame) -> DataFrame:
    """Log ids ``timepoint-seq``; seq numbers the copies of one timepoint from 0 in arrival order."""
    numbered = running_number(arrivals, ["stream_path", "timepoint"], ["arrival"], "seq")
    entry = F.concat_ws("-", F.col("timepoint").cast("string"), F.col("seq").cast("string"))
    return numbered.withColumn("log_key", feed_names.log_key(F.col("stream_path"))).withColumn("entry_id", entry)


def retain_latest(log: DataFrame, cap: int = LOG_CAP, ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest ``cap`` entries of every feed, exactly."""
    return first_rows(log, ["stream_path"], "timepoint", cap, ties=ties).drop("rank")


def history(log: DataFrame, n: int, stream_path: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Newest ``n`` events, ranked; one feed or all of them."""
    rows = log if stream_path is None else log.where(F.col("stream_path") == feed_names.require_feed(stream_path))
    return first_rows(rows, ["stream_path"], "timepoint", n, ties=ties)


def latest_event(log: DataFrame, body: str, ties: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The newest event of every feed, pretty-printed.

    The greatest position is found on two narrow columns; only the rows holding it carry their text.
    """
    newest = rows_at_max(feed_names.known_only(log), ["stream_path"], "timepoint")
    picked = newest.groupBy("stream_path").agg(
        F.max("timepoint").alias("timepoint"), F.max_by(body, F.struct(*ties)).alias(body)
    )
    return picked.withColumn("pretty", _pretty(F.col(body)))


def newest_responses(responses: DataFrame, n: int = RESPONSE_CAP) -> DataFrame:
    """The newest ``n`` records of the response log, one log for all feeds."""
    return first_rows(responses, [], "seq", n)


def recent_responses(responses: DataFrame, n: int = RECENT_RESPONSES) -> DataFrame:
    """Newest records as JSON objects; header text becomes an object, and is left out when there is none."""
    newest = newest_responses(responses, n)
    headers = F.try_parse_json(F.col("headers"))
    body = F.to_json(F.struct("type", "stream_path", headers.alias("headers")))
    return newest.withColumn("response", body)


def late_flags(arrivals: DataFrame, stored_max: DataFrame | None = None) -> DataFrame:
    """Whether each arrival may be appended: its position is not below the greatest one before it in its feed.

    ``stored_max`` (stream_path, timepoint) is what the log already holds: one row per feed.
    """
    scanned = max_before(arrivals, ["stream_path"], ["arrival", "timepoint"], "timepoint", "highest")
    if stored_max is not None:
        held = stored_max.select("stream_path", F.col("timepoint").alias("_held"))
        scanned = scanned.join(broadcast_if_small(held), "stream_path", "left")
        scanned = scanned.withColumn("highest", F.greatest("highest", "_held")).drop("_held")
    return scanned.withColumn("accepted", F.coalesce(F.col("timepoint") >= F.col("highest"), F.lit(True)))


def visible_at(events: DataFrame, at: Column, filter_text: str = "") -> DataFrame:
    """Events still on screen: shown for thirty seconds times (length of the filter + 0.5) after arrival."""
    millis = int((len(filter_text) + 0.5) * 30_000)
    gone = F.unix_millis(F.col("received").cast("timestamp")) + millis
    now = F.unix_millis(at.cast("timestamp"))
    return events.where((F.unix_millis(F.col("received").cast("timestamp")) <= now) & (gone > now))


def live_filter(events: DataFrame, filter_text: str = "", visible: bool = True) -> DataFrame:
    """Events whose company number contains the text. A hidden page shows only a full company number's events."""
    if not visible and len(filter_text) != 8:
        return events.where(F.lit(False))
    return events.where(F.col("company_number").contains(filter_text))


def topic_messages(events: DataFrame, body: str) -> DataFrame:
    """One message per event for its feed's topic: the event with ``streamPath`` in front. ``body`` is the text of a JSON object."""
    blanks = F.lit(" \t\r\n")
    rest = F.substr(F.ltrim(F.col(body), blanks), F.lit(2))
    comma = F.when(F.ltrim(rest, blanks).startswith("}"), "").otherwise(",")
    with_feed = F.concat(F.lit('{"streamPath":"'), F.col("stream_path"), F.lit('"'), comma, rest)
    return events.withColumn("topic", F.col("stream_path")).withColumn("value", with_feed)
