"""The metadata reads of the feed service as one object over its stored tables.

Arguments are checked here; every method returns a DataFrame and runs nothing beyond the small look-ups that the
operators themselves make.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfeed import feeds
from regfeed.operators import counts, history, liveness, sample, schema, visitors

# Largest random samples of the two callers.
RANDOM_MAX_WEB = 1_000
RANDOM_MAX_TOOL = 100


@dataclass
class FeedService:
    """``events``: the log (stream_path, timepoint, resource_kind, received, company_number, body).
    ``raw_lines``: every line with its arrival, blank ones too. ``responses``: the response log.
    ``visits``: (ip, day). ``connections``: open and close records. ``profile``: schema profile per kind."""

    events: DataFrame
    raw_lines: DataFrame
    responses: DataFrame
    visits: DataFrame
    connections: DataFrame
    profile: DataFrame
    body: str = "line"
    ties: tuple[str, ...] = ("event_id",)

    def _feed(self, stream_path: str) -> DataFrame:
        return self.events.where(F.col("stream_path") == feeds.require_feed(stream_path))

    def list_stream_paths(self) -> tuple[str, ...]:
        return feeds.FEEDS

    def download_history(self, stream_path: str, qty: int | str | None = None) -> DataFrame:
        """Newest events of a feed; 100 unless a quantity is given, at most 10,000."""
        spark = self.events.sparkSession
        asked = None if qty is None else str(qty)
        # The rule is the one used on request tables; a single request is one row.
        row = counts.history_requests(spark.createDataFrame([(asked,)], "qty string")).first()
        if not row.accepted:
            raise ValueError(f"a history holds 1 to {counts.HISTORY_MAX} events, not {row.quantity}")
        return history.history(self.events, row.quantity, stream_path, self.ties).select("rank", "timepoint", self.body)

    def latest_sample_event(self, stream_path: str) -> DataFrame:
        return history.latest_event(self._feed(stream_path), self.body, self.ties).select("pretty")

    def stats(self, stream_path: str) -> DataFrame:
        """Events per day of a feed."""
        return counts.daily_counts(self._feed(stream_path)).orderBy("day")

    def resource_kinds(self, stream_path: str) -> DataFrame:
        return counts.kind_counts(self._feed(stream_path))

    def all_resource_kinds(self) -> DataFrame:
        return self.profile.select("resource_kind").distinct()

    def random_company_numbers(self, qty: int = 1, seed: str = "", maximum: int = RANDOM_MAX_WEB) -> DataFrame:
        size = sample.pool(sample.company_numbers(self.events), seed="pool")
        return sample.random_companies(size.select("company_number"), counts.sample_quantity(qty, maximum), seed).select("company_number")

    def schemas(self) -> DataFrame:
        return schema.json_schemas(self.profile)

    def schema(self, resource_kind: str) -> DataFrame:
        return schema.json_schemas(self.profile, resource_kind)

    def recent_responses(self) -> DataFrame:
        return history.recent_responses(self.responses).orderBy(F.col("seq").desc()).select("response")

    def visitors(self, today: dt.date) -> DataFrame:
        """All-time and today's visitors."""
        sketches = visitors.daily_sketches(self.visits)
        day = F.when(F.col("day") == F.lit(today), F.col("sketch"))
        return sketches.agg(
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("total"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(day)), F.lit(0)).alias("today"),
        )

    def visitors_on(self, day: dt.date) -> DataFrame:
        rows = self.visits.where(F.col("day") == F.lit(visitors.require_day(day)))
        return visitors.daily_approximate(visitors.daily_sketches(rows))

    def health(self, now: Column) -> DataFrame:
        return liveness.feed_health(liveness.heartbeats(self.raw_lines), now)

    def current_connections(self) -> DataFrame:
        return liveness.connections_current(self.connections)
