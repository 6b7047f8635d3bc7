"""Streaming queries; each result must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from regfeed.operators import schema
from regfeed.plans.feed_queries import CN_SQL, NOW, numbered
from regfeed.plans.registry import ORACLES, query
from regfeed.plans.store_queries import PROFILE_SQL, _tree
from regfeed.session import work_path
from regfeed.streaming import jobs, tables

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
DAY = "'%Y-%m-%d'"
FILES = 4


def _live(df, order, job):
    """The table as a stream of four micro-batches in the given order, drained by two starts of the job on one checkpoint.

    ``job`` takes the stream and the checkpoint; the result of its second start counts.
    """
    checkpoint = work_path(df.sparkSession, "checkpoint")
    for path in tables.stage(df, order, files=FILES, stops=2):
        done = job(tables.source(df.sparkSession, path, df.schema, FILES), checkpoint)
    return done


@query(
    "st_ingest",
    """select stream_path, timepoint, resource_kind, resource_id, line as event_data, cast(null as string) as reject_reason
  from (select e.*, l.line from ev e join event_lines l on e.event_id = l.event_id join raw_lines r on e.event_id = r.event_id where shape = 'ok')
union all select stream_path, null, null, null, line, case shape when 'truncated' then 'syntax' else 'not_object' end from raw_text where shape not in ('ok', 'blank')""",
    ("ev", "raw_text"),
)
def st_ingest(v):
    path = work_path(v.spark, "bronze")
    _live(v("raw_text"), "event_id", lambda live, checkpoint: jobs.ingest(live, path, v.spark, checkpoint))
    return v.spark.read.parquet(path).select("stream_path", "timepoint", "resource_kind", "resource_id", "event_data", "reject_reason")


@query("st_daily_counts", f"select stream_path, strftime(cast(received as date), {DAY}) as day, count(*) as events from ev group by all", ("ev",))
def st_daily_counts(v):
    return _live(v("ev"), "event_id", lambda live, checkpoint: jobs.daily_counters(live, v.spark, checkpoint))


@query("st_kind_counts", "select stream_path, resource_kind, count(*) as events from ev group by all", ("ev",))
def st_kind_counts(v):
    return _live(v("ev"), "event_id", lambda live, checkpoint: jobs.kind_counters(live, v.spark, checkpoint))


@query("st_dedup", "select stream_path, timepoint, min(arrival) as arrival from arrivals group by all", ("arrivals",))
def st_dedup(v):
    key = ["stream_path", "timepoint"]
    return _live(v("arrivals"), "arrival", lambda live, checkpoint: jobs.dedup(live, key, ["arrival"], v.spark, checkpoint))


@query("st_late_rejects", ORACLES["late_rejects"])
def st_late_rejects(v):
    flags = _live(v("arrivals"), "arrival", lambda live, checkpoint: jobs.late_rejects(live, v.spark, checkpoint))
    return flags.where(~F.col("accepted")).select("stream_path", "timepoint", "arrival")


@query("st_cursor", ORACLES["cursor_latest"])
def st_cursor(v):
    now = F.lit(NOW).cast("timestamp_ntz")
    cells = _live(v("ev"), "event_id", lambda live, checkpoint: jobs.cursors(live, v.spark, checkpoint))
    return cells.where(F.col("received") >= now - F.expr("interval 7 days")).select("stream_path", "timepoint", "received")


@query("st_topic_fanout", ORACLES["topic_fanout"])
def st_topic_fanout(v):
    done = _live(v("event_lines"), "event_id", lambda live, checkpoint: jobs.FanOut(v.spark, ("topics",), checkpoint=checkpoint).run(live))
    return done.topics.read(v.spark).select("topic", F.md5(F.col("value").cast("binary")).alias("message"))


@query("st_company_pool", f"select distinct {CN_SQL} as company_number from ev where stream_path = 'companies' order by md5(company_number) limit 100", ("ev",))
def st_company_pool(v):
    done = _live(numbered(v), "event_id", lambda live, checkpoint: jobs.FanOut(v.spark, ("pool",), 100, checkpoint).run(live))
    return done.pool.last(v.spark)


@query("st_schema_profile", _tree(PROFILE_SQL.format("placed")), ("payload",))
def st_schema_profile(v):
    done = _live(v("payload"), "event_id", lambda live, checkpoint: jobs.FanOut(v.spark, ("schema",), checkpoint=checkpoint).run(live))
    return schema.profile(done.schema_counts()).drop("parent")


@query(
    "st_cursor_ttl",
    f"""select stream_path, arg_max(timepoint, (received, event_id)) as timepoint, strftime(max(received), {STAMP}) as received from ev group by stream_path
having max(received) >= (select max(received) from ev) - interval 20 minute""",
    ("ev",),
)
def st_cursor_ttl(v):
    """Cursors of the feeds heard within 20 minutes of the newest arrival."""
    cells = _live(v("ev"), "event_id", lambda live, checkpoint: jobs.cursors(live, v.spark, checkpoint, "20 minutes"))
    return cells.select("stream_path", "timepoint", "received")


@query("st_feed_health", ORACLES["feed_health"].replace("as now from raw_lines", "as now from raw_lines where stream_path <> 'charges'"))
def st_feed_health(v):
    """Health at the last sign of life; one feed is made to have been silent always."""
    heard = v("raw_lines").where(F.col("stream_path") != "charges")
    return _live(heard, "event_id", lambda live, checkpoint: jobs.health(live, v.spark, checkpoint))[0]


@query(
    "st_fanout_all",
    f"""select 'topic' as part, topic as name, message as value from ({ORACLES["topic_fanout"]})
union all select 'pool', 'company_number', company_number from ({ORACLES["st_company_pool"]})
union all select 'schema', resource_kind || ' ' || path, types || ' ' || cast(present as varchar) from ({ORACLES["st_schema_profile"]})""",
)
def st_fanout_all(v):
    """Messages, pool and schema of one job, stopped and started again half-way."""
    events = numbered(v).select("event_id", "stream_path", "resource_kind", "company_number")
    events = events.join(v("event_lines").select("event_id", "line"), "event_id").join(v("payload").select("event_id", "data"), "event_id")
    done = _live(events, "event_id", lambda live, checkpoint: jobs.FanOut(v.spark, pool_size=100, checkpoint=checkpoint).run(live))
    profile = schema.profile(done.schema_counts())
    rows = [
        done.messages().select(F.lit("topic").alias("part"), F.col("topic").alias("name"), F.md5(F.col("value").cast("binary")).alias("value")),
        done.pooled().select(F.lit("pool"), F.lit("company_number"), "company_number"),
        profile.select(F.lit("schema"), F.concat_ws(" ", "resource_kind", "path"), F.concat_ws(" ", "types", F.col("present").cast("string"))),
    ]
    return rows[0].union(rows[1]).union(rows[2])
