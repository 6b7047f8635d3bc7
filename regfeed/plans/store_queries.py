"""Queries over stored data: parsing, buffer, export, audit, schemas."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.feeds import FEEDS
from regfeed.functions import timeutil
from regfeed.operators import audit, buffer, export, history, liveness, schema, typed
from regfeed.plans.nightly import Buffer, run_export
from regfeed.plans.registry import query
from regfeed.session import many_files, materialise, work_path
from regfeed.sources import chunks, cursors, ndjson

DAY = "'%Y-%m-%d'"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
UPLOADED = dt.date(2024, 2, 1)
# The nine feeds and the one with out-of-order dates.
SOURCES = (*FEEDS, "orders")

# --- lines ----------------------------------------------------------------------------------------------------------


def _as_text_files(lines, column="line"):
    path = work_path(lines.sparkSession, "lines")
    lines.select(F.col(column).alias("value")).write.text(path)
    return path


@query("ndjson_scan", "select line from raw_text where trim(line) <> ''", ("raw_text",))
def ndjson_scan(v):
    path = _as_text_files(v("raw_text"))
    return ndjson.non_blank(v.spark.read.text(path).withColumnRenamed("value", "line"))


CHUNK = 97


@query("chunk_reassemble", "select stream_path, timepoint as line_no, line from event_lines", ("event_lines",))
def chunk_reassemble(v):
    received = materialise(chunks.cut(v("event_lines"), CHUNK), "chunks")
    return chunks.reassemble(received).select("stream_path", "line_no", "line")


@query("parse_good", f"select l.event_id, l.stream_path, l.timepoint, l.resource_kind, strftime(l.received, {STAMP}) as received from event_lines l join raw_lines r on l.event_id = r.event_id where shape = 'ok'", ("event_lines", "raw_lines"))
def parse_good(v):
    good, _ = ndjson.split_quarantine(v("raw_text"))
    return good.select(
        "event_id",
        "stream_path",
        F.try_variant_get("event", "$.event.timepoint", "bigint").alias("timepoint"),
        F.try_variant_get("event", "$.resource_kind", "string").alias("resource_kind"),
        "received",
    )


@query(
    "parse_quarantine_counts",
    """select stream_path, case shape when 'truncated' then 'syntax' else 'not_object' end as reject_reason, count(*) as rejected
from raw_lines where shape not in ('ok', 'blank') group by all""",
    ("raw_lines",),
)
def parse_quarantine_counts(v):
    _, bad = ndjson.split_quarantine(v("raw_text"))
    return bad.groupBy("stream_path", "reject_reason").agg(F.count(F.lit(1)).alias("rejected"))


@query("feeds_union", "select stream_path, count(*) as events, cast(sum(length(line)) as bigint) as characters from event_lines group by stream_path", ("event_lines",))
def feeds_union(v):
    root = work_path(v.spark, "feeds")
    v("event_lines").select("stream_path", F.col("line").alias("value")).write.partitionBy("stream_path").text(root)
    everything = ndjson.read_all_feeds(v.spark, {feed: f"{root}/stream_path={feed}" for feed in FEEDS})
    return everything.groupBy("stream_path").agg(F.count(F.lit(1)).alias("events"), F.sum(F.length("line")).alias("characters"))


@query("envelope", f"select event_id, timepoint, resource_kind, resource_uri, resource_id, strftime(date_trunc('millisecond', ts), {STAMP}) as published_at from event_lines join ev using (event_id, timepoint, resource_kind, ts)", ("event_lines", "ev"))
def envelope(v):
    return ndjson.envelope(v("event_lines").select("event_id", "line")).select(
        "event_id", "timepoint", "resource_kind", "resource_uri", "resource_id", "published_at"
    )


@query("json_extract", "select event_id, line ->> '$.resource_kind' as resource_kind, line ->> '$.data.address.locality' as locality from event_lines", ("event_lines",))
def json_extract(v):
    kinds = ndjson.extract(v("event_lines").select("event_id", "line"), "line", "$.resource_kind", "resource_kind")
    return ndjson.extract(kinds, "line", "$.data.address.locality", "locality").select("event_id", "resource_kind", "locality")


@query("ndjson_export_roundtrip", "select line from event_lines", ("event_lines",))
def ndjson_export_roundtrip(v):
    """From stamped text, as a reader of the live topics has it: both stamps in front, and one of them at the end."""
    sent = v("event_lines")
    both = F.concat(F.lit('{"received":"'), F.col("received").cast("string"), F.lit('","streamPath":"'), F.col("stream_path"), F.lit('",'), F.substr("line", F.lit(2)))
    one = F.concat(F.lit('{"streamPath": "'), F.col("stream_path"), F.lit('" , '), F.substr("line", F.lit(2)))
    stamped = sent.withColumn("line", F.when(F.col("event_id") % 2 == 0, both).otherwise(one))
    path = _as_text_files(ndjson.to_ndjson(stamped, "line"), "value")
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "ndjson_infer_ingest",
    """select resource_kind, k as column_name, count(*) as filled from (select resource_kind, unnest(json_keys(line, '$.data')) as k from event_lines) group by all""",
    ("event_lines",),
)
def ndjson_infer_ingest(v):
    """How often each key of the payload was sent, per kind, from the stored typed tables. A JSON null was sent too."""
    return ndjson.sent_keys(v.spark, ndjson.ingest(v("event_lines")))


# --- cursors and buffer ---------------------------------------------------------------------------------------------

HALF = "timestamp '2024-01-15 00:00:00'"


@query(
    "resume_from_cursor",
    f"""select e.stream_path, e.timepoint, e.event_id from ev e join (select stream_path, arg_max(timepoint, (received, event_id)) as cursor from ev where ts < {HALF}
  and stream_path <> 'officers' group by stream_path) c on e.stream_path = c.stream_path and e.timepoint >= c.cursor + 1""",
    ("ev",),
)
def resume_from_cursor(v):
    # The officers feed has no cursor, so it starts at its live end.
    before = v("ev").where((F.col("ts") < F.expr(HALF)) & (F.col("stream_path") != "officers"))
    stored = liveness.latest_cursor(before, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return cursors.resume(v("ev"), stored).select("stream_path", "timepoint", "event_id")


@query(
    "incremental_batch",
    f"""select stream_path, timepoint, rank from (select e.stream_path, e.timepoint, row_number() over (partition by e.stream_path order by e.timepoint) as rank from ev e
  left join (select stream_path, max(timepoint) as held from ev where ts < {HALF} and stream_path <> 'officers' group by stream_path) s on e.stream_path = s.stream_path
  where e.timepoint > coalesce(s.held, -1)) where rank <= 1000""",
    ("ev",),
)
def incremental_batch(v):
    stored = v("ev").where((F.col("ts") < F.expr(HALF)) & (F.col("stream_path") != "officers"))
    return cursors.next_batch(v("ev"), stored).select("stream_path", "timepoint", F.col("rank").cast("bigint"))


DUP_ORDER = ["timepoint", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "ts"]


@query(
    "insert_ignore_batch",
    f"""select timepoint, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(ts, {STAMP}) as ts from (select *, row_number() over (partition by timepoint
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, ts) as r from dup_feed) where r = 1""",
    ("dup_feed",),
)
def insert_ignore_batch(v):
    return buffer.first_of_each(v("dup_feed"), ["timepoint"], DUP_ORDER)


@query(
    "insert_ignore_against_table",
    f"""select timepoint, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(ts, {STAMP}) as ts from (select *, row_number() over (partition by timepoint
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, ts) as r from dup_feed) d where r = 1
  and not exists (select 1 from orders_feed o where o.timepoint = d.timepoint and o.resource_kind <> 'P')""",
    ("dup_feed", "orders_feed"),
)
def insert_ignore_against_table(v):
    held = v("orders_feed").where(F.col("resource_kind") != "P")
    return buffer.insert_ignore(v("dup_feed"), held, ["timepoint"], DUP_ORDER)


@query("timepoint_range", "select stream_path, timepoint, event_id from ev where timepoint >= 20 and timepoint <= 900 and timepoint < 800", ("ev",))
def timepoint_range(v):
    sql = "select stream_path, timepoint, event_id from {log} where timepoint between :low and :high and timepoint < :bound"
    return v.spark.sql(sql, args={"low": 20, "high": 900, "bound": 800}, log=v("ev"))


# --- export ---------------------------------------------------------------------------------------------------------

CUTOFF_SQL = """summary as (select stream_path, cast(published_at as date) as day, count(*) as events, max(timepoint) as max_timepoint, min(timepoint) as min_timepoint
  from buffered group by all),
cutoffs as (select stream_path, arg_max(min_timepoint, max_timepoint) as cutoff from summary group by stream_path),
eligible as (select b.* from buffered b join cutoffs c on b.stream_path = c.stream_path and b.timepoint < c.cutoff)"""
_B = ("buffered",)


def _sql(select: str) -> str:
    """Continue the view list with the export steps."""
    return ",\n" + CUTOFF_SQL + "\n" + select


@query("published_day_summary", _sql(f"select stream_path, strftime(day, {DAY}) as day, events, max_timepoint, min_timepoint from summary"), _B)
def published_day_summary(v):
    return export.published_day_summary(v("buffered"))


@query("export_cutoff", _sql("select stream_path, cutoff from cutoffs"), _B)
def export_cutoff(v):
    return export.cutoffs(v("buffered"), SOURCES)


@query("export_eligible", _sql("select stream_path, timepoint, resource_kind from eligible"), _B)
def export_eligible(v):
    rows = export.eligible(v("buffered"), export.cutoffs(v("buffered"), SOURCES))
    return rows.select("stream_path", "timepoint", "resource_kind")


@query(
    "export_window_check",
    _sql("""select stream_path, count(*) as events, min(timepoint) as min_timepoint, max(timepoint) as max_timepoint,
  count(*) = max(timepoint) - min(timepoint) + 1 as contiguous from eligible group by stream_path"""),
    _B,
)
def export_window_check(v):
    return export.window_check(export.eligible(v("buffered"), export.cutoffs(v("buffered"), SOURCES)))


@query("export_kind_counts", _sql("select stream_path, event_data ->> '$.resource_kind' as resource_kind, count(*) as events from eligible group by all"), _B)
def export_kind_counts(v):
    rows = export.eligible(v("buffered"), export.cutoffs(v("buffered"), SOURCES))
    return export.kind_counts(ndjson.extract(rows, "event_data", "$.resource_kind", "resource_kind"))


def _exported(v, records_per_file=1_000):
    return run_export(v("buffered"), UPLOADED, feeds=SOURCES, records_per_file=records_per_file)


@query(
    "export_readback",
    _sql(f"select stream_path as stream, resource_kind, '2024-02-01' as uploaded_day, timepoint, strftime(published_at, {STAMP}) as published_at, event_data from eligible"),
    _B,
)
def export_readback(v):
    done = _exported(v)
    return export.read_archive(v.spark, done.path).select("stream", "resource_kind", "uploaded_day", "timepoint", "published_at", "event_data")


@query("export_parts_disjoint", _sql("select cast(0 as bigint) as overlaps, count(*) as exported from eligible"), _B)
def export_parts_disjoint(v):
    files = _exported(v).files
    marked = files.select("events", F.lit(0).alias("overlap")).unionByName(export.overlapping_parts(files).select(F.lit(0).alias("events"), F.lit(1).alias("overlap")))
    return marked.agg(F.sum("overlap").alias("overlaps"), F.sum("events").alias("exported"))


PART_BYTES = 4_096


@query(
    "export_parts_bytes",
    _sql(f"""select stream_path as stream, resource_kind, count(*) as events, cast(sum(strlen(event_data)) as bigint) as bytes, cast(0 as bigint) as overlaps, cast(0 as bigint) as too_large,
  true as filled from eligible group by all"""),
    _B,
)
def export_parts_bytes(v):
    """Files of at most 4 KB of JSON: what they hold of each kind, how many are too large or reach into the next one, and whether they are no more than three quarters full ones would be."""
    done = run_export(v("buffered"), UPLOADED, feeds=SOURCES, part_bytes=PART_BYTES)
    with many_files(v.spark):
        files = materialise(export.part_sizes(export.read_archive(v.spark, done.path)), "sizes")
    late = export.overlapping_parts(files).groupBy("stream", "resource_kind").agg(F.count(F.lit(1)).alias("overlaps"))
    sums = files.groupBy("stream", "resource_kind").agg(
        F.sum("events").alias("events"),
        F.sum("bytes").alias("bytes"),
        F.sum(((F.col("bytes") > PART_BYTES) & (F.col("min_timepoint") < F.col("max_timepoint"))).cast("bigint")).alias("too_large"),
        (F.count(F.lit(1)) <= F.floor(F.sum("bytes") / (PART_BYTES * 3 // 4)) + 1).alias("filled"),
    )
    return sums.join(late, ["stream", "resource_kind"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0).cast("bigint")))


@query(
    "export_manifest",
    _sql("""select stream_path as stream, resource_kind, count(*) as events, min(timepoint) as min_timepoint, max(timepoint) as max_timepoint from eligible group by all"""),
    _B,
)
def export_manifest(v):
    files = _exported(v).files
    return files.groupBy("stream", "resource_kind").agg(
        F.sum("events").alias("events"), F.min("min_timepoint").alias("min_timepoint"), F.max("max_timepoint").alias("max_timepoint")
    )


@query("export_reconcile", _sql("select stream_path, resource_kind, count(*) as exported, count(*) as buffered, true as can_delete from eligible group by all"), _B)
def export_reconcile(v):
    return _exported(v).reconciled


@query(
    "buffer_after_export",
    _sql("select b.stream_path, b.timepoint, b.resource_kind from buffered b join cutoffs c on b.stream_path = c.stream_path where b.timepoint >= c.cutoff"),
    _B,
)
def buffer_after_export(v):
    return _exported(v).remaining.select("stream_path", "timepoint", "resource_kind")


TWICE_SQL = f""",
early as (select * from buffered where published_at < {HALF}),
days1 as (select stream_path, cast(published_at as date) as day, min(timepoint) as low, max(timepoint) as high from early group by all),
cut1 as (select stream_path, arg_max(low, high) as cutoff from days1 group by stream_path),
out1 as (select b.* from early b join cut1 c on b.stream_path = c.stream_path and b.timepoint < c.cutoff),
rest as (select * from buffered b where not exists (select 1 from out1 o where o.stream_path = b.stream_path and o.timepoint = b.timepoint)),
days2 as (select stream_path, cast(published_at as date) as day, min(timepoint) as low, max(timepoint) as high from rest group by all),
cut2 as (select stream_path, arg_max(low, high) as cutoff from days2 group by stream_path),
out2 as (select b.* from rest b join cut2 c on b.stream_path = c.stream_path and b.timepoint < c.cutoff)
select stream_path as stream, resource_kind, timepoint, event_data, true as archived from (select * from out1 union all select * from out2)
union all select stream_path, resource_kind, timepoint, event_data, false from rest b join cut2 c using (stream_path) where timepoint >= c.cutoff"""


@query("export_twice_one_day", TWICE_SQL, _B)
def export_twice_one_day(v):
    """Two windows exported on one day, the buffer replaced after each: every row is in the archive or in the buffer, once."""
    rows = v("buffered")
    late = F.col("published_at") >= F.expr(HALF)
    path, store = work_path(v.spark, "archive"), _buffer_of(v, rows)
    store.append(rows.where(~late))
    store.export(UPLOADED, path)
    store.append(rows.where(late))
    store.export(UPLOADED, path)
    columns = ("resource_kind", "timepoint", "event_data")
    archived = export.read_archive(v.spark, path).select("stream", *columns, F.lit(True).alias("archived"))
    return archived.unionByName(store.read().select(F.col("stream_path").alias("stream"), *columns, F.lit(False).alias("archived")))


def _buffer_of(v, rows, name="buffer"):
    schema_text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return Buffer(v.spark, schema_text, work_path(v.spark, name))


@query(
    "export_rearrived_row",
    _sql("""select stream_path as stream, resource_kind, timepoint, event_data, true as archived from eligible
union all select stream_path, resource_kind, timepoint, event_data, true from eligible qualify timepoint = min(timepoint) over (partition by stream_path)
union all select stream_path, resource_kind, timepoint, event_data, false from buffered b join cutoffs c using (stream_path) where timepoint >= c.cutoff"""),
    _B,
)
def export_rearrived_row(v):
    """The first position of every feed comes again after its export: a second run of the same day and cutoff adds it, and takes nothing away."""
    rows = v("buffered")
    path, store = work_path(v.spark, "archive"), _buffer_of(v, rows)
    store.append(rows)
    store.export(UPLOADED, path)
    first = rows.groupBy("stream_path").agg(F.min("timepoint").alias("timepoint"))
    store.append(rows.join(F.broadcast(first), ["stream_path", "timepoint"]))
    store.export(UPLOADED, path)
    columns = ("resource_kind", "timepoint", "event_data")
    archived = export.read_archive(v.spark, path).select("stream", *columns, F.lit(True).alias("archived"))
    return archived.unionByName(store.read().select(F.col("stream_path").alias("stream"), *columns, F.lit(False).alias("archived")))


@query(
    "buffer_commits",
    """, parts as (select stream_path, timepoint, published_at, resource_kind, case when part = 1 then event_data else '{"part":' || part || '}' end as event_data, part
  from buffered, (values (1), (2), (3)) t(part) where part = 3 or (part = 1 and timepoint % 3 <> 0) or (part = 2 and timepoint % 3 <> 1)),
buffer2 as (select * from parts where part < 3 qualify row_number() over (partition by stream_path, timepoint order by part) = 1),
days as (select stream_path, cast(published_at as date) as day, min(timepoint) as low, max(timepoint) as high from buffer2 group by all),
cut as (select stream_path, arg_max(low, high) as cutoff from days group by stream_path)
select stream_path, timepoint, event_data from buffer2 join cut using (stream_path) where timepoint >= cutoff
union all select stream_path, timepoint, event_data from parts join cut using (stream_path) where part = 3 and timepoint % 7 = 0 and timepoint < cutoff""",
    _B,
)
def buffer_commits(v):
    """Two overlapping appends, a third whose job ends before its commit, an export, and positions that come again after it."""
    rows = v("buffered")
    store, path = _buffer_of(v, rows), work_path(v.spark, "archive")

    def part(n, keep):
        return rows.where(keep).withColumn("event_data", F.concat(F.lit('{"part":'), F.lit(n), F.lit("}")))

    at = F.col("timepoint")
    store.append(rows.where(at % 3 != 0))
    store.append(part(2, at % 3 != 1))
    third = part(3, at % 7 == 0)
    store.table.stage(third, run="third")
    store.export(UPLOADED, path)
    store.append(third, run="third")
    store.append(third, run="third")
    return store.read().select("stream_path", "timepoint", "event_data")


@query(
    "archive_scan_pruned",
    _sql("select stream_path as stream, timepoint, resource_kind from eligible where resource_kind = 'purchase' and stream_path <> 'orders'"),
    _B,
)
def archive_scan_pruned(v):
    archive = export.read_archive(v.spark, _exported(v).path)
    return archive.where((F.col("resource_kind") == "purchase") & (F.col("stream") != "orders")).select("stream", "timepoint", "resource_kind")


@query("register_files_lenient", _sql("select timepoint, cast(null as string) as notes from eligible"), _B)
def register_files_lenient(v):
    done = _exported(v)
    return export.register_lenient(v.spark, [f"{done.path}/run={done.attempt}"], "timepoint bigint, notes string")


@query("archive_sample_table", _sql("select timepoint, cast(published_at as string) as published_at, event_data from eligible where false"), _B)
def archive_sample_table(v):
    archive = export.read_archive(v.spark, _exported(v).path)
    return export.empty_like(export.without_partitions(archive))


# --- audit ----------------------------------------------------------------------------------------------------------

AUDIT_SQL = """days as (select stream_path, day, count(*) as events, min(timepoint) as min_timepoint, max(timepoint) as max_timepoint,
  max(timepoint) - min(timepoint) + 1 as span from damaged group by all),
prior as (select *, lag(max_timepoint) over (partition by stream_path order by day) as previous_max from days),
audit as (select *, case when events = span then 'ok' when events % span = 0 then 'duplicate_files' when events < span then 'missing' else 'duplicate_events' end as status,
  case when previous_max is null or previous_max = 0 then 'first' when min_timepoint > previous_max + 1 then 'gap' when min_timepoint < previous_max + 1 then 'overlap' else 'ok' end as boundary
  from prior)"""
_D = ("damaged",)


def _audit(select: str) -> str:
    return ",\n" + AUDIT_SQL + "\n" + select


@query("audit_daily", _audit(f"select stream_path, strftime(day, {DAY}) as day, events, min_timepoint, max_timepoint, span from days"), _D)
def audit_daily(v):
    return audit.daily(v("damaged"))


@query("audit_day_status", _audit(f"select stream_path, strftime(day, {DAY}) as day, status from audit"), _D)
def audit_day_status(v):
    return audit.day_status(audit.daily(v("damaged"))).select("stream_path", "day", "status")


@query("audit_boundaries", _audit(f"select stream_path, strftime(day, {DAY}) as day, previous_max, boundary from audit"), _D)
def audit_boundaries(v):
    return audit.boundaries(audit.daily(v("damaged"))).select("stream_path", "day", "previous_max", "boundary")


@query(
    "audit_correct_total",
    _audit("""select stream_path, cast(sum(case when last_bad is null or day > last_bad then events else 0 end) as bigint) as correct_events
from (select *, max(case when status <> 'ok' or boundary in ('gap', 'overlap') then day end) over (partition by stream_path) as last_bad from audit) group by stream_path"""),
    _D,
)
def audit_correct_total(v):
    return audit.correct_total(audit.report(v("damaged")))


@query(
    "audit_report",
    _audit(f"""select a.stream_path, strftime(a.day, {DAY}) as day, events, span, status, boundary, distinct_timepoints from audit a
join (select stream_path, day, count(distinct timepoint) as distinct_timepoints from damaged group by all) d on a.stream_path = d.stream_path and a.day = d.day"""),
    _D,
)
def audit_report(v):
    rows = v("damaged")
    return audit.report(rows).join(audit.distinct_positions(rows), ["stream_path", "day"]).select(
        "stream_path", "day", "events", "span", "status", "boundary", "distinct_timepoints"
    )


@query(
    "audit_archive_daily",
    _audit(f"""select stream_path, strftime(day, {DAY}) as day, events, span, status, boundary from audit"""),
    _D,
)
def audit_archive_daily(v):
    """The audit over stored files whose folders give feed, year, month and day."""
    path = work_path(v.spark, "days")
    day = F.col("day")
    dated = v("damaged").select("stream_path", F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"), "timepoint")
    keys = ["stream_path", "year", "month", "day"]
    dated.repartitionByRange(*keys, "timepoint").write.partitionBy(*keys).parquet(path)
    stored = v.spark.read.schema("timepoint bigint, stream_path string, year int, month int, day int").parquet(path)
    days = audit.boundaries(audit.day_status(audit.daily_from_parts(stored)))
    return days.select("stream_path", "day", "events", "span", "status", "boundary")


# --- schemas --------------------------------------------------------------------------------------------------------

TREE_SQL = """nodes as (select event_id, resource_kind, ts, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') as path,
  case t.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null'
    when 'DOUBLE' then 'number' else 'integer' end as type
  from payload, json_tree(payload.data) t),
placed as (select *, nullif(regexp_replace(path, '(\\.[^.\\[\\]]+|\\[\\])$', ''), path) as parent from nodes)"""

PROFILE_SQL = """select c.resource_kind, c.path, case when list_contains(types, 'number') then array_to_string(list_filter(types, lambda t: t <> 'integer'), ',')
    else array_to_string(types, ',') end as types, present, coalesce(c.parent is not null and path not like '%[]' and present = parents, false) as required
from (select resource_kind, parent, path, list_sort(list(distinct type)) as types, count(*) as present from {0} group by all) c
left join (select resource_kind, path as parent, count(*) as parents from {0} where type = 'object' group by all) o
  on c.resource_kind = o.resource_kind and c.parent = o.parent"""
_P = ("payload",)


def _tree(select: str, more: str = "") -> str:
    return ",\n" + TREE_SQL + more + "\n" + select


@query("payload_paths", _tree("select event_id, path, type, count(*) as nodes from placed group by all"), _P)
def payload_paths(v):
    return schema.payload_paths(v("payload"))


@query("schema_profile", _tree(PROFILE_SQL.format("placed")), _P)
def schema_profile(v):
    return schema.profile(schema.type_counts(v("payload"))).drop("parent")


def _saved(v):
    """The profile stored from the first half of the feed, and the events after it."""
    payload = v("payload")
    stored = materialise(schema.type_counts(payload.where(F.col("ts") < F.expr(HALF))), "schema")
    return stored, payload.where(F.col("ts") >= F.expr(HALF))


DRIFT_SQL = f""",
before as (select * from placed where ts < {HALF}),
after as (select * from placed where ts >= {HALF}),
prof as ({PROFILE_SQL.format("before")}),
rules as (select p.*, regexp_replace(path, '(\\.[^.\\[\\]]+|\\[\\])$', '') as parent from prof p),
unknown as (select a.event_id, a.resource_kind, count(*) as unknown_nodes from after a left join prof p on a.resource_kind = p.resource_kind and a.path = p.path
  where p.path is null or not (list_contains(string_split(p.types, ','), a.type) or (a.type = 'integer' and list_contains(string_split(p.types, ','), 'number'))) group by all),
wanted as (select a.event_id, a.resource_kind, count(*) as n from after a join rules r on a.resource_kind = r.resource_kind and a.path = r.parent and r.required
  where a.type = 'object' group by all),
found as (select a.event_id, a.resource_kind, count(*) as n from after a join rules r on a.resource_kind = r.resource_kind and a.path = r.path and r.required group by all),
drifting as (select e.event_id, e.resource_kind, coalesce(u.unknown_nodes, 0) as unknown_nodes, coalesce(w.n, 0) - coalesce(f.n, 0) as missing_keys
  from (select distinct event_id, resource_kind from after) e left join unknown u using (event_id, resource_kind) left join wanted w using (event_id, resource_kind)
  left join found f using (event_id, resource_kind) where coalesce(u.unknown_nodes, 0) > 0 or coalesce(w.n, 0) > coalesce(f.n, 0))"""


@query("schema_drift", _tree("select event_id, resource_kind, unknown_nodes, missing_keys from drifting", DRIFT_SQL), _P)
def schema_drift(v):
    stored, later = _saved(v)
    return schema.drift(later, schema.profile(stored))


@query(
    "schema_extend",
    _tree(
        "select resource_kind, path, type, count(*) as nodes, 2 as version from (select * from before union all select a.* from after a join drifting d using (event_id, resource_kind)) group by resource_kind, path, type",
        DRIFT_SQL,
    ),
    _P,
)
def schema_extend(v):
    stored, later = _saved(v)
    misfits = later.join(schema.drift(later, schema.profile(stored)).select("event_id"), "event_id", "left_semi")
    return schema.extend(stored, misfits, 2).select("resource_kind", "path", "type", "nodes", "version")


@query(
    "archive_typed_read",
    """select stream_path, timepoint, resource_kind, data ->> '$.date_of_birth.year' as born, cast(data ->> '$.pages' as double) as pages, data ->> '$.charge_number' as charge_number,
  cast(data ->> '$.can_file' as boolean) as can_file, data ->> '$.cases[0].number' as case_number, data ->> '$.etag' as etag,
  cast(json_array_length(data, '$.sic_codes') as integer) as sic_codes
from payload""",
    ("payload",),
)
def archive_typed_read(v):
    """Two parts, each typed by the profile of its own events; fields that only the later one has, and types that differ, are widened."""
    events = v("payload").withColumn("published_at", F.col("ts"))
    early = F.col("ts") < F.expr("timestamp '2024-01-20 00:00:00'")
    paths, kinds = [], set()
    for keep in (early, ~early):
        part = events.where(keep)
        types = typed.compile_types(schema.profile(materialise(schema.type_counts(part), "profile")))
        paths.append(work_path(v.spark, "typed"))
        kinds |= set(types)
        typed.write_typed(part, types, paths[-1])
    data = [
        F.col("data.date_of_birth.year").cast("string").alias("born"),
        F.col("data.pages").alias("pages"),
        F.col("data.charge_number").alias("charge_number"),
        F.col("data.can_file").alias("can_file"),
        F.col("data.cases").getItem(0)["number"].cast("string").alias("case_number"),
        F.col("data.etag").alias("etag"),
        F.when(F.col("data.sic_codes").isNotNull(), F.size("data.sic_codes")).alias("sic_codes"),
    ]
    return reduce(DataFrame.unionByName, [typed.read_typed(v.spark, paths, k).select("stream_path", "timepoint", "resource_kind", *data) for k in sorted(kinds)])


# The text of each path from the texts one level below it, from the deepest level up.
_DEEPEST = 8
_LEVEL = """
level{0} as (select p.resource_kind, p.path, p.parent, p.name, p.required, '{{"type":' || p.type_text
    || coalesce(',"properties":{{' || k.members || '}}' || case when k.needed is null then '' else ',"required":[' || k.needed || ']' end, '')
    || coalesce(',"items":' || i.text, '') || '}}' as text
  from paths p
  left join (select resource_kind, parent, string_agg('"' || name || '":' || text, ',' order by name) as members,
      string_agg('"' || name || '"', ',' order by name) filter (where required) as needed
    from level{1} where name is not null group by all) k on p.resource_kind = k.resource_kind and p.path = k.parent
  left join level{1} i on p.resource_kind = i.resource_kind and i.path = p.path || '[]'
  where p.depth = {0})"""
SCHEMA_SQL = (
    f""",
prof as ({PROFILE_SQL.format("placed")}),
paths as (select *, regexp_replace(path, '(\\.[^.\\[\\]]+|\\[\\])$', '') as parent, nullif(regexp_extract(path, '\\.([^.\\[\\]]+)$', 1), '') as name,
  len(regexp_extract_all(path, '\\.[^.\\[\\]]+|\\[\\]')) as depth,
  case when types like '%,%' then '["' || replace(types, ',', '","') || '"]' else '"' || types || '"' end as type_text from prof),
level{_DEEPEST} as (select resource_kind, path, parent, name, required, '' as text from paths where depth = {_DEEPEST}),"""
    + ",".join(_LEVEL.format(d, d + 1) for d in range(_DEEPEST - 1, -1, -1))
)


@query("schema_json", _tree('select resource_kind, text as "schema" from level0', SCHEMA_SQL), _P)
def schema_json(v):
    return schema.json_schemas(schema.profile(schema.type_counts(v("payload"))))
