"""Queries over the live feeds: counters, history, liveness, visitors, samples, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from regfeed import feeds
from regfeed.functions import cards, identity, text, timeutil
from regfeed.operators import counts, history, liveness, sample, visitors
from regfeed.plans.registry import query

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
DAY = "'%Y-%m-%d'"

# Company number by feed, written for the oracle. The URI patterns.
CN_SQL = """case stream_path when 'companies' then cn when 'insolvency-cases' then resource_id
    when 'filings' then nullif(regexp_extract(resource_uri, '^/company/([A-Z0-9]{8})/filing-history', 1), '')
    when 'officers' then nullif(regexp_extract(resource_uri, '^/company/([A-Z0-9]{8})/appointments', 1), '')
    when 'persons-with-significant-control' then nullif(regexp_extract(resource_uri, '^/company/([A-Z0-9]{6,8})/persons-with-significant-control', 1), '')
    when 'charges' then nullif(regexp_extract(resource_uri, '^/company/([A-Z0-9]{8})/charges', 1), '')
    when 'persons-with-significant-control-statements' then nullif(regexp_extract(resource_uri, '^/company/([A-Z0-9]{8})/', 1), '')
    when 'company-exemptions' then nullif(regexp_extract(resource_uri, 'company/([A-Z0-9]{8})/exemptions', 1), '')
    else '' end"""


def numbered(v):
    """``ev`` with the company number worked out."""
    return v("ev").withColumn("company_number", identity.company_number(F.col("stream_path"), F.col("resource_uri"), F.col("resource_id"), F.col("cn")))


# --- counters -------------------------------------------------------------------------------------------------------


@query("daily_counts", f"select stream_path, strftime(cast(received as date), {DAY}) as day, count(*) as events from ev group by all", ("ev",))
def daily_counts(v):
    return counts.daily_counts(v("ev"))


@query(
    "resource_kind_counts",
    """select stream_path, resource_kind, count(*) as events, count(*) / sum(count(*)) over (partition by stream_path) as share
from ev group by stream_path, resource_kind""",
    ("ev",),
)
def resource_kind_counts(v):
    return counts.kind_counts(v("ev"))


@query("distinct_kinds", "select distinct resource_kind from ev", ("ev",))
def distinct_kinds(v):
    return counts.distinct_kinds(v("ev"))


@query(
    "daily_series",
    f"""select stream_path, strftime(day, {DAY}) as day, events, row_number() over (partition by stream_path order by day) as position
from (select stream_path, cast(received as date) as day, count(*) as events from ev group by all)""",
    ("ev",),
)
def daily_series(v):
    return counts.daily_series(counts.daily_counts(v("ev")))


@query(
    "daily_count_json",
    f"""select stream_path, '{{' || string_agg('"' || day || '":' || events, ',' order by day) || '}}' as counts
from (select stream_path, strftime(cast(received as date), {DAY}) as day, count(*) as events from ev group by all) group by stream_path""",
    ("ev",),
)
def daily_count_json(v):
    return counts.daily_count_json(counts.daily_counts(v("ev")))


@query(
    "history_qty_resolve",
    """select event_id, quantity, quantity between 1 and 10000 as accepted from (select event_id,
  coalesce(nullif(try_cast(nullif(regexp_extract(qty, '^\\s*([+-]?\\d+)', 1), '') as int), 0), 100) as quantity from requests)""",
    ("requests",),
)
def history_qty_resolve(v):
    return counts.history_requests(v("requests")).select("event_id", "quantity", "accepted")


@query(
    "invalid_feed_requests",
    "select event_id, stream_path, '" + ",".join(feeds.FEEDS) + "' as possible_options from requests where stream_path like 'nosuch-%'",
    ("requests",),
)
def invalid_feed_requests(v):
    return feeds.invalid_requests(v("requests")).select("event_id", "stream_path", "possible_options")


@query("table_names", "select distinct stream_path, regexp_replace(stream_path, '[^a-zA-Z]', '_', 'g') || '_events' as table_name from ev", ("ev",))
def table_names(v):
    return v("ev").select("stream_path").distinct().withColumn("table_name", feeds.table_name(F.col("stream_path")))


# --- log and history ------------------------------------------------------------------------------------------------


@query(
    "event_log",
    """select 'events:' || stream_path as log_key, timepoint || '-' || (row_number() over (partition by stream_path, timepoint order by arrival) - 1) as entry_id,
  arrival from arrivals""",
    ("arrivals",),
)
def event_log(v):
    return history.event_log(v("arrivals")).select("log_key", "entry_id", "arrival")


@query("stream_from_key", "select event_id, stream_path from ev", ("ev",))
def stream_from_key(v):
    keyed = v("ev").select("event_id", feeds.log_key(F.col("stream_path")).alias("key"))
    return keyed.select("event_id", feeds.feed_from_log_key(F.col("key")).alias("stream_path"))


RETAINED = 40


@query(
    "retain_latest_cap",
    f"""select stream_path, timepoint, arrival from (select *, row_number() over (partition by stream_path order by timepoint desc, arrival desc) as r from arrivals)
where r <= {RETAINED}""",
    ("arrivals",),
)
def retain_latest_cap(v):
    return history.retain_latest(v("arrivals"), RETAINED, ties=("arrival",)).select("stream_path", "timepoint", "arrival")


@query("response_log_cap", f"select seq, stream_path, type, strftime(ts, {STAMP}) as ts from responses order by seq desc limit 1000", ("responses",))
def response_log_cap(v):
    return history.newest_responses(v("responses")).select("seq", "stream_path", "type", "ts")


@query(
    "recent_responses",
    """select seq, '{"type":"' || type || '","stream_path":"' || stream_path || '"' || case when headers is null then '' else ',"headers":' || replace(headers, ' ', '') end || '}' as response
from responses order by seq desc limit 20""",
    ("responses",),
)
def recent_responses(v):
    return history.recent_responses(v("responses")).select("seq", "response")


@query(
    "history_latest_n",
    """select stream_path, rank, timepoint, event_id from (select *, row_number() over (partition by stream_path order by timepoint desc) as rank from ev) where rank <= 100""",
    ("ev",),
)
def history_latest_n(v):
    return history.history(v("ev"), 100).select("stream_path", F.col("rank").cast("bigint"), "timepoint", "event_id")


@query(
    "latest_event_per_feed",
    """select stream_path, max(timepoint) as timepoint, arg_max(line, timepoint) as line, true as pretty_matches from event_lines group by stream_path""",
    ("event_lines",),
)
def latest_event_per_feed(v):
    latest = history.latest_event(v("event_lines"), "line")
    same = F.to_json(F.parse_json("pretty")) == F.to_json(F.parse_json("line"))
    return latest.select("stream_path", "timepoint", "line", (same & F.col("pretty").contains("\n")).alias("pretty_matches"))


@query(
    "late_rejects",
    """select stream_path, timepoint, arrival from (select *, max(timepoint) over (partition by stream_path order by arrival rows between unbounded preceding and 1 preceding) as highest
from arrivals) where timepoint < highest""",
    ("arrivals",),
)
def late_rejects(v):
    return history.late_flags(v("arrivals")).where(~F.col("accepted")).select("stream_path", "timepoint", "arrival")


@query(
    "topic_fanout",
    """select stream_path as topic, md5('{"streamPath":"' || stream_path || '",' || substr(line, 2)) as message from event_lines""",
    ("event_lines",),
)
def topic_fanout(v):
    messages = history.topic_messages(v("event_lines"), "line")
    return messages.select("topic", F.md5(F.col("value").cast("binary")).alias("message"))


@query(
    "live_view_at",
    f"""select event_id, stream_path, strftime(received, {STAMP}) as received from ev
where received <= timestamp '2024-01-15 12:00:00' and received + interval 255 second > timestamp '2024-01-15 12:00:00'""",
    ("ev",),
)
def live_view_at(v):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return history.visible_at(v("ev"), at, "00000012").select("event_id", "stream_path", "received")


@query("filter_company_contains", f"select event_id, stream_path, {CN_SQL} as company_number from ev where {CN_SQL} like '%0001%'", ("ev",))
def filter_company_contains(v):
    return history.live_filter(numbered(v), "0001").select("event_id", "stream_path", "company_number")


@query(
    "filter_hidden_page",
    f"select event_id, stream_path, {CN_SQL} as company_number, typed from ev, (values ('0001'), ('00000012')) t(typed) where length(typed) = 8 and contains({CN_SQL}, typed)",
    ("ev",),
)
def filter_hidden_page(v):
    """A hidden page shows nothing for part of a number, and that company's events for a whole one."""
    shown = [history.live_filter(numbered(v), typed, visible=False).withColumn("typed", F.lit(typed)) for typed in ("0001", "00000012")]
    return shown[0].unionByName(shown[1]).select("event_id", "stream_path", "company_number", "typed")


# --- liveness -------------------------------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:30"


@query(
    "cursor_latest",
    f"""select stream_path, arg_max(timepoint, (received, event_id)) as timepoint, strftime(max(received), {STAMP}) as received from ev group by stream_path
having max(received) >= timestamp '{NOW}' - interval 7 day""",
    ("ev",),
)
def cursor_latest(v):
    return liveness.latest_cursor(v("ev"), F.lit(NOW).cast("timestamp_ntz"))


@query("heartbeats", f"select stream_path, strftime(max(received), {STAMP}) as last_seen from raw_lines group by stream_path", ("raw_lines",))
def heartbeats(v):
    return liveness.heartbeats(v("raw_lines"))


@query(
    "feed_health",
    """select f.stream_path, coalesce(epoch_us(n.now) - epoch_us(h.last_seen) < 60 * 1000000, false) as healthy
from (select unnest(string_split('""" + ",".join(feeds.FEEDS) + """', ',')) as stream_path) f
left join (select stream_path, max(received) as last_seen from raw_lines where stream_path <> 'charges' group by stream_path) h on f.stream_path = h.stream_path
join (select max(received) as now from raw_lines) n on true""",
    ("raw_lines",),
)
def feed_health(v):
    # "Now" is the moment of the last sign of life of any feed; one feed is made to have been silent always.
    lines = v("raw_lines")
    now = lines.agg(F.max("received").cast("string")).first()[0]
    return liveness.feed_health(liveness.heartbeats(lines.where(F.col("stream_path") != "charges")), F.lit(now).cast("timestamp_ntz"))


@query("connections_current", "select cast(sum(delta) as bigint) as connections from connections", ("connections",))
def connections_current(v):
    return liveness.connections_current(v("connections"))


@query(
    "connections_running",
    "select event_id, cast(sum(delta) over (order by ts, event_id rows unbounded preceding) as bigint) as connections from connections",
    ("connections",),
)
def connections_running(v):
    return liveness.connections_running(v("connections")).select("event_id", "connections")


@query(
    "publication_delay",
    """select stream_path, round(arg_max(greatest(0.0, (epoch_ms(received) - epoch_ms(ts)) / 60000.0), (received, event_id)), 1) as delay_minutes
from ev group by stream_path""",
    ("ev",),
)
def publication_delay(v):
    return liveness.publication_delay(v("ev"))


# --- visitors -------------------------------------------------------------------------------------------------------


@query("visitors_daily_exact", f"select strftime(day, {DAY}) as day, count(distinct ip) as visitors from visits where day >= date '2023-09-12' and ip is not null group by day", ("visits",))
def visitors_daily_exact(v):
    return visitors.daily_exact(v("visits"))


@query("visitors_daily_bounded", f"select strftime(day, {DAY}) as day, true as within_bound from visits where ip is not null group by day", ("visits",))
def visitors_daily_bounded(v):
    near = visitors.daily_approximate(visitors.daily_sketches(v("visits"))).withColumnRenamed("visitors", "estimate")
    both = visitors.daily_exact(v("visits")).join(near, "day")
    bound = F.greatest(F.lit(1.0), F.col("visitors") * 0.05)
    return both.select("day", (F.abs(F.col("estimate") - F.col("visitors")) <= bound).alias("within_bound"))


@query("visitors_total_merged", "select count(distinct ip) as visitors, true as within_bound from visits", ("visits",))
def visitors_total_merged(v):
    # The two one-row results side by side, by union rather than by a join without a key.
    merged = visitors.total_merged(visitors.daily_sketches(v("visits"))).select(F.lit(None).cast("bigint").alias("visitors"), F.col("visitors").alias("estimate"))
    exact = visitors.total_exact(v("visits")).withColumn("estimate", F.lit(None).cast("bigint"))
    both = exact.unionByName(merged).agg(F.max("visitors").alias("visitors"), F.max("estimate").alias("estimate"))
    bound = F.greatest(F.lit(1.0), F.col("visitors") * 0.05)
    return both.select("visitors", (F.abs(F.col("estimate") - F.col("visitors")) <= bound).alias("within_bound"))


# --- samples --------------------------------------------------------------------------------------------------------


@query("random_companies", f"select distinct company_number, md5(company_number || 'seed') as token from (select {CN_SQL} as company_number from ev where stream_path = 'companies') order by token limit 10", ("ev",))
def random_companies(v):
    return sample.random_companies(sample.company_numbers(numbered(v)), 10, "seed")


@query("company_pool", "select distinct company_number, md5(company_number) as token from (select cn as company_number from ev where stream_path = 'companies') order by token limit 5000", ("ev",))
def company_pool(v):
    return sample.pool(sample.company_numbers(numbered(v)))


@query("company_first_seen", "select cn as company_number, min(event_id) as event_id, count(*) as events from ev where stream_path = 'companies' group by cn", ("ev",))
def company_first_seen(v):
    return sample.first_seen(numbered(v))


@query(
    "company_is_new",
    "select event_id, cn as company_number, event_id = min(event_id) over (partition by cn) as is_new from ev where stream_path = 'companies'",
    ("ev",),
)
def company_is_new(v):
    return sample.mark_new(numbered(v)).select("event_id", "company_number", "is_new")


@query("sample_rows_k", "select event_id, stream_path, md5(cast(event_id as string) || 'seed') as token from ev order by token limit 1000", ("ev",))
def sample_rows_k(v):
    return sample.sample_rows(v("ev").select("event_id", "stream_path"), F.col("event_id"), 1_000, "seed")


# --- functions ------------------------------------------------------------------------------------------------------


@query("company_number", f"select event_id, {CN_SQL} as company_number from ev", ("ev",))
def company_number(v):
    return numbered(v).select("event_id", "company_number")


@query(
    "normalise_published_at",
    """select event_id, case when event_id % 97 = 0 or event_id % 89 = 0 then null else strftime(date_trunc('millisecond',
  case when event_id % 83 = 0 then cast(cast(ts as date) as timestamp) when event_id % 79 = 0 then ts when event_id % 3 = 2 then ts - interval 1 hour else ts end), '%Y-%m-%dT%H:%M:%S.%gZ') end as published_at from published_raw""",
    ("published_raw",),
)
def normalise_published_at(v):
    return v("published_raw").select("event_id", timeutil.iso_millis(timeutil.normalise_timestamp(F.col("published_raw"))).alias("published_at"))


TITLE_SQL = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
SENTENCE_SQL = "(upper(substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), 2))"
FILL_SQL = """array_to_string(list_transform(regexp_extract_all({0}, '\\{{[0-9A-Za-z_]+\\}}|[^{{]+|\\{{'),
    lambda t: case when regexp_full_match(t, '\\{{[0-9A-Za-z_]+\\}}') then coalesce(json_extract_string({1}, '$.' || substr(t, 2, length(t) - 2)), '') else t end), '')"""


@query(
    "case_text",
    "select event_id, " + SENTENCE_SQL.format("resource_uri") + " as sentence, " + TITLE_SQL.format("json_extract_string(data, '$.company_name')") + " as title from payload",
    ("payload",),
)
def case_text(v):
    name = F.get_json_object("data", "$.company_name")
    return v("payload").select("event_id", text.sentence_case(F.col("resource_uri")).alias("sentence"), text.title_case(name).alias("title"))


def _with_variant(v):
    return v("payload").withColumn("data", F.try_parse_json("data"))


@query(
    "template_fill",
    "select event_id, " + FILL_SQL.format("'{k}: ' || resource_kind || ' {value} {missing}{ {k}'", "json_extract(data, '$.description_values')") + " as filled from payload where stream_path = 'filings'",
    ("payload",),
)
def template_fill(v):
    values = F.from_json(F.get_json_object("data", "$.description_values"), "map<string,string>")
    template = F.concat(F.lit("{k}: "), F.col("resource_kind"), F.lit(" {value} {missing}{ {k}"))
    filings = v("payload").where(F.col("stream_path") == "filings")
    return filings.select("event_id", text.fill_template(template, values).alias("filled"))


FILING_SQL = (
    "case when d.template is not null then "
    + FILL_SQL.format("d.template", "json_extract(data, '$.description_values')")
    + """ when json_extract_string(data, '$.description') = 'legacy' then coalesce(json_extract_string(data, '$.description_values.description'), 'legacy')
    else json_extract_string(data, '$.description') end"""
)


@query(
    "describe_filings",
    f"""select event_id, json_extract_string(data, '$.description') as code, {FILING_SQL} as description
from payload p left join dictionary d on json_extract_string(data, '$.description') = d.code where stream_path = 'filings'""",
    ("payload", "dictionary"),
)
def describe_filings(v):
    filings = _with_variant(v).where(F.col("stream_path") == "filings")
    return cards.described(filings, v("dictionary")).select("event_id", "code", F.col("filing_text").alias("description"))


@query(
    "event_cards",
    f"""select event_id, stream_path, {CN_SQL} as company_number,
  coalesce(case stream_path when 'companies' then {TITLE_SQL.format("data->>'$.company_name'")}
    when 'filings' then {SENTENCE_SQL.format("coalesce(data->>'$.category', 'New')")} || ' filing'
    when 'officers' then {TITLE_SQL.format("data->>'$.name'")}
    when 'persons-with-significant-control' then data->>'$.name'
    when 'charges' then data->>'$.classification.description'
    when 'insolvency-cases' then 'Insolvency'
    when 'disqualified-officers' then coalesce(data->>'$.forename', '') || ' ' || coalesce(data->>'$.other_forenames', '') || ' ' || coalesce(data->>'$.surname', '')
    else {TITLE_SQL.format("data->>'$.linked_psc_name'")} end, {TITLE_SQL.format("replace(stream_path, '-', ' ')")}) as title,
  case stream_path when 'companies' then '' when 'filings' then {FILING_SQL}
    when 'officers' then case when json_exists(data, '$.resigned_on') then 'Resigned on ' || coalesce(data->>'$.resigned_on', 'null') else 'Appointed on ' || (data->>'$.appointed_on') end
    when 'persons-with-significant-control' then case when json_exists(data, '$.ceased_on') then 'Ceased on ' || (data->>'$.ceased_on') else 'Notified on ' || (data->>'$.notified_on') end
    when 'charges' then data->>'$.particulars.description'
    when 'insolvency-cases' then array_to_string(list_transform(json_extract_string(data, '$.cases[*].type'), lambda c: {SENTENCE_SQL.format("c")}), ', ')
    when 'disqualified-officers' then 'Disqualified from ' || array_to_string(json_extract_string(data, '$.disqualifications[*].company_names[*]'), ', ')
    when 'company-exemptions' then 'Company exemptions descriptions not yet developed'
    else 'PSC statement descriptions not yet developed' end as description
from payload p left join dictionary d on stream_path = 'filings' and json_extract_string(data, '$.description') = d.code""",
    ("payload", "dictionary"),
)
def event_cards(v):
    return cards.cards(_with_variant(v), v("dictionary")).select("event_id", "stream_path", "company_number", "title", "description")

