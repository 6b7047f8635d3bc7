"""Views over the test tables that stand in for the nine feeds.

One SQL text per view, run by Spark here and used as a CTE by the oracle queries, so both sides start from the
same rows. All of them read their whole table. ``damaged`` and ``arrivals`` remove or repeat rows on purpose: they are
the faults that the audit and the late-row check must find.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from regfeed.session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_COMPANY = """'{"company_name":"ACME O''NEILL (' || cast(user_id as string) || ') TRADING-CO LTD","company_number":"' || cn
    || '","can_file":' || case when event_id % 2 = 0 then 'true' else 'false' end
    || ',"accounts":{"accounting_reference_date":{"day":"30","month":' || case when event_id % 7 = 0 then '"09"' else '9' end || '}'
    || case when event_id % 4 = 0 then ',"overdue":false' else '' end || '},"sic_codes":["45200","' || cast(10000 + user_id as string) || '"]'
    || late || '}'"""
_FILING = """'{' || case when event_id % 5 = 0 then '' else '"category":"' || case when event_id % 3 = 0 then 'confirmation-statement' else 'accounts' end || '",' end
    || '"description":"' || case when resource_kind = 'signup' and event_id % 2 = 0 then 'legacy' else resource_kind end
    || '","description_values":{' || case when event_id % 4 = 1 then '"description":"Old form ' || cast(user_id as string) || '",' else '' end
    || '"k":"' || cast(user_id as string) || '","value":"{k}"},"pages":' || case when event_id % 7 = 0 then '2.5' else '2' end || late || '}'"""
_OFFICER = """'{"name":"SMITH, JOHN ' || cast(user_id as string) || '","officer_role":"director","appointed_on":"2020-01-02"'
    || case when event_id % 2 = 1 then ',"resigned_on":"2024-01-03"' when event_id % 20 = 2 then ',"resigned_on":null' else '' end
    || ',"date_of_birth":{"month":' || cast(1 + user_id % 12 as string) || ',"year":1970},"address":{"locality":"Norwich"}' || late || '}'"""
_PSC = """'{"name":"Ms Ann ' || cast(user_id as string) || '","natures_of_control":["ownership-of-shares-25-to-50-percent","voting-rights"],"notified_on":"2021-05-06"'
    || case when event_id % 2 = 1 then ',"ceased_on":"2024-02-03"' else '' end || late || '}'"""
_CHARGE = """'{"charge_number":' || case when event_id % 7 = 0 then '"' || cast(user_id as string) || '"' else cast(user_id as string) end
    || ',"classification":{"description":"A registered charge ' || cast(user_id as string) || '","type":"charge-description"}'
    || case when event_id % 2 = 0 then ',"particulars":{"description":"Land at plot ' || cast(user_id as string) || '"}' else '' end
    || ',"persons_entitled":[{"name":"Bank"}]' || late || '}'"""
_CASE = """'{"type":"creditors-voluntary-liquidation","number":' || case when event_id % 7 = 0 then '"1"' else '1' end
    || ',"dates":[{"date":"2023-01-02","type":"wound-up-on"}],"practitioners":[{"name":"P","address":{"address_line_1":"1 Road"}'
    || case when event_id % 2 = 0 then ',"appointed_on":"2023-02-03"' else '' end || '}]}'"""
_INSOLVENCY = f"""'{{"cases":[' || {_CASE} || case when event_id % 2 = 1 then ',{{"type":"administration-order","number":2,"dates":[],"practitioners":[]}}' else '' end
    || ']' || late || '}}'"""
_DISQUALIFIED = """'{"forename":"Jo' || cast(user_id as string) || '"' || case when event_id % 2 = 0 then ',"other_forenames":"Lee"' else '' end || ',"surname":"DOE"'
    || case when event_id % 4 = 0 then '' else ',"disqualifications":[{"company_names":["ALPHA LTD","BETA LTD"]},{"company_names":["GAMMA ' || cast(user_id as string) || '"]}]' end
    || late || '}'"""
_EXEMPTION = """'{"kind":"exemptions","exemptions":{"disclosure_' || cast(user_id % 3 as string) || '":{"items":[{"exempt_from":"2022-10-24"}]}}' || late || '}'"""
_STATEMENT = """'{"linked_psc_name":"MR BOB ' || cast(user_id as string) || '","statement":"psc-exists-but-not-identified"' || late || '}'"""

# Registered in this order; each may use the ones before it.
VIEWS: dict[str, str] = {
    # Nine feeds, each gap-free from 0; arrival is ts plus whole seconds of value.
    "ev0": """select event_id, ts, user_id, event_type as resource_kind, value, props,
  case event_id % 9 when 0 then 'companies' when 1 then 'filings' when 2 then 'officers' when 3 then 'persons-with-significant-control'
    when 4 then 'charges' when 5 then 'insolvency-cases' when 6 then 'disqualified-officers' when 7 then 'company-exemptions'
    else 'persons-with-significant-control-statements' end as stream_path,
  cast(floor(event_id / 9) as bigint) as timepoint,
  case when event_id % 50 = 49 then 'bad-' || cast(user_id as string) else lpad(cast(user_id as string), 8, '0') end as cn,
  ts + cast(floor(value) as bigint) * interval '1' second as received
from events""",
    "ev": """select *, case stream_path when 'companies' then '/company/' || cn when 'filings' then '/company/' || cn || '/filing-history/' || cast(event_id as string)
    when 'officers' then '/company/' || cn || '/appointments/' || cast(event_id as string)
    when 'persons-with-significant-control' then '/company/' || cn || '/persons-with-significant-control/individual/' || cast(event_id as string)
    when 'charges' then '/company/' || cn || '/charges/' || cast(event_id as string)
    when 'insolvency-cases' then '/company/' || cn || '/insolvency'
    when 'disqualified-officers' then '/disqualified-officers/natural/' || cast(event_id as string)
    when 'company-exemptions' then 'company/' || cn || '/exemptions'
    else '/company/' || cn || '/persons-with-significant-control-statements/' || cast(event_id as string) end as resource_uri,
  case when stream_path in ('companies','insolvency-cases','company-exemptions') then cn else cast(event_id as string) end as resource_id
from ev0""",
    # A gap-free feed whose published dates are unrelated to key order.
    "orders_feed": """select 'orders' as stream_path, o_orderkey as timepoint, o_orderstatus as resource_kind,
  lpad(cast(o_custkey as string), 8, '0') as cn, o_orderdate as ts from orders""",
    # Repeating keys; no column set short of all columns is unique, so "first" is the order by all of them.
    "dup_feed": """select l_orderkey as timepoint, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate as ts from lineitem""",
    # Missing rows, single repeats, one whole repeated day, and rows moved to the next day.
    "damaged": """select stream_path, timepoint, cast(ts as date) as day from ev where event_id % 997 <> 0
union all select stream_path, timepoint, cast(ts as date) from ev where event_id % 1009 = 0
union all select stream_path, timepoint, cast(ts as date) from ev where cast(ts as date) = date '2024-01-10'
union all select stream_path, timepoint, date '2024-01-21' from ev where cast(ts as date) = date '2024-01-20' and event_id % 11 = 0""",
    # Every event once, and some again, late.
    "arrivals": """select stream_path, timepoint, event_id * 2 as arrival from ev
union all select stream_path, timepoint, event_id * 2 + 181 as arrival from ev where event_id % 37 = 0""",
    "raw_lines": """select event_id, stream_path, received, case when event_id % 103 = 0 then 'blank' when event_id % 101 = 0 then 'truncated'
  when event_id % 107 = 0 then 'array' when event_id % 109 = 0 then 'null' else 'ok' end as shape from ev""",
    "responses": """select event_id as seq, stream_path, ts, case when event_id % 2 = 0 then 'response_started' else 'response_ended' end as type,
  case when event_id % 2 = 0 then props end as headers from ev""",
    "connections": """select event_id, ts, case resource_kind when 'signup' then 1 when 'error' then -1 when 'purchase' then 2 when 'click' then -2 else 0 end as delta from ev""",
    "visits": """select case when event_id % 211 = 0 then null else cast(user_id as string) end as ip, cast(ts as date) as day from ev""",
    "dictionary": """select * from (values ('click','clicked item {k}'),('view','viewed item {k} for {value}'),('purchase','bought {k} {missing}')) as t(code, template)""",
    # A field that only appears late in the feed, so that schemas drift.
    "payload0": """select *, case when ts >= timestamp '2024-01-20 00:00:00' and event_id % 13 = 0 then ',"etag":"e' || cast(event_id as string) || '"' else '' end as late from ev""",
    "payload": f"""select event_id, ts, user_id, resource_kind, stream_path, timepoint, cn, received, resource_uri, resource_id,
  case stream_path when 'companies' then {_COMPANY}
    when 'filings' then {_FILING}
    when 'officers' then {_OFFICER}
    when 'persons-with-significant-control' then {_PSC}
    when 'charges' then {_CHARGE}
    when 'insolvency-cases' then {_INSOLVENCY}
    when 'disqualified-officers' then {_DISQUALIFIED}
    when 'company-exemptions' then {_EXEMPTION}
    else {_STATEMENT} end as data
from payload0""",
    # The whole event as one JSON line.
    "event_lines": """select event_id, stream_path, timepoint, resource_kind, ts, received,
  '{"resource_kind":"' || resource_kind || '","resource_uri":"' || resource_uri || '","resource_id":"' || resource_id
    || '","event":{"timepoint":' || cast(timepoint as string) || ',"published_at":"' || replace(cast(ts as string), ' ', 'T') || '","type":"changed"},"data":' || data || '}' as line
from payload""",
    # Lines as they come over the wire.
    "raw_text": """select l.event_id, l.stream_path, l.received, r.shape, case r.shape when 'blank' then '' when 'null' then 'null'
    when 'truncated' then substr(l.line, 1, cast(floor(length(l.line) / 2) as int)) when 'array' then '[' || l.line || ']' else l.line end as line
from event_lines l join raw_lines r on l.event_id = r.event_id""",
    # Buffered events of all sources: nine feeds and one with out-of-order dates.
    "buffered": """select stream_path, timepoint, ts as published_at, resource_kind, line as event_data from event_lines
union all select stream_path, timepoint, ts, resource_kind,
  '{"resource_kind":"' || resource_kind || '","event":{"timepoint":' || cast(timepoint as string) || '},"data":{"company_number":"' || cn || '"}}' from orders_feed""",
    # Published timestamps in the three written forms, plus junk and a negative zone.
    "published_raw": """select event_id, ts, case when event_id % 97 = 0 then 'junk' when event_id % 89 = 0 then replace(cast(ts as string), ' ', 'T') || '-05:00'
  when event_id % 83 = 0 then cast(cast(ts as date) as string) when event_id % 79 = 0 then cast(ts as string)
  when event_id % 3 = 0 then replace(cast(ts as string), ' ', 'T') when event_id % 3 = 1 then replace(cast(ts as string), ' ', 'T') || 'Z'
  else replace(cast(ts as string), ' ', 'T') || '+01:00' end as published_raw from ev""",
    # History requests as typed by callers.
    "requests": """select event_id, case when event_id % 10 = 9 then 'nosuch-' || stream_path else stream_path end as stream_path,
  case event_id % 8 when 0 then null when 1 then 'abc' when 2 then '0' when 3 then ' 25 items' when 4 then '-5' when 5 then '10001' when 6 then '10000'
    else cast(user_id as string) end as qty from ev""",
}

# Which earlier views each view reads, for building oracle CTEs.
_NEEDS = {
    "ev": ["ev0"],
    "payload0": ["ev"],
    "payload": ["payload0"],
    "event_lines": ["payload"],
    "raw_text": ["event_lines", "raw_lines"],
    "buffered": ["event_lines", "orders_feed"],
}
_OVER_EV = ("damaged", "arrivals", "raw_lines", "responses", "connections", "visits", "published_raw", "requests")


def _closure(names: list[str]) -> list[str]:
    wanted: set[str] = set()
    stack = list(names)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack += _NEEDS.get(name, ["ev"] if name in _OVER_EV else [])
    return [v for v in VIEWS if v in wanted]


def with_views(*names: str) -> str:
    """``with a as (...), b as (...)`` for the oracle."""
    return "with " + ",\n".join(f"{v} as ({VIEWS[v]})" for v in _closure(list(names)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the tables in ``sf_dir``."""
    tune(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(name) + f"\nselect * from {name}"
    for table in ("events", "orders", "lineitem"):
        sql, used = re.subn(rf"from {table}(?![a-z_])", f"from src_{table}", sql)
        if used:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"src_{table}")
    return spark.sql(sql)
