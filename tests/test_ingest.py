"""Typed ingest of JSON lines: whole-file types per kind, and every key that was sent."""

import json
from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries
from regfeed import fixtures
from regfeed.sources import ndjson


def test_query_and_sql_count_every_key(spark, sf_dir):
    """both left out keys with a JSON null."""
    wanted = Counter()
    nulls = 0
    for kind, line in fixtures.view(spark, sf_dir, "event_lines").select("resource_kind", "line").collect():
        data = json.loads(line)["data"]
        wanted.update((kind, key) for key in data)
        nulls += sum(value is None for value in data.values())
    assert nulls
    got = queries()["ndjson_infer_ingest"](spark, sf_dir)
    assert {(r.resource_kind, r.column_name): r.filled for r in got.collect()} == wanted
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    sql = con.execute(f"select resource_kind, column_name, filled from ({oracle_sql()['ndjson_infer_ingest']})").fetchall()
    assert {(kind, key): n for kind, key, n in sql} == wanted


ODD = [
    ("a/b=1", '{"data":{"n":null,"e":{},"x.y":1,"`":2,"":3,"sent":4}}'),
    ("a/b=1", '{"data":{"n":null,"x.y":2.5}}'),
    ("01", '{"data":{"n":1}}'),
    ("1", '{"data":{"n":"one"}}'),
    ("", '{"data":{"n":true}}'),
    (None, '{"data":{"k":null}}'),
    ("no payload", '{"x":1}'),
    ("text", '{"data":"{\\"k\\":1}"}'),
    ("text", '{"data":{"k":1}}'),
    ("text", '{"data":null}'),
    ("twice", '{"data":{"k":1,"k":null},"x":1}'),
    ("twice", '{"data":{"k":3,"K":4}}'),
    ("array", '[{"data":{"k":1}}]'),
    ("array", '{"data":[{"k":1}]}'),
    ("bad", '{"data":{"k":1},"b'),
    ("bad", '{"data":{"k":1}}'),
    ("empty", None),
    ("empty", ""),
]


def test_odd_kinds_and_keys(spark):
    tables = ndjson.ingest(spark.createDataFrame(ODD, "resource_kind string, line string"))
    assert set(tables) == {kind for kind, _ in ODD}
    got = {(r.resource_kind, r.column_name): r.filled for r in ndjson.sent_keys(spark, tables).collect()}
    once = {("a/b=1", key): 1 for key in ("e", "`", "", "sent")}
    assert got == once | {
        ("a/b=1", "n"): 2,
        ("a/b=1", "x.y"): 2,
        ("01", "n"): 1,
        ("1", "n"): 1,
        ("", "n"): 1,
        (None, "k"): 1,
        ("text", "k"): 1,
        ("twice", "k"): 3,
        ("twice", "K"): 1,
        ("bad", "k"): 1,
    }
    # As DuckDB, which fails on lines that are not JSON.
    con = duckdb.connect()
    con.execute("create table odd (resource_kind varchar, line varchar)")
    con.executemany("insert into odd values (?, ?)", ODD)
    sql = "select resource_kind, k, count(*) from (select resource_kind, unnest(json_keys(line, '$.data')) as k from odd where json_valid(line)) group by all"
    assert got == {(kind, key): n for kind, key, n in con.execute(sql).fetchall()}


def test_kinds_have_types_of_their_own(spark):
    tables = ndjson.ingest(spark.createDataFrame(ODD, "resource_kind string, line string"))
    types = {kind: tables[kind].schema["record"].dataType["data"].dataType["n"].dataType.simpleString() for kind in ("a/b=1", "01", "1", "")}
    assert types == {"a/b=1": "string", "01": "bigint", "1": "string", "": "boolean"}
    rows = tables["a/b=1"].selectExpr("record.data.`x.y` as v", "size(sent) as sent").collect()
    assert sorted(tuple(r) for r in rows) == [(1.0, 6), (2.5, 2)]


def test_no_lines(spark):
    tables = ndjson.ingest(spark.createDataFrame([], "resource_kind string, line string"))
    assert tables == {} and ndjson.sent_keys(spark, tables).collect() == []
