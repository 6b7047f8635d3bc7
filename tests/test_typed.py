"""Typed tables: compiled types, widening, parts under different profiles, files that are not alike."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed.operators import schema, typed
from regfeed.session import work_path

EVENTS = "stream_path string, timepoint bigint, published_at timestamp_ntz, resource_kind string, data string"


def events(spark, payloads, kind="k", start=0):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("f", start + n, at, kind, p if p is None or isinstance(p, str) else json.dumps(p)) for n, p in enumerate(payloads)], EVENTS)


def types_of(rows):
    return typed.compile_types(schema.profile(schema.type_counts(rows)))


def test_types_are_compiled_from_the_profile(spark):
    rows = events(spark, [{"a": 1, "b": {"c d": True, "e": [1, 2.5]}, "n": None, "x": 1, "A b": {}, "same": {"q": 1, "Q": 2}}, {"a": "t", "x": 2.5, "z": [{"w": 1}, {"v": "s"}]}])
    rows = rows.unionByName(events(spark, [[1, 2]], "list")).unionByName(events(spark, ["7"], "number"))
    got = types_of(rows)
    assert got["k"].simpleString() == "struct<A b:string,a:string,b:struct<c d:boolean,e:array<double>>,n:string,same:string,x:double,z:array<struct<v:string,w:bigint>>>"
    assert got["list"] == T.ArrayType(T.LongType()) and got["number"] == T.LongType()
    assert typed.compile_types(schema.profile(schema.type_counts(rows.limit(0)))) == {}


def test_parts_under_other_profiles_are_widened(spark):
    one = events(spark, [{"a": 1, "l": [1], "s": {"x": 1}}, "broken", None])
    two = events(spark, [{"a": 2.5, "l": [{"y": True}], "s": {"x": "t", "y": None}, "new": "n"}], start=10).unionByName(events(spark, [{"o": 1}], "other", 20))
    paths = [work_path(spark, "one"), work_path(spark, "two")]
    for rows, path in zip((one, two), paths, strict=True):
        typed.write_typed(rows, types_of(rows), path)
    got = {r.timepoint: r for r in typed.read_typed(spark, paths, "k").collect()}
    assert sorted(got) == [0, 1, 2, 10]
    assert (got[0].data.a, got[0].data.l, got[0].data.s.x, got[0].data.s.y, got[0].data.new) == (1.0, ["1"], "1", None, None)
    assert (got[10].data.a, got[10].data.l, got[10].data.s.x, got[10].data.new) == (2.5, ['{"y":true}'], "t", "n")
    assert got[2].data is None and not got[2].unread
    assert got[1].data is None and got[1].unread and got[1].text == "broken"
    assert typed.read_typed(spark, paths, "other").select("data.o").collect()[0].o == 1
    unknown = typed.read_typed(spark, paths, "nothing")
    assert unknown.count() == 0


def test_unknown_kinds_keep_their_text(spark):
    rows = events(spark, [{"a": 1}], "known").unionByName(events(spark, [{"b": 1}], "new", 5))
    types = types_of(rows.where("resource_kind = 'known'"))
    assert list(typed._columns(["a", "A", "b"])) == ["A", "b"]
    got = {r.timepoint: r for r in typed.typed(rows, types).collect()}
    assert not got[0].unread and got[0].text is None and got[0].data_known.a == 1
    assert got[5].unread and json.loads(got[5].text) == {"b": 1}


def test_unlike_files_under_one_schema(spark):
    paths = [work_path(spark, n) for n in "abc"]
    spark.sql("select 1 as id, 'x' as extra, named_struct('p', 1, 'q', 2) as s").write.parquet(paths[0])
    spark.sql("select 2L as id, 2.5D as amount, named_struct('q', '3') as s").write.parquet(paths[1])
    spark.sql("select 'z' as id, 7 as amount").write.parquet(paths[2])
    got = typed.register_unlike(spark, paths, "id bigint, amount double, s struct<q: bigint, r: string>").orderBy(F.col("id").asc_nulls_last()).collect()
    assert [(r.id, r.amount, r.s and tuple(r.s)) for r in got] == [(1, None, (2, None)), (2, 2.5, (3, None)), (None, 7.0, None)]
