"""Operators against brute force in plain Python, with skewed inputs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from regfeed import feeds
from regfeed.operators import audit, buffer, counts, history, sample, scan, schema, topn, visitors
from regfeed.functions.text import sentence_case
from regfeed.session import broadcast_if_small, materialise, shared_dir
from regfeed.sources import chunks, cursors, ndjson


def skewed(n=3000, seed=1):
    """(feed, timepoint, arrival): half of all rows in one feed, a third of all rows copies of one position."""
    rnd = random.Random(seed)
    rows = []
    for arrival in range(n):
        feed = "companies" if rnd.random() < 0.5 else rnd.choice(feeds.FEEDS[1:])
        position = 7 if rnd.random() < 0.33 else rnd.randrange(n)
        rows.append((feed, position, arrival))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return materialise(spark.createDataFrame(skewed(), "stream_path string, timepoint bigint, arrival bigint").repartition(6), "skewed")


def test_running_total_and_max(spark, log):
    total = {r.arrival: r.total for r in scan.running_total(log, ["stream_path"], ["arrival"], F.col("timepoint"), "total", buckets=8).collect()}
    highest = {r.arrival: r.highest for r in scan.max_before(log, ["stream_path"], ["arrival"], "timepoint", "highest", buckets=8).collect()}
    sums, tops, want_sum, want_top = {}, {}, {}, {}
    for feed, position, arrival in sorted(skewed(), key=lambda r: r[2]):
        want_top[arrival] = tops.get(feed)
        sums[feed] = sums.get(feed, 0) + position
        tops[feed] = max(tops.get(feed, position), position)
        want_sum[arrival] = sums[feed]
    assert total == want_sum
    assert highest == want_top


def test_one_group_spans_all_buckets(spark):
    df = spark.range(5000).withColumn("g", F.lit("all"))
    got = scan.running_total(df, ["g"], ["id"], F.lit(1), "n", buckets=8)
    assert got.where(F.col("n") != F.col("id") + 1).count() == 0
    assert got.count() == 5000
    held = scan.into_buckets(df, ["g"], ["id"], buckets=8)
    sizes = [r["count"] for r in held.groupBy(scan.BUCKET).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 5000 / 3


def test_event_log_numbers_copies_of_a_hot_position(spark, log):
    numbered = scan.running_number(log, ["stream_path", "timepoint"], ["arrival"], "seq", buckets=8)
    split = {r.arrival: f"{r.timepoint}-{r.seq}" for r in numbered.collect()}
    got = {r.arrival: r.entry_id for r in history.event_log(log).collect()}
    assert got == split
    seen, want = {}, {}
    for feed, position, arrival in sorted(skewed(), key=lambda r: r[2]):
        seq = seen.get((feed, position), 0)
        seen[(feed, position)] = seq + 1
        want[arrival] = f"{position}-{seq}"
    assert got == want


@pytest.mark.parametrize("newest", [True, False])
@pytest.mark.parametrize("n,width", [(1, 65_536), (50, 16), (500, 100), (10_000, 7)])
def test_first_rows(spark, log, newest, n, width):
    got = topn.first_rows(log, ["stream_path"], "timepoint", n, ties=("arrival",), newest=newest, zone_width=width)
    by_feed = {}
    for row in skewed():
        by_feed.setdefault(row[0], []).append(row)
    want = {r for rows in by_feed.values() for r in sorted(rows, key=lambda r: (r[1], r[2]), reverse=newest)[:n]}
    assert {(r.stream_path, r.timepoint, r.arrival) for r in got.collect()} == want


def test_first_rows_without_group_and_empty(spark, log):
    got = [(r.timepoint, r.arrival) for r in topn.first_rows(log, [], "timepoint", 20, ties=("arrival",), zone_width=50).collect()]
    assert got == sorted(((r[1], r[2]) for r in skewed()), reverse=True)[:20]
    assert topn.first_rows(log.where("false"), [], "timepoint", 20).count() == 0
    assert topn.first_rows(log.where("false"), ["stream_path"], "timepoint", 20).count() == 0


def test_newest_rows_reach_the_scan_as_a_filter(spark, log):
    plan = history.history(log, 3, "companies", ties=("arrival",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan.split("PushedFilters")[1]


def test_many_groups_are_cut_by_join(spark):
    df = spark.range(2000).select((F.col("id") % 200).cast("string").alias("g"), F.col("id").alias("p"))
    got = topn.first_rows(df, ["g"], "p", 2, zone_width=10)
    assert {(r.g, r.p) for r in got.collect()} == {(str(g), p) for g in range(200) for p in (g + 1800, g + 1600)}


def test_first_of_each_keeps_the_earliest(spark, log):
    got = {(r.stream_path, r.timepoint): r.arrival for r in buffer.first_of_each(log, buffer.KEY, ["arrival"]).collect()}
    want = {}
    for feed, position, arrival in skewed():
        want[(feed, position)] = min(arrival, want.get((feed, position), arrival))
    assert got == want


def test_insert_ignore_is_idempotent_and_reads_only_the_span(spark, log):
    low = materialise(buffer.first_of_each(log.where("timepoint < 1500"), buffer.KEY, ["arrival"]), "held")
    fresh = materialise(buffer.insert_ignore(log.where("timepoint >= 1000"), low, buffer.KEY, ["arrival"]), "fresh")
    whole = low.unionByName(fresh)
    assert whole.count() == log.select(*buffer.KEY).distinct().count()
    assert buffer.insert_ignore(log, whole, buffer.KEY, ["arrival"]).count() == 0
    assert buffer.insert_ignore(log.where("false"), whole, buffer.KEY, ["arrival"]).count() == 0


def test_late_rows_against_held_maximum(spark):
    rows = [("companies", 5, 1), ("companies", 7, 2), ("companies", 7, 3), ("companies", 6, 4), ("filings", 1, 1)]
    arrivals = spark.createDataFrame(rows, "stream_path string, timepoint bigint, arrival bigint")
    held = spark.createDataFrame([("companies", 6)], "stream_path string, timepoint bigint")
    got = {(r.stream_path, r.arrival): r.accepted for r in history.late_flags(arrivals, held).collect()}
    assert got == {("companies", 1): False, ("companies", 2): True, ("companies", 3): True, ("companies", 4): False, ("filings", 1): True}


def test_resume_and_next_batch(spark):
    rows = [("companies", i) for i in range(10)] + [("filings", i) for i in range(5)]
    log = spark.createDataFrame(rows, "stream_path string, timepoint bigint")
    stored = spark.createDataFrame([("companies", 6)], "stream_path string, timepoint bigint")
    assert sorted(r.timepoint for r in cursors.resume(log, stored).collect()) == [7, 8, 9]
    batch = cursors.next_batch(log, stored, size=2)
    assert sorted((r.stream_path, r.timepoint) for r in batch.collect()) == [("companies", 7), ("companies", 8), ("filings", 0), ("filings", 1)]


LINES = ["a", "", "  ", "long line " * 9, "é✓ text", "z"]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 100_000])
def test_chunk_size_does_not_matter(spark, size):
    rows = [(f, i, line) for f in ("companies", "filings") for i, line in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "stream_path string, timepoint bigint, line string")
    pieces = chunks.cut(lines, size)
    assert pieces.where(F.length("chunk") > size).count() == 0
    got = sorted((r.stream_path, r.line_no, r.line) for r in chunks.reassemble(pieces, buckets=5).collect())
    assert got == sorted(r for r in rows if r[2].strip())


def test_last_record_without_newline(spark):
    pieces = spark.createDataFrame([("companies", 0, '{"a":'), ("companies", 1, '1}\n{"b"'), ("companies", 2, ":2}")], "stream_path string, seq bigint, chunk string")
    assert sorted(r.line for r in chunks.reassemble(pieces).collect()) == ['{"a":1}', '{"b":2}']


def test_parse_and_quarantine(spark):
    texts = ['{"a":1}', " {} ", "[1]", "null", "7", '"s"', '{"a":', "not json", "", "   "]
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    good, bad = ndjson.split_quarantine(lines)
    assert sorted(r.line for r in good.select("line").collect()) == [" {} ", '{"a":1}']
    assert {r.line: r.reject_reason for r in bad.collect()} == {
        "[1]": "not_object", "null": "not_object", "7": "not_object", '"s"': "not_object", '{"a":': "syntax", "not json": "syntax"
    }


def test_unreadable_timestamp_goes_to_quarantine(spark):
    lines = ['{"resource_kind":"k","event":{"timepoint":1,"published_at":"2024-01-01T00:00:00"}}', '{"event":{"timepoint":2,"published_at":"x"}}']
    good, bad = buffer.normalised(ndjson.envelope(spark.createDataFrame([(t,) for t in lines], "line string")))
    assert [r.timepoint for r in good.collect()] == [1]
    assert [r.timepoint for r in bad.collect()] == [2]


# Per day: status and boundary, every branch once.
AUDIT = {
    1: ([1, 2, 3], "ok", "first"),
    2: ([4, 5, 6], "ok", "ok"),
    3: ([8, 9], "ok", "gap"),
    4: ([10, 12], "missing", "ok"),
    5: ([13, 14, 13, 14], "duplicate_files", "ok"),
    6: ([15, 16, 16], "duplicate_events", "ok"),
    7: ([16, 17], "ok", "overlap"),
    8: ([18, 19], "ok", "ok"),
    9: ([20], "ok", "ok"),
}


def test_audit_branches(spark):
    rows = [("companies", p, dt.date(2024, 1, day)) for day, (positions, _, _) in AUDIT.items() for p in positions]
    days = audit.report(spark.createDataFrame(rows, "stream_path string, timepoint bigint, day date"))
    got = {r.day.day: (r.status, r.boundary) for r in days.collect()}
    assert got == {day: (status, boundary) for day, (_, status, boundary) in AUDIT.items()}
    assert audit.correct_total(days).first().correct_events == 3


def test_audit_by_year_month_day(spark):
    rows = [("companies", p, 2024, 1, d) for p, d in [(1, 1), (2, 1), (3, 2), (5, 2)]]
    days = audit.daily_from_parts(spark.createDataFrame(rows, "stream_path string, timepoint bigint, year int, month int, day int"))
    assert {(str(r.day), r.events, r.span) for r in days.collect()} == {("2024-01-01", 2, 2), ("2024-01-02", 2, 3)}


def test_audit_ends_on_a_bad_day(spark):
    rows = [("companies", p, dt.date(2024, 1, d)) for p, d in [(1, 1), (2, 1), (3, 2), (5, 2)]]
    days = audit.report(spark.createDataFrame(rows, "stream_path string, timepoint bigint, day date"))
    assert audit.correct_total(days).first().correct_events == 0


def flatten(value, path="$", parent=None):
    """Nodes of a payload in plain Python."""
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(value)]
    yield parent, path, kind
    if kind == "object":
        for key, child in value.items():
            yield from flatten(child, f"{path}.{key}", path)
    elif kind == "array":
        for child in value:
            yield from flatten(child, path + "[]", path)


PAYLOADS = [
    {"a": 1, "b": {"c": [1, 2.5, "x"], "d": None}, "e": []},
    {"a": 1.5, "b": {"c": [], "f": True}},
    {"a": 2, "b": {"c": [[1], [{"g": 1}]]}, "e": [{"h": 1}, {"h": 2, "i": "s"}]},
]


def payloads(spark, values, kind="k"):
    return spark.createDataFrame([(i, kind, json.dumps(v)) for i, v in enumerate(values)], "event_id int, resource_kind string, data string")


def test_profile_matches_plain_python(spark):
    got = {r.path: (r.types, r.present, r.required) for r in schema.profile(schema.type_counts(payloads(spark, PAYLOADS))).collect()}
    seen, objects = {}, {}
    for parent, path, kind in (n for v in PAYLOADS for n in flatten(v)):
        seen.setdefault(path, [parent, set(), 0])
        seen[path][1].add(kind)
        seen[path][2] += 1
        objects[path] = objects.get(path, 0) + (kind == "object")
    want = {}
    for path, (parent, kinds, present) in seen.items():
        if "number" in kinds:
            kinds.discard("integer")
        want[path] = (",".join(sorted(kinds)), present, parent is not None and not path.endswith("[]") and present == objects[parent])
    assert got == want


def test_profile_merge_is_order_free(spark):
    parts = [schema.type_counts(payloads(spark, [v])) for v in PAYLOADS]
    whole = sorted(map(tuple, schema.type_counts(payloads(spark, PAYLOADS)).collect()), key=str)
    for order in ([0, 1, 2], [2, 0, 1]):
        assert sorted(map(tuple, schema.merge_counts(*[parts[i] for i in order]).collect()), key=str) == whole


def test_drift(spark):
    saved = schema.profile(schema.type_counts(payloads(spark, [{"a": 1.5, "b": {"c": "x"}}, {"a": 2, "b": {"c": "y", "d": 1}}])))
    events = [
        {"a": 3, "b": {"c": "z"}},  # fits: an integer is a number
        {"a": "s", "b": {"c": "z"}},  # wrong type
        {"b": {"c": "z"}},  # required key missing
        {"a": 1, "b": {}},  # required key missing below
        {"a": 1, "b": {"c": "z", "new": 1}},  # unknown key
    ]
    got = {r.event_id: (r.unknown_nodes, r.missing_keys) for r in schema.drift(payloads(spark, events), saved).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (1, 0)}
    assert schema.drift(payloads(spark, events[:1], kind="other"), saved).count() == 1


def test_odd_keys_do_not_collide(spark):
    counted = schema.type_counts(payloads(spark, [{"a.b": 1, "a": {"b": "x"}, "c[]": True, 'q"': 1}]))
    got = json.loads(schema.json_schemas(schema.profile(counted)).first().schema)
    assert set(got["properties"]) == {"a.b", "a", "c[]", 'q"'}
    assert got["properties"]["a"]["properties"] == {"b": {"type": "string"}}


def test_deep_payloads_take_further_passes(spark):
    deep = 1
    for _ in range(25):
        deep = {"a": [deep]}
    rows = payloads(spark, [deep, {"b": 1}])
    found = schema.nodes(rows, ["event_id"]).groupBy("event_id").count().collect()
    assert sorted(r["count"] for r in found) == [2, 51]
    assert schema.nodes(rows, ["event_id"], pass_depth=2).count() == 53


def test_unreadable_payloads_have_no_schema(spark):
    rows = spark.createDataFrame([(1, "k", "bad json"), (2, "k", '{"a":1}'), (3, "k", "null")], "event_id bigint, resource_kind string, data string")
    assert sorted((r.path, r.type, r.nodes) for r in schema.type_counts(rows).collect()) == [("$", "null", 1), ("$", "object", 1), ("$.a", "integer", 1)]
    assert [(r.resource_kind, r.events) for r in schema.unreadable(rows).collect()] == [("k", 1)]


def test_null_is_a_group(spark):
    rows = spark.createDataFrame([(None if i < 40 else "x", i) for i in range(60)], "g string, i int")
    got = scan.running_number(rows, ["g"], ["i"], "n", buckets=4)
    assert sorted(r.n for r in got.where("g is null").collect()) == list(range(40))
    assert topn.first_rows(rows, ["g"], "i", 4).count() == 8


def test_more_feeds_than_a_filter_names(spark):
    log = spark.createDataFrame([(f"f{k}", i) for k in range(80) for i in range(4)], "stream_path string, timepoint bigint")
    at = spark.createDataFrame([(f"f{k}", 1) for k in range(70)], "stream_path string, timepoint bigint")
    feeds = tuple(f"f{k}" for k in range(80))
    assert cursors.resume(log, at, feeds).count() == 140
    assert cursors.next_batch(log, at, 3, feeds).count() == 70 * 2 + 10 * 3


def test_topic_messages_are_json(spark):
    rows = spark.createDataFrame([("f", "{}"), ("f", ' {"a":1}'), ("f", "{ }")], "stream_path string, line string")
    got = [json.loads(r.value) for r in history.topic_messages(rows, "line").collect()]
    assert got == [{"streamPath": "f"}, {"streamPath": "f", "a": 1}, {"streamPath": "f"}]


def test_stamps_are_removed_wherever_they_are(spark):
    texts = ['{"received":"x\\"y","streamPath":"f","a":1}', '{"a":{"received":1},"received":2}', '{"streamPath":"f"}', '{"b": "received"}']
    rows = spark.createDataFrame([("f", t) for t in texts], "stream_path string, line string")
    assert [json.loads(r.value) for r in ndjson.to_ndjson(rows, "line").collect()] == [{"a": 1}, {"a": {"received": 1}}, {}, {"b": "received"}]


def test_long_text_is_not_cut(spark):
    text = "a" * 1_200_000
    assert spark.createDataFrame([(text,)], "t string").select(F.length(sentence_case(F.col("t")))).first()[0] == len(text)


def test_json_schema_text(spark):
    counted = schema.type_counts(payloads(spark, PAYLOADS))
    got = json.loads(schema.json_schemas(schema.profile(counted), "k").first().schema)
    assert got["type"] == "object"
    assert got["required"] == ["a", "b"]
    assert got["properties"]["a"] == {"type": "number"}
    assert got["properties"]["e"]["items"]["required"] == ["h"]
    with pytest.raises(ValueError):
        schema.json_schemas(schema.profile(counted), "nothing")


def test_bottom_k_of_parts_is_bottom_k_of_the_whole(spark):
    numbers = spark.range(5000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("company_number"))
    parts = [sample.pool(numbers.where(F.col("company_number").substr(8, 1) == str(d)), 50) for d in range(10)]
    merged = parts[0].select("company_number")
    for part in parts[1:]:
        merged = materialise(sample.merge_pools(merged, part, 50).select("company_number"), "pool")
    whole = sample.pool(numbers, 50).select("company_number")
    assert sorted(merged.collect()) == sorted(whole.collect())


def test_sample_is_exact(spark):
    df = spark.range(3000)
    want = sorted(r.id for r in df.orderBy(sample.token(F.col("id"), "s")).limit(100).collect())
    assert sorted(r.id for r in topn.bottom_k(df, sample.token(F.col("id"), "s"), 100).collect()) == want


def test_first_visitor_day(spark):
    visits = spark.createDataFrame([("1", dt.date(2023, 9, 11)), ("1", dt.date(2023, 9, 12)), (None, dt.date(2023, 9, 12))], "ip string, day date")
    assert [(r.day.isoformat(), r.visitors) for r in visitors.daily_exact(visits).collect()] == [("2023-09-12", 1)]
    with pytest.raises(ValueError):
        visitors.require_day(dt.date(2023, 9, 11))


@pytest.mark.parametrize("qty,quantity,accepted", [(None, 100, True), ("0", 100, True), ("abc", 100, True), ("25 items", 25, True), ("-5", -5, False), ("10001", 10001, False), ("10000", 10000, True)])
def test_history_quantity(spark, qty, quantity, accepted):
    row = counts.history_requests(spark.createDataFrame([(qty,)], "qty string")).first()
    assert (row.quantity, row.accepted) == (quantity, accepted)


def test_live_filter_and_expiry(spark):
    events = spark.createDataFrame([("12345678", dt.datetime(2024, 1, 1)), ("", dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1))], "company_number string, received timestamp_ntz")
    assert history.live_filter(events).count() == 2
    assert history.live_filter(events, "3456").count() == 1
    assert history.live_filter(events, "3456", visible=False).count() == 0
    assert history.live_filter(events, "12345678", visible=False).count() == 1

    def at(second):
        return F.lit(f"2024-01-01 00:00:{second}").cast("timestamp_ntz")

    assert history.visible_at(events, at("14")).count() == 3
    assert history.visible_at(events, at("15")).count() == 0
    assert history.visible_at(events, at("44"), "1").count() == 3


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(100)
    small = spark.range(1000).join(broadcast_if_small(df, 100), "id")._jdf.queryExecution().optimizedPlan().toString()
    large = spark.range(1000).join(broadcast_if_small(df, 99), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in small and "broadcast" not in large


def test_work_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    else:
        assert shared_dir(spark)


def build_schema(values):
    """JSON Schema of values seen in one place, in plain Python."""
    kinds = {next(flatten(v))[2] for v in values}
    if "number" in kinds:
        kinds.discard("integer")
    out = {"type": sorted(kinds) if len(kinds) > 1 else kinds.pop()}
    objects = [v for v in values if isinstance(v, dict)]
    keys = sorted({k for o in objects for k in o})
    if keys:
        out["properties"] = {k: build_schema([o[k] for o in objects if k in o]) for k in keys}
        needed = [k for k in keys if all(k in o for o in objects)]
        if needed:
            out["required"] = needed
    items = [i for v in values if isinstance(v, list) for i in v]
    if items:
        out["items"] = build_schema(items)
    return out


def test_json_schema_of_random_payloads(spark):
    draw = random.Random(5)
    names = ["a", "b", "a.b", "c[]", 'q"', "back\\", '\\"', "line\nbreak", "ü", "", "$", " "]

    def value(depth):
        kind = draw.randrange(8 if depth else 5)
        if kind < 5:
            return [1, 2.5, "x", None, True][kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(draw.randrange(3))]
        return {k: value(depth - 1) for k in draw.sample(names, draw.randrange(5))}

    for depth in (2, 10):
        values = [{"top": value(depth)} for _ in range(60)] + [{"top": [[[[[[[[{"deep": [1, {"x": None}]}]]]]]]]]}]
        counted = schema.type_counts(payloads(spark, values))
        text = schema.json_schemas(schema.profile(counted)).first().schema
        assert json.loads(text) == build_schema(values)
        # Keys come in one order, so equal profiles have equal texts.
        assert text == schema.json_schemas(schema.profile(counted.repartition(7))).first().schema


def test_schema_walk_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, '{"a":{}}'), (2, "k", None), (3, "k", ""), (4, "k", "[]"), (4, "k", "7")], "event_id int, resource_kind string, data string")
    got = sorted((r.event_id, r.path, r.type) for r in schema.nodes(rows, ["event_id"]).collect())
    assert got == [(1, "$", "object"), (1, "$.a", "object"), (4, "$", "array"), (4, "$", "integer")]
    assert schema.nodes(rows.limit(0), ["event_id"]).count() == 0
    assert schema.nodes(rows, ["event_id"], pass_depth=0).count() == 4
    wide = spark.createDataFrame([(1, "k", json.dumps({f"k{i}": [i] * 3 for i in range(3000)}))], "event_id int, resource_kind string, data string")
    assert schema.type_counts(wide).count() == 6001


def test_last_value_of_a_repeated_key(spark):
    line = '{"resource_kind":"k","resource_kind":"m","event":{"timepoint":1,"timepoint":2},"data":{"a":1,"a":"x"}}'
    rows = spark.createDataFrame([("f", line, None)], "stream_path string, line string, received timestamp_ntz")
    got = ndjson.bronze(rows).first()
    assert (got.reject_reason, got.resource_kind, got.timepoint) == (None, "m", 2)
    found = schema.nodes(spark.createDataFrame([(1, '{"a":1,"a":"x"}')], "event_id int, data string"), ["event_id"])
    assert sorted((r.path, r.type) for r in found.collect()) == [("$", "object"), ("$.a", "string")]
    assert (ndjson.envelope(rows).first().resource_kind, ndjson.envelope(rows).first().timepoint) == ("m", 2)


def test_carries_of_groups_of_all_lengths(spark):
    draw = random.Random(9)
    for lengths in ([40], [1] * 50, [30, 1, 1, 60, 2], [1, 1, 200], []):
        rows = [(None if g == 0 else f"g{g}", i, draw.randrange(-5, 6)) for g, n in enumerate(lengths) for i in range(n)]
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, i int, v int")
        want, top = set(), set()
        for g in {r[0] for r in rows}:
            sum_, highest = 0, None
            for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                top.add((g, i, highest))
                sum_ += v
                highest = v if highest is None else max(highest, v)
                want.add((g, i, sum_))
        for buckets in (1, 7):
            assert {(r.g, r.i, r.s) for r in scan.running_total(df, ["g"], ["i"], F.col("v"), "s", buckets=buckets).collect()} == want
            assert {(r.g, r.i, r.m) for r in scan.max_before(df, ["g"], ["i"], "v", "m", buckets=buckets).collect()} == top

