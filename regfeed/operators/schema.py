"""Payload schemas per resource kind: infer, merge, check and extend.

A payload is walked down by generators over VARIANT values, one per level: a row is a branch on its way to a leaf, and the nodes
above it go with the first of their branches. Array items share one path. A profile is only counts per (kind, path, type),
so profiles add up: partial aggregation before the shuffle leaves one row per path and task, and merging stored profiles is a sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.session import broadcast_if_small

ROOT = "$"
# Levels that are followed by generators; what lies deeper is walked inside its row.
PASS_DEPTH = 6

_NODE = "array<struct<parent:string,path:string,v:variant>>"
_FOUND = "array<struct<parent:string,path:string,type:string>>"


# Type names of JSON Schema for the types VARIANT reports; all others are strings.
TYPE_NAMES = {
    "VOID": "null",
    "OBJECT": "object",
    "ARRAY": "array",
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
    "BOOLEAN": "boolean",
}


def _type_name(v: Column) -> Column:
    """Type of one node. Objects and arrays that hold something are told apart before, so the variant looked at here is small."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    outer = F.substring_index(F.substring_index(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), "<", 1), "(", 1)
    return F.coalesce(names[outer], F.lit("string"))


def _segment(key: Column) -> Column:
    """Key as a path segment; keys with other characters are quoted, so no two paths look alike."""
    escaped = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(key.rlike(r"\A[A-Za-z0-9_-]+\z"), key).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def _children(node: Column) -> Column:
    """Child nodes of an object or array node; none for a scalar."""
    path = node["path"]
    members = F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>"))
    items = F.try_variant_get(node["v"], "$", "array<variant>")
    from_object = F.transform(
        members,
        lambda m: F.struct(path.alias("parent"), F.concat(path, F.lit("."), _segment(m["key"])).alias("path"), m["value"].alias("v")),
    )
    from_array = F.transform(items, lambda i: F.struct(path.alias("parent"), F.concat(path, F.lit("[]")).alias("path"), i.alias("v")))
    return F.coalesce(from_object, from_array, F.array().cast(_NODE))


def _nested(path: Column, parent: Column, v: Column) -> Column:
    """All nodes of a value, however deep, as an array: one step per level, at most as many steps as there are opening brackets."""
    text = F.to_json(v)
    opened = (F.length(text) - F.length(F.translate(text, "{[", ""))).cast("int")
    first = F.array(F.struct(parent.alias("parent"), path.alias("path"), v.alias("v"))).cast(_NODE)
    start = F.struct(first.alias("level"), F.array().cast(_FOUND).alias("found"))

    def step(state: Column, _: Column) -> Column:
        level = state["level"]
        seen = F.transform(level, lambda n: F.struct(n["parent"].alias("parent"), n["path"].alias("path"), _type_name(n["v"]).alias("type")))
        deeper = F.struct(F.flatten(F.transform(level, _children)).alias("level"), F.concat(state["found"], seen).alias("found"))
        return F.when(F.size(level) == 0, state).otherwise(deeper)

    return F.aggregate(F.sequence(F.lit(0), opened), start, step, lambda state: state["found"])


def nodes(events: DataFrame, key: list[str], data: str = "data", pass_depth: int = PASS_DEPTH) -> DataFrame:
    """One row per node of every readable payload, however deep: key columns, parent, path, type.

    Payloads that are not JSON have no nodes; ``unreadable`` counts them. Nothing runs while the plan is built.
    """
    explode = events.sparkSession.tvf.variant_explode_outer
    keys = [F.col(c) for c in key]
    path, parent, v, found = F.col("_path"), F.col("_parent"), F.col("_v"), F.col("_found")
    pos, name, value = F.col("_pos"), F.col("_name"), F.col("_value")
    none = F.array().cast(_FOUND)
    root = F.lit(None).cast("string").alias("_parent"), F.lit(ROOT).alias("_path"), none.alias("_found")
    rows = events.select(*keys, F.try_parse_json(F.col(data)).alias("_v"), *root)
    for _ in range(pass_depth):
        rows = rows.lateralJoin(explode(v.outer()).toDF("_pos", "_name", "_value"))
        type_name = F.when(name.isNotNull(), F.lit("object")).when(pos.isNotNull(), F.lit("array")).otherwise(_type_name(v))
        here = F.array(F.struct(parent.alias("parent"), path.alias("path"), type_name.alias("type"))).cast(_FOUND)
        # A branch that has ended keeps its nodes; of the others the first child takes along what was found above it.
        onward = F.when(v.isNull(), found).when(F.coalesce(pos, F.lit(0)) == 0, F.concat(found, here)).otherwise(none)
        below = F.when(name.isNotNull(), F.concat(path, F.lit("."), _segment(name))).when(pos.isNotNull(), F.concat(path, F.lit("[]")))
        rows = rows.select(*keys, value.alias("_v"), F.when(pos.isNotNull(), path).alias("_parent"), below.alias("_path"), onward.alias("_found"))
    every = F.when(v.isNull(), found).otherwise(F.concat(found, _nested(path, parent, v)))
    return rows.select(*keys, F.inline(every))


def unreadable(events: DataFrame, data: str = "data") -> DataFrame:
    """Payloads per kind that are not JSON; no schema is learned from them."""
    return events.where(F.try_parse_json(F.col(data)).isNull()).groupBy("resource_kind").agg(F.count(F.lit(1)).alias("events"))


def payload_paths(events: DataFrame, data: str = "data") -> DataFrame:
    """Schema of single payloads: how often each (path, type) occurs in each event."""
    return nodes(events, ["event_id"], data).groupBy("event_id", "path", "type").agg(F.count(F.lit(1)).alias("nodes"))


def type_counts(events: DataFrame, data: str = "data") -> DataFrame:
    """Mergeable profile: nodes per (kind, parent, path, type)."""
    return nodes(events, ["resource_kind"], data).groupBy("resource_kind", "parent", "path", "type").agg(F.count(F.lit(1)).alias("nodes"))


def merge_counts(*profiles: DataFrame) -> DataFrame:
    """Sum of profiles; the order of merging does not matter."""
    every = reduce(DataFrame.unionByName, profiles)
    return every.groupBy("resource_kind", "parent", "path", "type").agg(F.sum("nodes").alias("nodes"))


def profile(counts: DataFrame) -> DataFrame:
    """Per (kind, path): its types, how often it is present, and whether every parent object has it.

    Keys are unique inside an object, so a key is required exactly when it occurs as often as its parent object.
    Everything here is one row per path.
    """
    kinds = F.collect_set("type")
    # An integer is a number too.
    names = F.when(F.array_contains(kinds, "number"), F.array_remove(kinds, "integer")).otherwise(kinds)
    paths = counts.groupBy("resource_kind", "parent", "path").agg(
        F.array_join(F.sort_array(names), ",").alias("types"),
        F.sum("nodes").cast("bigint").alias("present"),
    )
    objects = counts.where(F.col("type") == "object").select("resource_kind", F.col("path").alias("parent"), F.col("nodes").alias("parents"))
    joined = paths.join(objects, ["resource_kind", "parent"], "left")
    is_key = F.col("parent").isNotNull() & ~F.col("path").endswith("[]")
    required = is_key & (F.col("present") == F.col("parents"))
    return joined.select("resource_kind", "parent", "path", "types", "present", F.coalesce(required, F.lit(False)).alias("required"))


def drift(events: DataFrame, saved: DataFrame, key: str = "event_id", data: str = "data") -> DataFrame:
    """Events that do not fit the saved profile of their kind.

    An event fits when each of its (path, type) is in the profile and each of its objects has the keys that are
    required there. Both are sums over the event's own nodes: the saved profile joins by broadcast while it is small,
    and the nodes of an event lie in one task, so the aggregate moves one row per event.
    """
    per_path = saved.select("resource_kind", "path", "types", "required")
    needed = saved.where("required").groupBy("resource_kind", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("needs"))
    rules = broadcast_if_small(per_path.join(needed, ["resource_kind", "path"], "left"))
    seen = nodes(events, [key, "resource_kind"], data).join(rules, ["resource_kind", "path"], "left")
    allowed = F.split("types", ",")
    type_ok = F.array_contains(allowed, F.col("type")) | ((F.col("type") == "integer") & F.array_contains(allowed, "number"))
    unknown = F.when(F.coalesce(type_ok, F.lit(False)), 0).otherwise(1)
    needs = F.when(F.col("type") == "object", F.coalesce("needs", F.lit(0))).otherwise(0)
    has = F.when(F.coalesce("required", F.lit(False)), 1).otherwise(0)
    sums = seen.groupBy(key, "resource_kind").agg(
        F.sum(unknown).cast("bigint").alias("unknown_nodes"), F.sum(needs - has).cast("bigint").alias("missing_keys")
    )
    return sums.where((F.col("unknown_nodes") > 0) | (F.col("missing_keys") > 0))


def extend(saved_counts: DataFrame, drifting: DataFrame, version: int, data: str = "data") -> DataFrame:
    """The next version of the saved profile: with the drifting events added."""
    merged = merge_counts(saved_counts, type_counts(drifting, data))
    return merged.withColumn("version", F.lit(version))


# One segment of a path: a key, quoted or not, or the step to the items of an array.
_STEP = r'\.(?:"(?:[^"\\]++|\\.)*+"|[A-Za-z0-9_-]+)|\[\]'


def _key_of(step: Column) -> Column:
    """The key that a step to a member names."""
    quoted = F.regexp_replace(F.substr(step, F.lit(3), F.length(step) - 3), r"(?s)\\(.)", "$1")
    return F.when(step.startswith('."'), quoted).otherwise(F.substr(step, F.lit(2)))


def json_schemas(profiles: DataFrame, resource_kind: str | None = None) -> DataFrame:
    """JSON Schema text per kind: (resource_kind, schema).

    Every path gives the pieces of text that open and close it, and the place of each piece is a list of steps from the root: keys
    in order of their names, then the list of required keys, then the items. Sorted by place, the pieces of a kind are its schema, of
    any depth. A group holds one kind's paths: as much as its schema, not its data.
    """
    chosen = profiles
    if resource_kind is not None:
        chosen = profiles.where(F.col("resource_kind") == resource_kind)
        if chosen.isEmpty():
            raise ValueError(f"no schema is stored for resource kind {resource_kind!r}")
    step = F.coalesce(F.try_element_at("_steps", F.lit(-1)), F.lit(""))
    is_key = step.startswith(".")
    # The name as JSON writes it: an array of it without its brackets.
    text = F.regexp_replace(F.to_json(F.array(_key_of(step))), r"(?s)\A\[(.*)\]\z", "$1")
    split = chosen.withColumn("_steps", F.regexp_extract_all("path", F.lit(_STEP), F.lit(0)))
    placed = split.select(
        "resource_kind",
        "parent",
        "path",
        "required",
        F.split("types", ",").alias("_types"),
        is_key.alias("_key"),
        F.when(is_key, text).alias("_name"),
        # Keys sort before "2" (end of the keys), "3" (items) and "4" (end of the path).
        F.transform("_steps", lambda s: F.when(s == "[]", F.lit("3")).otherwise(F.concat(F.lit("1"), _key_of(s)))).alias("_place"),
    )
    by_name = Window.partitionBy("resource_kind", "parent", "_key").orderBy("_place")
    numbered = placed.withColumn("_nth", F.row_number().over(by_name))
    # What a path has to know of its keys.
    keys = numbered.where("_key").groupBy("resource_kind", F.col("parent").alias("path"))
    needed = F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("_place", "_name"))))
    told = keys.agg(F.transform(needed, lambda n: n["_name"]).alias("_needed"))
    joined = numbered.join(told, ["resource_kind", "path"], "left")
    types = F.when(F.size("_types") == 1, F.to_json("_types").substr(F.lit(2), F.length(F.to_json("_types")) - 2)).otherwise(F.to_json("_types"))
    comma = F.when(F.col("_nth") > 1, F.lit(",")).otherwise(F.lit(""))
    lead = F.when(F.col("_key"), F.concat(comma, F.col("_name"), F.lit(":"))).when(F.col("parent").isNotNull(), F.lit(',"items":')).otherwise(F.lit(""))
    opening = F.concat(lead, F.lit('{"type":'), types, F.when(F.col("_needed").isNotNull(), F.lit(',"properties":{')).otherwise(F.lit("")))
    required = F.concat(F.lit('},"required":['), F.array_join("_needed", ","), F.lit("]"))
    middle = F.when(F.size("_needed") > 0, required).when(F.col("_needed").isNotNull(), F.lit("}")).otherwise(F.lit(""))

    def piece(place: Column, text: Column) -> Column:
        return F.struct(place.alias("place"), text.alias("text"))

    pieces = F.array(
        piece(F.col("_place"), opening),
        piece(F.concat("_place", F.array(F.lit("2"))), middle),
        piece(F.concat("_place", F.array(F.lit("4"))), F.lit("}")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_piece.place", "_piece.text")))
    return (
        joined.select("resource_kind", F.explode(pieces).alias("_piece"))
        .groupBy("resource_kind")
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("schema"))
    )
