"""Typed tables of events: payloads as structs that are compiled from the stored profile of their kind.

A profile names for each path of a kind the types seen there. Compiling it is a fold over paths, as long as the schema and not as
its data. Types widen: whole numbers and others are numbers, anything else that differs is text. All kinds are parsed and
written in one job; each has a column of its own, empty in the rows of other kinds. Parts that were written under other profiles are
read under their own types and widened to a common one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed.operators.schema import ROOT

SCALARS = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
COMMON = ("stream_path", "timepoint", "published_at", "resource_kind")


def _key(path: str, parent: str) -> str:
    name = path[len(parent) + 1 :]
    return re.sub(r"\\(.)", r"\1", name[1:-1]) if name.startswith('"') else name


def _struct(fields: Sequence[tuple[str, T.DataType]]) -> T.DataType:
    """A struct of these fields; text if it would have none, or two that differ by case only: no table can hold those."""
    names = {n.lower() for n, _ in fields}
    return T.StructType([T.StructField(n, t) for n, t in fields]) if fields and len(names) == len(fields) else T.StringType()


def compile_types(profile: DataFrame) -> dict[str, T.DataType]:
    """The type of each kind's payload. One row of the profile for each path of a kind comes to the driver."""
    found: dict[str, dict[str, tuple[str | None, set[str]]]] = {}
    for r in profile.select("resource_kind", "parent", "path", "types").collect():
        found.setdefault(r.resource_kind, {})[r.path] = (r.parent, set(r.types.split(",")))
    out = {}
    for kind, paths in found.items():
        below: dict[str, list[str]] = {}
        for path, (parent, _) in paths.items():
            if parent is not None:
                below.setdefault(parent, []).append(path)

        def build(path: str, paths=paths, below=below) -> T.DataType:
            seen = paths[path][1] - {"null"}
            if seen == {"object"}:
                return _struct([(_key(p, path), build(p)) for p in sorted(below.get(path, []))])
            if seen == {"array"}:
                return T.ArrayType(build(path + "[]") if path + "[]" in paths else T.StringType())
            if seen and seen <= {"integer", "number"}:
                return SCALARS["number" if "number" in seen else "integer"]
            return SCALARS.get(next(iter(seen)), T.StringType()) if len(seen) == 1 else T.StringType()

        out[kind] = build(ROOT)
    return out


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds values of both."""
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        of = {f.name: f.dataType for f in a}
        for f in b:
            of[f.name] = wider(of[f.name], f.dataType) if f.name in of else f.dataType
        return _struct(list(of.items()))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    return T.StringType()


def widened(value: Column, a: T.DataType, b: T.DataType) -> Column:
    """A value of type ``a`` as one of type ``b``: by name in structs, missing fields NULL, others left out; what cannot be cast is NULL."""
    if a == b:
        return value
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        mine = {f.name: f.dataType for f in a}
        fields = [widened(value[f.name], mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType) for f in b]
        return F.when(value.isNotNull(), F.struct(*[c.alias(f.name) for c, f in zip(fields, b, strict=True)]))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return F.transform(value, lambda x: widened(x, a.elementType, b.elementType))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(a, nested):
        return F.to_json(value) if isinstance(b, T.StringType) else F.lit(None).cast(b)
    return F.lit(None).cast(b) if isinstance(b, nested) else value.try_cast(b)


def _columns(kinds: Sequence[str]) -> dict[str, str]:
    """A column for each kind; of kinds that differ by case only the first gets one, since columns cannot."""
    out: dict[str, str] = {}
    for kind in sorted(kinds):
        if f"data_{kind}".lower() not in {c.lower() for c in out.values()}:
            out[kind] = f"data_{kind}"
    return out


def typed(events: DataFrame, types: dict[str, T.DataType], text: str = "data") -> DataFrame:
    """``stream_path, timepoint, published_at, resource_kind, unread`` and the payload of each kind in a column of its own.

    ``unread``: the payload is there, and its kind has no column or the text is no such payload; such rows keep it in ``text``.
    """
    readable = F.try_parse_json(F.col(text)).isNotNull()
    kind = F.col("resource_kind")
    parsed = {}
    for k, column in _columns(list(types)).items():
        given = types[k]
        value = F.from_json(F.col(text), given) if isinstance(given, (T.StructType, T.ArrayType)) else F.get_json_object(F.col(text), "$").try_cast(given)
        parsed[column] = F.when((kind == k) & readable, value)
    rows = events.select(*COMMON, F.col(text).alias("_text"), *[c.alias(n) for n, c in parsed.items()])
    nothing = reduce(Column.__and__, [F.col(f"`{n}`").isNull() for n in parsed], F.lit(True))
    unread = F.col("_text").isNotNull() & nothing
    return rows.select(*COMMON, unread.alias("unread"), F.when(unread, F.col("_text")).alias("text"), *[F.col(f"`{n}`") for n in parsed])


def write_typed(events: DataFrame, types: dict[str, T.DataType], path: str, text: str = "data") -> None:
    """One job for all kinds; a folder for each, so that reading one kind skips the others. Events without a kind get none."""
    rows = typed(events, types, text)
    by = ["resource_kind", "stream_path", "timepoint"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("errorifexists").partitionBy("resource_kind").parquet(path)


def read_typed(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """Events of one kind from all parts, ``data`` in the narrowest type that holds the payloads of every part.

    A part that does not know the kind has only its unread rows, with NULL as ``data``; without any that knows it ``data`` is text.
    """
    parts = []
    for path in paths:
        # The kind is text, even where all names of folders look like numbers.
        fields = [T.StructField(f.name, T.StringType()) if f.name == "resource_kind" else f for f in spark.read.parquet(path).schema]
        rows = spark.read.schema(T.StructType(fields)).parquet(path).where(F.col("resource_kind") == kind)
        kinds = [c for c in rows.columns if c.startswith("data_")]
        column = next((c for c in kinds if c == f"data_{kind}"), None)
        parts.append((rows, column, rows.schema[column].dataType if column else None))
    known = [t for _, _, t in parts if t is not None]
    target = reduce(wider, known) if known else T.StringType()
    frames = []
    for rows, column, given in parts:
        data = widened(F.col(f"`{column}`"), given, target) if column else F.lit(None).cast(target)
        frames.append(rows.select(*COMMON, "unread", "text", data.alias("data")))
    return reduce(DataFrame.unionByName, frames)


def register_unlike(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Files that differ in columns and types under one table schema: missing columns are NULL, others are left out, types are cast.

    Paths whose files agree share a scan.
    """
    target = spark.createDataFrame([], schema).schema
    alike: dict[str, list[str]] = {}
    for path in paths:
        alike.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    frames = []
    for given, members in alike.items():
        mine = T.StructType.fromJson(json.loads(given))
        rows = spark.read.schema(mine).parquet(*members)
        of = {f.name: f.dataType for f in mine}
        fields = [widened(F.col(f"`{f.name}`"), of[f.name], f.dataType) if f.name in of else F.lit(None).cast(f.dataType) for f in target]
        frames.append(rows.select(*[c.alias(f.name) for c, f in zip(fields, target, strict=True)]))
    return reduce(DataFrame.unionByName, frames)
