"""Newline-delimited JSON: scan, parse with quarantine, envelope, and schema inference."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regfeed.functions.timeutil import normalise_timestamp
from regfeed.operators import schema
from regfeed.operators.typed import compile_types
from regfeed.session import materialise, work_path

ENVELOPE = T.StructType(
    [
        T.StructField("resource_kind", T.StringType()),
        T.StructField("resource_uri", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField(
            "event",
            T.StructType(
                [
                    T.StructField("timepoint", T.LongType()),
                    T.StructField("published_at", T.StringType()),
                    T.StructField("type", T.StringType()),
                    T.StructField("fields_changed", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)


# Stamps at the beginning of an object, with the comma after each.
_STAMPS = r'^\s*\{\s*(?:"(?:received|streamPath)"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[0-9.eE+-]+|null)\s*(?:,\s*|(?=\})))+'


def non_blank(lines: DataFrame, text: str = "line") -> DataFrame:
    """Lines that carry something; blank ones only keep the connection alive."""
    return lines.where(F.trim(F.col(text)) != "")


def parsed(lines: DataFrame, text: str = "line") -> DataFrame:
    """Every non-blank line once, as VARIANT, with ``reject_reason`` set where it is not a JSON object.

    Text that parses and starts with a brace is an object, so the value itself need not be looked into.
    """
    read = non_blank(lines, text).withColumn("event", F.try_parse_json(F.col(text)))
    is_object = F.ltrim(F.col(text), F.lit(" \t\r\n")).startswith("{")
    reason = F.when(F.col("event").isNull(), F.lit("syntax")).when(~is_object, F.lit("not_object"))
    return read.withColumn("reject_reason", reason)


def split_quarantine(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows. Good rows keep the parsed event, rejected ones keep their text."""
    read = parsed(lines, text)
    return read.where(F.col("reject_reason").isNull()).drop("reject_reason"), read.where(F.col("reject_reason").isNotNull()).drop("event")


def envelope(events: DataFrame, text: str = "line") -> DataFrame:
    """Key, kind and publication time beside the whole event text. Only the named fields are built from the text."""
    read = events.withColumn("_e", F.from_json(F.col(text), ENVELOPE))
    return read.select(
        *[c for c in events.columns if c not in ("timepoint", "resource_kind", "resource_uri", "resource_id")],
        F.col("_e.event.timepoint").alias("timepoint"),
        F.col("_e.resource_kind").alias("resource_kind"),
        F.col("_e.resource_uri").alias("resource_uri"),
        F.col("_e.resource_id").alias("resource_id"),
        normalise_timestamp(F.col("_e.event.published_at")).alias("published_at"),
    )


def bronze(lines: DataFrame, text: str = "line") -> DataFrame:
    """Stored form of a feed: envelope columns, event text, arrival, and why a line was rejected."""
    read = parsed(lines, text)
    event = F.col("event")

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get(event, path, kind)

    return read.select(
        "stream_path",
        field("$.event.timepoint", "bigint").alias("timepoint"),
        normalise_timestamp(field("$.event.published_at", "string")).alias("published_at"),
        F.col("received"),
        field("$.resource_kind", "string").alias("resource_kind"),
        field("$.resource_id", "string").alias("resource_id"),
        field("$.resource_uri", "string").alias("resource_uri"),
        field("$.event.type", "string").alias("event_type"),
        F.col(text).alias("event_data"),
        "reject_reason",
    )


def extract(events: DataFrame, text: str, path: str, out: str) -> DataFrame:
    """One JSON path as text."""
    return events.withColumn(out, F.get_json_object(F.col(text), path))


def infer(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> DataFrame:
    """Typed read of JSON lines, types taken from every record of the files."""
    return spark.read.option("samplingRatio", sampling_ratio).json(path)


def record_type(spark: SparkSession, path: str) -> T.DataType:
    """Type of the records of a folder of JSON lines; text where no record has a field.

    Spark's reader refuses records that have a key twice, or two that differ by case. Such folders are typed by their profile.
    """
    try:
        types = infer(spark, path).schema
    except AnalysisException as e:
        if e.getCondition() != "COLUMN_ALREADY_EXISTS":
            raise
        records = spark.read.text(path).select(F.lit("").alias("resource_kind"), "value")
        return compile_types(schema.profile(schema.type_counts(records, "value")))[""]
    return types if types.fields else T.StringType()


def ingest(lines: DataFrame, text: str = "line", payload: str = "data") -> dict[str | None, DataFrame]:
    """A stored typed table for each kind, types taken from every record of the kind; two kinds never share a type.

    ``record`` holds the record. ``sent`` names the keys of its payload as they were sent, because types do not tell a JSON null from a
    missing key and have no column for a key that only ever holds ``{}``.
    """
    spark = lines.sparkSession
    root = work_path(spark, "kinds")
    # A kind may be any text, the name of a folder may not.
    folder = F.coalesce(F.md5(F.col("resource_kind").cast("binary")), F.lit("none"))
    lines.select(folder.alias("kind"), F.col(text).alias("value")).write.partitionBy("kind").text(root)
    members = T.StructType([T.StructField(payload, T.MapType(T.StringType(), T.StringType()))])
    tables = {}
    for kind, name in lines.select("resource_kind", folder).distinct().toLocalIterator():
        path = f"{root}/kind={name}"
        given = record_type(spark, path)
        record = F.col("value") if isinstance(given, T.StringType) else F.from_json("value", given)
        sent = F.map_keys(F.from_json("value", members)[payload])
        tables[kind] = materialise(spark.read.text(path).select(record.alias("record"), sent.alias("sent")), "typed")
    return tables


def sent_keys(spark: SparkSession, tables: dict[str | None, DataFrame]) -> DataFrame:
    """How often each key was sent, per kind, also with a JSON null."""
    keys = spark.createDataFrame([], "resource_kind string, column_name string")
    for kind, table in tables.items():
        keys = keys.unionByName(table.select(F.lit(kind).cast("string").alias("resource_kind"), F.explode("sent").alias("column_name")))
    return keys.groupBy("resource_kind", "column_name").agg(F.count(F.lit(1)).alias("filled"))


def read_all_feeds(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Feeds kept in separate folders as one source with a ``stream_path`` column."""
    frames = [spark.read.text(path).select(F.lit(feed).alias("stream_path"), F.col("value").alias("line")) for feed, path in paths.items()]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def to_ndjson(events: DataFrame, text: str) -> DataFrame:
    """Download form: the event as it was sent. The stamps ``received`` and ``streamPath`` go, wherever they stand.

    Stamps are put in front, where they can be cut off as text; an object that has them elsewhere is written anew.
    """
    cut = F.regexp_replace(F.col(text), _STAMPS, "{")
    event = F.try_parse_json(cut)
    # Only text that names a stamp again is parsed.
    named = cut.contains('"received"') | cut.contains('"streamPath"')
    stamped = named & F.coalesce(F.schema_of_variant(event).rlike(r"(?s)^OBJECT<"), F.lit(False)) & (
        F.try_variant_get(event, "$.received", "variant").isNotNull() | F.try_variant_get(event, "$.streamPath", "variant").isNotNull()
    )
    members = F.map_filter(F.try_variant_get(event, "$", "map<string,variant>"), lambda k, _: ~k.isin("received", "streamPath"))
    return events.select("stream_path", F.when(stamped, F.to_json(members)).otherwise(cut).alias("value"))
