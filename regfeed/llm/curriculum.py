"""Mixing sources to target weights along a curriculum that changes during training.

A source's target is its part, by weight, of a share of all words, but at most a multiple of its own size; what is cut off goes
to the other sources by weight until none is above. Its documents, in the order of a hash of their id, form a stream that is
read as often as the target asks. Its schedule, a piecewise linear weight over training time from 0 to 1, says when: demand up
to time t is the integral of the schedule, scaled to the target, and a document's position is the time at which demand reaches the
middle of it. Inverting a piecewise quadratic is a root, so all of this is plain expressions.

Streams are summed in two steps, per hash bucket and inside it, so that a source of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
# Fixed values of the mix: weights by the source's place, repeating; share of all words; most words taken per word of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
# Weight over time for the sources of each weight: front-loaded, late, even. Knots are (time, weight); only the shape counts.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))
BUCKET_ROWS = 10_000


def word_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, source, size`` and the columns asked for: words of the whole text, 0 for NULL."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *keep)


def _pieces(knots: tuple[tuple[float, float], ...]) -> Column:
    """Segments ``from, to, low, high, before``: the schedule over time, and its integral up to the segment."""
    area, out = 0.0, []
    for (a, v), (b, w) in zip(knots, knots[1:], strict=False):
        out.append((a, b, v, w, area))
        area += (b - a) * (v + w) / 2
    names = ("from", "to", "low", "high", "before")
    return F.array(*[F.struct(*[F.lit(x / area if n in ("low", "high", "before") else x).alias(n) for n, x in zip(names, piece, strict=True)]) for piece in out])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """``place, source, source_size, target, schedule``: one row per source (``source`` NULL is one, and comes last).

    Sources are ordered by code point. Windows here run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by_place = lambda xs: F.element_at(F.array(*xs), (F.col("place") % len(xs) + 1).cast("int"))
    weighed = ordered.withColumn("weight", by_place([F.lit(float(w)) for w in weights])).withColumn("cap", (F.col("source_size") * most).cast("double"))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    # A source is full if the level that the fuller ones leave would still exceed its cap; the first that is not sets the level.
    leveled = weighed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(open_level * F.col("weight"))
    return leveled.select("place", "source", "source_size", target.alias("target"), by_place([_pieces(s) for s in schedules]).alias("schedule"))


def _position(fraction: Column, schedule: Column) -> Column:
    """Time at which the integral of the schedule, whose whole is 1, reaches ``fraction``."""
    piece = F.element_at(F.filter(schedule, lambda s: s["before"] <= fraction), -1)
    rest, width = fraction - piece["before"], piece["to"] - piece["from"]
    bend = (piece["high"] - piece["low"]) / width
    root = F.sqrt(F.greatest(piece["low"] * piece["low"] + bend * rest * 2.0, F.lit(0.0)))
    return F.least(piece["from"] + F.coalesce(F.try_divide(rest * 2.0, piece["low"] + root), F.lit(0.0)), piece["to"])


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``sized`` (stored) with ``source_size, target, passes, positions``.

    ``passes`` is how often the document is taken, ``positions`` when: one training time for each. Rows that agree in everything
    follow each other. A document without words is taken as often as its neighbours.
    """
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    token = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = sized.withColumn("_token", token).withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    dealt = dealt.withColumn("_bucket", F.floor(F.conv(F.substring("_token", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    named = targets.select(
        F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", "schedule"
    )
    key = ["_none", "_source", "_bucket"]
    sums = dealt.groupBy(*key).agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")).join(named, ["_none", "_source"])
    within = Window.partitionBy(*key).orderBy("_token", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2.0
    # Demand ends inside the last pass; the document whose middle lies before the end still belongs to it.
    passes = F.ceil((F.col("target") - F.col("_middle")) / F.col("source_size"))
    passes = F.when(F.col("source_size") > 0, F.greatest(passes, F.lit(0))).otherwise(0).cast("int")
    at = lambda k: _position((F.col("_middle") + k * F.col("source_size")) / F.col("target"), F.col("schedule"))
    positions = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), at)).otherwise(F.array().cast("array<double>"))
    placed = dealt.join(sums, key).withColumn("_middle", middle).withColumn("passes", passes).withColumn("positions", positions)
    return placed.select(*sized.columns, "source_size", "target", "passes", "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is taken, range-sorted by ``position``; ties by document."""
    taken = mixed.select("*", F.explode("positions").alias("position")).drop("positions")
    return taken.orderBy("position", "doc_id")


def curriculum(docs: DataFrame) -> DataFrame:
    """Each document with its source's figures, how often it is taken and when: ``doc_id, source, size, source_size, target, passes, positions``.

    A NULL source is a source; NULL and blank texts have size 0. A NULL or repeated ``doc_id`` is an id like any other. An empty
    table gives no rows; other columns are ignored.
    """
    sized = stored(word_counts(docs), "sizes")
    return mix(sized, source_targets(sized))
