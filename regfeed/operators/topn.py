"""Newest or oldest N per feed, and hash-ordered bottom-k, without sorting the data.

Positions are nearly gap-free integers, so counting rows per zone of positions finds the zone that holds the
N-th row; only rows from that zone on are ranked. The cut is applied as literals, which the Parquet reader uses
to skip row groups: reading the newest 100 of a long feed touches its tail only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE_WIDTH = 65_536
# Groups whose cut is passed as literals; beyond it the cut is joined instead.
MAX_LITERAL_GROUPS = 64


def literal(value, like: DataFrame, column: str) -> Column:
    """A collected value as a literal of the column's own type, so that comparing it needs no cast of the column."""
    return F.lit(str(value)).cast(like.schema[column].dataType)


def _cut(df: DataFrame, cuts: DataFrame, group: Sequence[str], position: str, newest: bool) -> DataFrame:
    """Keep rows at or beyond each group's cut position (column ``_cut``)."""
    rows = cuts.limit(MAX_LITERAL_GROUPS + 1).collect()
    if len(rows) > MAX_LITERAL_GROUPS:
        named = cuts.select(*[F.col(g).alias(f"_at_{g}") for g in group], "_cut")
        kept = df.join(named, reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_at_{g}")) for g in group])).drop(*[f"_at_{g}" for g in group])
        beyond = F.col(position) >= F.col("_cut") if newest else F.col(position) <= F.col("_cut")
        return kept.where(beyond).drop("_cut")
    if not rows:
        return df.where(F.lit(False))
    clauses = []
    for row in rows:
        edge = literal(row["_cut"], df, position)
        beyond = F.col(position) >= edge if newest else F.col(position) <= edge
        clauses.append(reduce(Column.__and__, [F.col(g).eqNullSafe(F.lit(row[g]).cast(df.schema[g].dataType)) for g in group], beyond))
    return df.where(reduce(Column.__or__, clauses))


def first_rows(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    n: int,
    ties: Sequence[str] = (),
    newest: bool = True,
    zone_width: int = ZONE_WIDTH,
    rank: str = "rank",
) -> DataFrame:
    """The ``n`` newest (or oldest) rows of every group, ranked from 1; without a group, of the whole table, unranked."""
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in (position, *ties)]
    if not group:
        # A limited sort keeps n rows per task.
        return df.where(F.col(position).isNotNull()).orderBy(*order).limit(n)
    zone = F.floor(F.col(position) / F.lit(zone_width)).cast("bigint")
    zones = df.groupBy(*group, zone.alias("_zone")).agg(F.count(F.lit(1)).alias("_rows"))
    zone_order = F.col("_zone").desc() if newest else F.col("_zone").asc()
    # One row per zone, so the window is small.
    nearer = Window.partitionBy(*group).orderBy(zone_order).rowsBetween(Window.unboundedPreceding, -1)
    needed = zones.withColumn("_nearer", F.coalesce(F.sum("_rows").over(nearer), F.lit(0))).where(F.col("_nearer") < n)
    edge = F.min("_zone") * zone_width if newest else F.max("_zone") * zone_width + (zone_width - 1)
    cuts = needed.groupBy(*group).agg(edge.alias("_cut")).where(F.col("_cut").isNotNull())
    tail = _cut(df, cuts, group, position, newest)
    # rank <= n on row_number is limited per input partition before its shuffle, ties included.
    return tail.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def rows_at_max(df: DataFrame, group: Sequence[str], position: str) -> DataFrame:
    """Rows holding their group's greatest position: a narrow hash aggregate, then a literal filter."""
    peaks = df.groupBy(*group).agg(F.max(position).alias("_cut"))
    return _cut(df, peaks.where(F.col("_cut").isNotNull()), group, position, newest=True)


def bottom_k(df: DataFrame, token: Column, k: int) -> DataFrame:
    """The ``k`` rows with the smallest md5 token: a seeded, repeatable uniform sample.

    One pass: every task keeps its own ``k`` smallest, and only those are brought together.
    """
    return df.withColumn("token", token).orderBy("token").limit(k)
