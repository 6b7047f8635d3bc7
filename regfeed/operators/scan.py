"""Running totals, maxima and row numbers over groups of any size.

A plain window puts a whole group into one task; with nine feeds, that is a third of the data in one place.
Here the rows are range-partitioned by (group, order) into buckets of equal size, stored once, and each
bucket is scanned on its own with the carry of the buckets before it. A group continues into the next bucket
at most once per bucket boundary, so the carry table has fewer rows than there are buckets and is safe to
broadcast. NULL is a group of its own; the order must be total for row-exact results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regfeed.session import materialise

BUCKET = "_bucket"
CARRY = "_carry"


def into_buckets(df: DataFrame, group: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Equal-sized, ordered buckets with a stored bucket number.

    Without a number, adaptive execution joins neighbouring ranges until buckets have the advisory size; neighbours
    keep their order. The bucket number comes from the physical partition, so it must be written before it is used
    twice. Pass narrow rows: the range boundaries come from a sample, which reads the input once more.
    """
    by = [*group, *order]
    ranged = df.repartitionByRange(*by) if buckets is None else df.repartitionByRange(buckets, *by)
    return materialise(ranged.withColumn(BUCKET, F.spark_partition_id()), "buckets")


def _with_carry(bucketed: DataFrame, group: Sequence[str], total: Column, merge) -> DataFrame:
    """Attach, per (bucket, group), the merged total of that group's earlier buckets."""
    totals = bucketed.groupBy(BUCKET, *group).agg(total.alias("_total"))
    # One row per (bucket, group): a group has at most as many rows here as there are buckets.
    earlier = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = merge("_total").over(earlier).alias(CARRY)
    # NULL is a group like any other, so keys are compared null-safely.
    keys = [BUCKET, *group]
    carries = totals.select(*keys, carried).where(F.col(CARRY).isNotNull()).select(*[F.col(c).alias(f"_at_{c}") for c in keys], CARRY)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys])
    return bucketed.join(F.broadcast(carries), same, "left").drop(*[f"_at_{c}" for c in keys])


def _within(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(BUCKET, *group).orderBy(*order)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    before: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` in each group; ``before=True`` leaves the current row out."""
    bucketed = into_buckets(df.withColumn("_value", value.cast("bigint")), group, order, buckets)
    last = -1 if before else Window.currentRow
    frame = _within(group, order).rowsBetween(Window.unboundedPreceding, last)
    scanned = _with_carry(bucketed, group, F.sum("_value"), F.sum)
    total = F.coalesce(F.sum("_value").over(frame), F.lit(0)) + F.coalesce(F.col(CARRY), F.lit(0))
    return scanned.withColumn(out, total).drop(BUCKET, CARRY, "_value")


def running_number(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """Row number from 0 in each group."""
    return running_total(df, group, order, F.lit(1), out, before=True, buckets=buckets)


def max_before(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, buckets: int | None = None
) -> DataFrame:
    """Greatest ``value`` among the earlier rows of the group, NULL on the first."""
    bucketed = into_buckets(df, group, order, buckets)
    frame = _within(group, order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = _with_carry(bucketed, group, F.max(value), F.max)
    # greatest() skips NULLs, so a missing carry or an empty frame leaves the other operand.
    return scanned.withColumn(out, F.greatest(F.max(value).over(frame), F.col(CARRY))).drop(BUCKET, CARRY)
