"""The buffer table: one row per (feed, position), first writer wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("stream_path", "timepoint")


def first_of_each(batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of every key.

    An aggregate, so copies of one key are reduced to one row in every task before the shuffle; a key that holds
    a third of the batch costs no more than any other.
    """
    rest = [c for c in batch.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*key).agg(first.alias("_first")).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def key_range(batch: DataFrame, position: str = "timepoint") -> Column | None:
    """Filter on the positions a batch spans, as literals; NULL-free and one row on the driver."""
    low, high = batch.agg(F.min(position), F.max(position)).first()
    return None if low is None else F.col(position).between(low, high)


def insert_ignore(batch: DataFrame, table: DataFrame, key: Sequence[str], order: Sequence[str], position: str = "timepoint") -> DataFrame:
    """Rows of the batch to append: first of each key, and only keys the table does not hold.

    Only the stretch of the table that the batch spans is read: the range reaches the Parquet scan and skips the
    row groups of older positions.
    """
    span = key_range(batch, position)
    fresh = first_of_each(batch, key, order)
    if span is None:
        return fresh
    held = table.where(span).select(*key)
    return fresh.join(held, list(key), "left_anti")


def normalised(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buffer rows, and the rows whose timestamp could not be read."""
    bad = F.col("published_at").isNull() | F.col("timepoint").isNull()
    return lines.where(~bad), lines.where(bad)
