"""Timestamps as written by the feeds, UTC days and publication delay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|\+\d{2}:\d{2})$"
_ISO_SIGNED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_BLANK = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:)"


def normalise_timestamp(text: Column, negative_zones: bool = False) -> Column:
    """TIMESTAMP in whole milliseconds; text without a zone is UTC, unreadable text is NULL.

    A zone is ``Z`` or ``+hh:mm``. Zones west of Greenwich are read only on request. A day alone is its midnight, and a blank may
    stand for the ``T``.
    """
    text = F.when(text.rlike(_DAY), F.concat(text, F.lit("T00:00:00"))).otherwise(F.regexp_replace(text, _BLANK, "$1T$2"))
    zone = r"(Z|[+-]\d{2}:\d{2})$" if negative_zones else r"(Z|\+\d{2}:\d{2})$"
    zoned = F.when(text.rlike(zone), text).otherwise(F.concat(text, F.lit("Z")))
    readable = zoned.rlike(_ISO_SIGNED if negative_zones else _ISO)
    return F.date_trunc("MILLISECOND", F.when(readable, F.try_to_timestamp(zoned)))


def iso_millis(ts: Column) -> Column:
    """``2025-09-13T14:55:03.000Z``; the session zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def delay_minutes(published: Column, received: Column) -> Column:
    """Minutes from publication to arrival, never negative."""
    millis = F.unix_millis(received.cast("timestamp")) - F.unix_millis(published.cast("timestamp"))
    return F.greatest(F.lit(0.0), millis / F.lit(60000.0))
