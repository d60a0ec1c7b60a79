"""Scans of events, polls and windows, by kind, range and keyset cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_scan(events: DataFrame, dataset_kind: str | None = None, event_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events of a kind and type in (ts, event_id) order, a page of them where ``limit`` is given."""
    for column, value in (("dataset_kind", dataset_kind), ("event_type", event_type)):
        if value is not None:
            events = events.where(F.col(column) == value)
    ordered = events.orderBy("ts", "event_id")
    return ordered.offset(offset).limit(limit) if limit is not None else ordered.offset(offset)


def time_range(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows in [start, end)."""
    t = F.col(column)
    return rows.where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))


def overlapping(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Polls whose interval meets [start, end)."""
    until = F.unix_micros("observed_at") + F.col("interval_seconds").cast("long") * 1_000_000
    return observations.where((F.col("observed_at") < F.lit(end).cast("timestamp")) & (until > F.unix_micros(F.lit(start).cast("timestamp"))))


def window_scan(
    windows: DataFrame, dataset_kind: str, quality: tuple[str, ...], start: str, end: str, after: tuple[str, str, str] | None = None, limit: int | None = None
) -> DataFrame:
    """Windows of a kind and of given quality in [start, end), past the key (start, user, host) of ``after``, in its order."""
    order = ("window_start", "user_id", "host_id")
    found = time_range(windows.where((F.col("dataset_kind") == dataset_kind) & F.col("quality_status").isin(*quality)), "window_start", start, end)
    if after is not None:
        found = found.where(F.struct(*order) > F.struct(F.lit(after[0]).cast("timestamp"), F.lit(after[1]), F.lit(after[2])))
    ordered = found.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def without_kind(rows: DataFrame, dataset_kind: str) -> DataFrame:
    """What is left when one dataset kind is cleared."""
    return rows.where(F.col("dataset_kind") != dataset_kind)
