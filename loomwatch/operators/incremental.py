"""Incremental materialisation: watermarks, late events, and the range to compute again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.windows import KEYS, PROFILE, aligned, entity_windows, feature_windows, first_seen

LATE_MINUTES = 60
#: Stands for the model of an evaluation by rules only.
NO_MODEL = "none"


def watermark(events: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(dataset_kind, watermark): the largest event time so far; it never falls."""
    now = events.groupBy("dataset_kind").agg(F.max("ts").alias("watermark"))
    if previous is None:
        return now
    return now.unionByName(previous.select("dataset_kind", "watermark")).groupBy("dataset_kind").agg(F.max("watermark").alias("watermark"))


def lateness(ts: Column, mark: Column, minutes: int = LATE_MINUTES) -> Column:
    """on_time, within or outside the late policy, against the watermark before the batch."""
    boundary = F.unix_micros(mark) - minutes * 60_000_000
    return F.when(mark.isNull() | (ts >= mark), "on_time").when(F.unix_micros(ts) >= boundary, "within").otherwise("outside")


def classify_late(batch: DataFrame, previous: DataFrame, minutes: int = LATE_MINUTES) -> DataFrame:
    """``batch`` with lateness; ``previous`` has one watermark a dataset kind (two rows, broadcast)."""
    marks = F.broadcast(previous.select("dataset_kind", "watermark"))
    return batch.join(marks, "dataset_kind", "left").withColumn("lateness", lateness(F.col("ts"), F.col("watermark"), minutes))


def late_audit(classified: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """T4: the first record of each late event, none that is stored."""
    first = Window.partitionBy("dataset_kind", "event_id").orderBy("ingested_at")
    late = classified.where("lateness <> 'on_time'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    late = late.select("dataset_kind", "event_id", "ts", "ingested_at", "lateness")
    return late if stored is None else late.join(stored.select("dataset_kind", "event_id"), ["dataset_kind", "event_id"], "left_anti")


def affected_range(classified: DataFrame, minutes: int) -> DataFrame:
    """(dataset_kind, range_start, range_end) to compute again; the end is open (null) after a late row."""
    w = aligned(F.col("ts"), minutes)
    rows = classified.where("lateness <> 'outside'").groupBy("dataset_kind").agg(
        F.min(w).alias("range_start"), F.max(w).alias("last"), F.max((F.col("lateness") == "within").cast("int")).alias("late")
    )
    return rows.select("dataset_kind", "range_start", F.when(F.col("late") == 0, F.col("last") + F.make_interval(mins=F.lit(minutes))).alias("range_end"))


def novelty_baseline(events: DataFrame, before: DataFrame, minutes: int) -> DataFrame:
    """T5: entities first seen before each kind's range start."""
    parts = entity_windows(events.join(F.broadcast(before.select("dataset_kind", "range_start")), "dataset_kind").where(F.col("ts") < F.col("range_start")), minutes)
    return first_seen(parts)


def cursor(rows: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """The last (time, id) of each kind."""
    last = F.max(F.struct(time_col, id_col))
    return rows.groupBy("dataset_kind").agg(last.alias("c")).select("dataset_kind", F.col(f"c.{time_col}").alias(time_col), F.col(f"c.{id_col}").alias(id_col))


def after_cursor(rows: DataFrame, cursors: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """Rows past their kind's cursor."""
    c = F.broadcast(cursors.select("dataset_kind", F.col(time_col).alias("_t"), F.col(id_col).alias("_i")))  # a row a kind
    joined = rows.join(c, "dataset_kind", "left")
    return joined.where(F.col("_t").isNull() | (F.struct(time_col, id_col) > F.struct("_t", "_i"))).drop("_t", "_i")


@dataclass
class State:
    """What a materialisation leaves: events taken so far, windows, watermarks and the late audit."""

    events: DataFrame
    windows: DataFrame
    marks: DataFrame
    audit: DataFrame


def materialize_increment(state: State | None, batch: DataFrame, minutes: int, late_minutes: int = LATE_MINUTES) -> State:
    """Take a batch in; only windows of the affected range are computed again.

    Events outside the late policy are audited and left out, of the novelty baseline too, so the
    result equals a rebuild over the accepted events. An empty batch changes nothing.
    """
    if batch.isEmpty():
        if state is None:
            raise ValueError("the first batch is empty")
        return state
    if state is None:
        windows = feature_windows(batch, minutes)
        none = classify_late(batch, watermark(batch).where("false"), late_minutes)
        return State(batch, windows, watermark(batch), late_audit(none))
    classified = classify_late(batch, state.marks, late_minutes)
    audit = late_audit(classified, state.audit)
    taken = classified.where("lateness <> 'outside'").drop("watermark", "lateness")
    events = state.events.unionByName(taken)
    ranges = F.broadcast(affected_range(classified, minutes))
    inside = (F.col("window_start") >= F.col("range_start")) & (F.col("range_end").isNull() | (F.col("window_start") < F.col("range_end")))
    keyed = events.withColumn("window_start", aligned(F.col("ts"), minutes)).join(ranges, "dataset_kind")
    baseline = novelty_baseline(events, ranges, minutes)
    fresh = feature_windows(keyed.where(inside).drop("window_start", "range_start", "range_end"), minutes, baseline)
    kept = state.windows.join(ranges, "dataset_kind", "left").where(~F.coalesce(inside, F.lit(False))).select(*state.windows.columns)
    return State(events, kept.unionByName(fresh), watermark(taken, state.marks), state.audit.unionByName(audit))


def detection_watermark(evaluations: DataFrame) -> DataFrame:
    """The last window (start, then id) evaluated per profile, policy and model, and how many were."""
    last = F.max(F.struct("window_start", "window_id")).alias("last")
    found = evaluations.groupBy(*PROFILE, "policy_hash", F.coalesce("model_id", F.lit(NO_MODEL)).alias("model_id")).agg(last, F.count("*").alias("evaluated"))
    return found.select(*PROFILE, "policy_hash", "model_id", "last.window_start", "last.window_id", "evaluated")


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows of ``new`` over those of ``old``; created_at stays what it was first."""
    o = old.select(*keys, F.col("created_at").alias("_was"))
    fresh = new.join(o, keys, "left").withColumn("created_at", F.coalesce("_was", "created_at")).drop("_was")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh)
