"""Feature windows of a stream, closed by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwatch.operators.incremental import LATE_MINUTES
from loomwatch.operators.windows import KEYS, PROFILE, entity_of, entity_sums
from loomwatch.session import shared_folder
from loomwatch.sources import telemetry as S


def read_events_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The events files of a folder, and any that come to it later, as a stream of telemetry."""
    schema = spark.read.option("pathGlobFilter", "events*.parquet").parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
    if files_a_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return S.telemetry(reader.parquet(folder))


def closed_parts(events: DataFrame, minutes: int, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """Partial aggregates per profile, window, event type and entity, out once the watermark passes the window's end.

    State holds one small row per entity of an open window, and no sets.
    """
    keyed = events.withColumn("entity", entity_of()).withWatermark("ts", f"{late_minutes} minutes")
    return keyed.groupBy(*PROFILE, F.window("ts", f"{minutes} minutes").alias("w"), "event_type", "entity").agg(*entity_sums())


def window_stream(events: DataFrame, minutes: int, late_minutes: int = LATE_MINUTES) -> DataFrame:
    """Windows per profile, by two aggregates in a row: of each entity, then of each window.

    A window comes out once, when the watermark (``late_minutes`` behind the newest event) passes
    its end; events later than that are dropped. An entity of an open window is a row of state of
    its own, so no row or task holds all entities of a window.
    """
    def entities(kind: str) -> Column:
        return F.count_if((F.col("event_type") == kind) & F.col("entity").isNotNull()).cast("int")

    measures = [
        m
        for x in ("cpu", "ram")
        for m in (
            F.coalesce(F.try_divide(F.sum(f"{x}_sum"), F.sum(f"{x}_n")), F.lit(0.0)).alias(f"avg_{x}_percent"),
            F.coalesce(F.max(f"{x}_max"), F.lit(0.0)).alias(f"max_{x}_percent"),
        )
    ]
    grouped = closed_parts(events, minutes, late_minutes).groupBy(*PROFILE, "w").agg(
        entities("process").alias("process_count"),
        entities("network").alias("network_connection_count"),
        *measures,
        F.sum("ok").alias("auth_success_count"),
        F.sum("failed").alias("auth_failure_count"),
        F.sum("n").alias("event_count"),
    )
    placed = grouped.withColumn("window_start", F.col("w.start")).drop("w")
    return placed.withColumn("hour_of_day", F.hour("window_start").cast("double")).withColumn("activity_density", F.col("event_count") / minutes)


def run_available(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Take in all that the source has, append closed windows to ``path`` and stop; a rerun goes on from there."""
    sink = windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def closed_windows(spark: SparkSession, folder: str, minutes: int = 60) -> DataFrame:
    """The closed windows of the events in ``folder``, by one run of the stream."""
    base = f"{shared_folder(spark)}/window-stream-{uuid.uuid4().hex}"
    stream = window_stream(read_events_stream(spark, folder), minutes)
    run_available(stream, f"{base}/out", f"{base}/state")
    columns = [*KEYS, *[c for c in stream.columns if c not in KEYS]]
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*columns)
