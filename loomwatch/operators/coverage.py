"""Collector coverage of windows, and the quality that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.operators.windows import KEYS, PROFILE, aligned

# Coverage thresholds.
GOOD, PARTIAL = 0.8, 0.5
# What the quality of a window is said to follow from.
PASSED, NO_TELEMETRY = "quality checks passed", "no synthetic telemetry"
NO_POLLS = "no collector observations cover window"
NETWORK_LOW = "network collector coverage below 80 percent"
CORE_PARTIAL = "core collector coverage is partial"
CORE_LOW = "system metrics or process collector coverage is insufficient"
NO_SYSTEM = "system metrics collector did not poll"
NO_PROCESS = "process collector did not poll"


def observation_keys(observations: DataFrame, minutes: int) -> DataFrame:
    """the windows in which a poll began, failed polls too."""
    return observations.select(*PROFILE, aligned(F.col("observed_at"), minutes).alias("window_start")).distinct()


def coverage(observations: DataFrame, minutes: int) -> DataFrame:
    """(window keys, collector, coverage) over successful polls.

    A poll vouches for [t, t + max(1, interval)). It is dealt to the windows that it touches, so
    poll and window meet by equality and no range join is planned. Overlaps add up, to 1 at most.
    """
    size = minutes * 60_000_000
    begin = F.unix_micros("observed_at")
    end = begin + F.greatest(F.lit(1), "interval_seconds").cast("long") * 1_000_000
    first = F.floor(begin / size).cast("long")
    last = F.floor((end - 1) / size).cast("long")
    touched = observations.where("successful").select(*PROFILE, "collector", begin.alias("b"), end.alias("e"), F.explode(F.sequence(first, last)).alias("w"))
    overlap = F.least("e", (F.col("w") + 1) * size) - F.greatest("b", F.col("w") * size)
    per = touched.groupBy(*PROFILE, F.timestamp_micros(F.col("w") * size).alias("window_start"), "collector").agg(F.sum(overlap).alias("covered"))
    return per.select(*KEYS, "collector", F.round(F.least(F.lit(1.0), F.col("covered") / size), 4).alias("coverage"))


def window_quality(windows: DataFrame, covered: DataFrame, minutes: int) -> DataFrame:
    """F16: ``windows`` with coverage by core collector, heartbeat_coverage (the best of all collectors),
    quality_status, quality_reasons and gap_seconds."""
    def of(collector: str) -> Column:
        return F.max(F.when(F.col("collector") == collector, F.col("coverage"))).alias(collector)

    wide = covered.groupBy(*KEYS).agg(F.max("coverage").alias("_best"), *map(of, ("system", "process", "network")))
    joined = windows.join(wide, KEYS, "left")
    no_system, no_process = F.col("system").isNull(), F.col("process").isNull()
    system, process, network, best = (F.coalesce(c, F.lit(0.0)) for c in ("system", "process", "network", "_best"))
    core, partial = (system >= GOOD) & (process >= GOOD), (system >= PARTIAL) & (process >= PARTIAL)
    real = F.when(best <= 0, "insufficient").when(core & (network >= GOOD), "good").when(core | partial, "degraded").otherwise("insufficient")
    reason = (
        F.when(best <= 0, NO_POLLS)
        .when(core, F.when(network < GOOD, NETWORK_LOW))
        .when(partial, CORE_PARTIAL)
        .otherwise(CORE_LOW)
    )
    told = F.array_compact(F.array(reason, F.when(no_system, NO_SYSTEM), F.when(no_process, NO_PROCESS)))
    real_reasons = F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(PASSED)))
    some = F.col("event_count") > 0
    is_real = F.col("dataset_kind") == "real"
    heartbeat = F.when(is_real, best).otherwise(F.when(some, 1.0).otherwise(0.0))
    return joined.select(
        *windows.columns, system.alias("system"), process.alias("process"), network.alias("network"), heartbeat.alias("heartbeat_coverage"),
        F.when(is_real, real).otherwise(F.when(some, "good").otherwise("insufficient")).alias("quality_status"),
        F.when(is_real, real_reasons).otherwise(F.array(F.when(some, PASSED).otherwise(NO_TELEMETRY))).alias("quality_reasons"),
        F.round((1 - heartbeat) * minutes * 60, 4).alias("gap_seconds"),
    )
