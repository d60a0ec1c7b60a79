"""Reports on collection and data quality, eligibility for training, and snapshot manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.windows import PROFILE, SCHEMA_VERSION
from loomwatch.sources.versioned import Table

# What a profile needs before it is learned from.
DAY_SECONDS, GOOD_WINDOWS, SYNTHETIC_WINDOWS, COVERAGE = 86_400, 96, 12, 0.8
REASONS = {
    "duration": "requires 24 cumulative hours of real collection",
    "usable": "requires 24 cumulative hours of usable real coverage",
    "windows": "not enough good real feature windows",
    "system": "system metrics coverage is insufficient",
    "process": "process collector coverage is insufficient",
    "covers": "cumulative duration is less than usable coverage",
    "synthetic": "not enough synthetic windows",
}


def quality_report(accepted: DataFrame, duplicates: DataFrame, quarantined: DataFrame, windows: DataFrame, minutes: int) -> DataFrame:
    """(metric, key, value): counts of what came, by type and collector, time range, profiles and usable seconds."""
    def one(df: DataFrame, metric: str, value: Column) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")

    def each(df: DataFrame, metric: str, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")

    came = reduce(DataFrame.unionByName, [one(d, "", F.count("*")) for d in (accepted, duplicates, quarantined)])
    good = (F.col("dataset_kind") == "real") & (F.col("quality_status") == "good")
    rows = [
        one(accepted, "accepted", F.count("*")), one(duplicates, "duplicates", F.count("*")), one(quarantined, "quarantined", F.count("*")),
        came.agg(F.sum("value").alias("value")).select(F.lit("received").alias("metric"), F.lit("").alias("key"), "value"),
        each(accepted, "by_type", "event_type"), each(accepted, "by_collector", "source"),
        one(accepted, "first_micros", F.unix_micros(F.min("ts"))), one(accepted, "last_micros", F.unix_micros(F.max("ts"))),
        one(accepted.select("user_id", "host_id").distinct(), "profiles", F.count("*")), one(windows, "usable_seconds", F.count_if(good) * minutes * 60),
        one(windows, "last_window_micros", F.unix_micros(F.max("window_end"))),
    ]
    return reduce(DataFrame.unionByName, rows)


def average_coverage(windows: DataFrame) -> DataFrame:
    """Windows and mean heartbeat coverage of each kind."""
    return windows.groupBy("dataset_kind").agg(F.count("*").alias("windows"), F.avg("heartbeat_coverage").alias("avg_heartbeat_coverage"))


def _spans(sessions: DataFrame, now: str) -> DataFrame:
    """Sessions with seconds, and the gap in seconds since the session before ended (null without one)."""
    at = F.lit(now).cast("timestamp")
    stop = F.when(F.col("status") == "running", at).otherwise(F.coalesce("stopped_at", "last_heartbeat_at", at))
    order = Window.partitionBy(*PROFILE).orderBy("started_at", "session_id")
    rows = sessions.withColumn("_stop", stop)
    seconds = F.greatest(F.lit(0.0), (F.unix_micros("_stop") - F.unix_micros("started_at")) / 1e6)
    apart = (F.unix_micros("started_at") - F.unix_micros(F.lag("_stop").over(order))) / 1e6
    return rows.withColumn("seconds", seconds).withColumn("gap", F.when(apart > 0, apart))


def collection_progress(sessions: DataFrame, now: str) -> DataFrame:
    """Collected seconds, the longest session, gaps and the way to 24 hours of each profile at ``now``."""
    total, longest = F.sum("seconds"), F.max("seconds")
    return _spans(sessions, now).groupBy(*PROFILE).agg(
        total.alias("cumulative_seconds"), longest.alias("longest_seconds"),
        F.sum(F.when(F.col("status") == "running", F.col("seconds")).otherwise(0.0)).alias("current_seconds"),
        F.count("gap").alias("gaps"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_seconds"),
        F.least(F.lit(1.0), total / DAY_SECONDS).alias("progress_to_24h"), (longest >= DAY_SECONDS).alias("continuous_24h"),
    )


def close_stale(sessions: DataFrame) -> DataFrame:
    """A10: running sessions interrupted at their last heartbeat, or where they began without one."""
    running = F.col("status") == "running"
    return sessions.withColumn("stopped_at", F.when(running, F.coalesce("last_heartbeat_at", "started_at")).otherwise(F.col("stopped_at"))).withColumn(
        "status", F.when(running, "interrupted").otherwise(F.col("status"))
    )


def eligibility(windows: DataFrame, progress: DataFrame, minutes: int) -> DataFrame:
    """Whether each profile may be learned from, and the first reason against it."""
    good = F.col("quality_status") == "good"
    found = windows.groupBy(*PROFILE).agg(
        F.count("*").alias("windows"), F.count_if(good).alias("good_windows"), F.count_if(F.col("quality_status") == "degraded").alias("degraded_windows"),
        F.coalesce(F.avg(F.when(good, F.col("system"))), F.lit(0.0)).alias("avg_system"), F.coalesce(F.avg(F.when(good, F.col("process"))), F.lit(0.0)).alias("avg_process"),
    )
    joined = found.join(progress.select(*PROFILE, "cumulative_seconds"), PROFILE, "left").fillna(0.0, ["cumulative_seconds"])
    usable = F.col("good_windows") * minutes * 60
    real = (
        F.when(F.col("cumulative_seconds") < DAY_SECONDS, REASONS["duration"])
        .when(usable < DAY_SECONDS, REASONS["usable"])
        .when(F.col("good_windows") < GOOD_WINDOWS, REASONS["windows"])
        .when(F.col("avg_system") < COVERAGE, REASONS["system"])
        .when(F.col("avg_process") < COVERAGE, REASONS["process"])
        .when(F.col("cumulative_seconds") < usable, REASONS["covers"])
        .otherwise("ready")
    )
    synthetic = F.when(F.col("windows") < SYNTHETIC_WINDOWS, REASONS["synthetic"]).otherwise("ready")
    out = joined.withColumn("usable_seconds", usable).withColumn("reason", F.when(F.col("dataset_kind") == "real", real).otherwise(synthetic))
    return out.withColumn("eligible", F.col("reason") == "ready")


def training_gate(rows: DataFrame, manifest: DataFrame, eligible: DataFrame) -> DataFrame:
    """(profile, reason): ready, or the first reason why a real profile's snapshot is not trained on.

    ``rows`` is the snapshot, ``manifest`` has a row a profile with feature_schema, quality_filters,
    first_start and last_end, ``eligible`` is what ``eligibility`` gives. Synthetic profiles pass.
    """
    found = rows.groupBy(*PROFILE).agg(F.count("*").alias("_n"), F.count_if(F.col("quality_status") != "good").alias("_odd"))
    m = manifest.select(*PROFILE, F.lit(True).alias("_there"), "feature_schema", "quality_filters", "first_start", "last_end")
    joined = found.join(m, PROFILE, "left").join(eligible.select(*PROFILE, "reason"), PROFILE, "left")
    seconds = (F.unix_micros("last_end") - F.unix_micros("first_start")) / 1e6
    reason = (
        F.when(F.col("dataset_kind") != "real", "ready")
        .when(F.coalesce(F.col("reason") != "ready", F.lit(True)), F.concat(F.lit("real training not eligible: "), F.coalesce("reason", F.lit("no windows"))))
        .when(F.col("_there").isNull(), "real snapshot profile does not match rows")
        .when(F.col("feature_schema") != SCHEMA_VERSION, "real snapshot feature schema is incompatible")
        .when(F.col("quality_filters") != F.array(F.lit("good")), "real snapshot must be filtered to good windows")
        .when(F.col("_odd") > 0, "real snapshot contains non-good windows")
        .when(F.col("_n") < GOOD_WINDOWS, "real snapshot requires at least 96 good windows")
        .when(seconds < DAY_SECONDS, "real snapshot requires at least 24 hours of coverage")
        .otherwise("ready")
    )
    return joined.select(*PROFILE, reason.alias("reason"))


def readiness(eligible: DataFrame) -> DataFrame:
    """How many profiles of each kind there are and are ready."""
    return eligible.groupBy("dataset_kind").agg(F.count("*").alias("profiles"), F.count_if("eligible").alias("ready"))


def manifest(snapshot: DataFrame) -> DataFrame:
    """Size, range, quality and coverage of each profile's snapshot."""
    return snapshot.groupBy(*PROFILE).agg(
        F.count("*").alias("window_count"), F.min("window_start").alias("first_start"), F.max("window_end").alias("last_end"),
        F.count_if(F.col("quality_status") == "good").alias("good"), F.count_if(F.col("quality_status") == "degraded").alias("degraded"),
        F.avg("heartbeat_coverage").alias("avg_heartbeat_coverage"), F.min("heartbeat_coverage").alias("min_heartbeat_coverage"), F.sum("event_count").alias("event_count"),
    )


def manifest_events(snapshot: DataFrame, counts: DataFrame) -> DataFrame:
    """Events by type of each profile's snapshot; ``counts`` has (window keys, key, n)."""
    keys = [*PROFILE, "window_start"]
    return snapshot.select(*keys).join(counts, keys).groupBy(*PROFILE, F.col("key").alias("event_type")).agg(F.sum("n").alias("n"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()])


def apply_retention(events: Table, quarantine: Table, cutoff: str, run_id: str) -> None:
    """Real events and quarantined ones from before ``cutoff`` go, each table in one step; synthetic events stay. A run that comes again changes nothing."""
    at = F.lit(cutoff).cast("timestamp")
    hi = events.spark.range(1).select(F.unix_micros(at)).first()[0]
    events.replace_where((F.col("dataset_kind") == "real") & (F.col("ts") < at), run_id, hi=hi)
    quarantine.replace_where(F.col("ts") < at, run_id, hi=hi)
