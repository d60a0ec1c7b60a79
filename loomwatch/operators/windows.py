"""Feature windows: tumbling aggregates per profile with novelty against all earlier windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE = ["dataset_kind", "user_id", "host_id"]
KEYS = [*PROFILE, "window_start"]
# The feature vector's names and order.
FEATURES = [
    "process_count", "new_process_count", "network_connection_count", "new_remote_count", "avg_cpu_percent", "max_cpu_percent",
    "avg_ram_percent", "max_ram_percent", "auth_success_count", "auth_failure_count", "hour_of_day", "activity_density",
]
SCHEMA_VERSION = "feature-windows-v2"
#: Events of so many seconds share a digest of the first level.
HASH_SECONDS = 60


def aligned(ts: Column, minutes: int) -> Column:
    """the start of the window of ``ts``; ``minutes`` divides a day, so windows begin at midnight."""
    if 1440 % minutes:
        raise ValueError("the window length must divide a day")
    size = minutes * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / size).cast("long") * size)


def entity_of() -> Column:
    """What an event makes known: a process name, or address and port; null for other events."""
    remote = F.concat_ws(":", "remote_address", F.col("remote_port").cast("string"))
    return F.when(F.col("event_type") == "process", F.col("process_name")).when(F.col("event_type") == "network", remote)


def entity_sums() -> list[Column]:
    """The partial aggregates that windows are made of; they can be summed further."""
    cpu, ram = F.col("cpu_percent"), F.col("ram_percent")
    return [
        F.count("*").alias("n"),
        F.sum(cpu).alias("cpu_sum"), F.count(cpu).alias("cpu_n"), F.max(cpu).alias("cpu_max"),
        F.sum(ram).alias("ram_sum"), F.count(ram).alias("ram_n"), F.max(ram).alias("ram_max"),
        F.count_if(F.col("result") == "success").alias("ok"), F.count_if(F.col("result") == "failure").alias("failed"),
    ]


def entity_windows(events: DataFrame, minutes: int) -> DataFrame:
    """Partial aggregates per profile, window, event type and entity: the only pass over events."""
    keyed = events.withColumn("window_start", aligned(F.col("ts"), minutes)).withColumn("entity", entity_of())
    return keyed.groupBy(*KEYS, "event_type", "entity").agg(*entity_sums())


def first_seen(parts: DataFrame) -> DataFrame:
    """(profile, event_type, entity, first_seen): the novelty baseline as rows."""
    known = parts.where(F.col("entity").isNotNull())
    return known.groupBy(*PROFILE, "event_type", "entity").agg(F.min("window_start").alias("first_seen"))


def _flag_new(parts: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """``parts`` with is_new: the entity's first window, and not in the baseline of earlier ones.

    The first window of an entity is a windowed minimum over its own rows, at most one a window.
    """
    if baseline is None:
        per_entity = Window.partitionBy(*PROFILE, "event_type", "entity")
        return parts.withColumn("is_new", F.col("entity").isNotNull() & (F.min("window_start").over(per_entity) == F.col("window_start")))
    fresh = first_seen(parts)
    both = fresh.unionByName(baseline.select(*PROFILE, "event_type", "entity", "first_seen")).groupBy(*PROFILE, "event_type", "entity").agg(F.min("first_seen").alias("first_seen"))
    joined = parts.join(both, [*PROFILE, "event_type", "entity"], "left")
    return joined.withColumn("is_new", F.coalesce(F.col("first_seen") == F.col("window_start"), F.lit(False))).drop("first_seen")


def feature_windows(events: DataFrame, minutes: int = 15, baseline: DataFrame | None = None) -> DataFrame:
    """One row per profile and window with the twelve features and the event count.

    ``baseline`` holds entities seen before the first of these windows (T5).
    """
    return windows_of_parts(entity_windows(events, minutes), minutes, baseline)


def windows_of_parts(parts: DataFrame, minutes: int, baseline: DataFrame | None = None) -> DataFrame:
    """F1-F9 from the partial aggregates of ``entity_windows``."""
    return windows_of_flagged(_flag_new(parts, baseline), minutes)


def windows_of_flagged(parts: DataFrame, minutes: int) -> DataFrame:
    """F1-F9 from partial aggregates that tell which entities are new."""
    def of(kind: str) -> Column:
        return (F.col("event_type") == kind) & F.col("entity").isNotNull()

    out = parts.groupBy(*KEYS).agg(
        F.count_if(of("process")).cast("double").alias("process_count"),
        F.count_if(of("process") & F.col("is_new")).cast("double").alias("new_process_count"),
        F.count_if(of("network")).cast("double").alias("network_connection_count"),
        F.count_if(of("network") & F.col("is_new")).cast("double").alias("new_remote_count"),
        F.coalesce(F.try_divide(F.sum("cpu_sum"), F.sum("cpu_n")), F.lit(0.0)).alias("avg_cpu_percent"),
        F.coalesce(F.max("cpu_max"), F.lit(0.0)).alias("max_cpu_percent"),
        F.coalesce(F.try_divide(F.sum("ram_sum"), F.sum("ram_n")), F.lit(0.0)).alias("avg_ram_percent"),
        F.coalesce(F.max("ram_max"), F.lit(0.0)).alias("max_ram_percent"),
        F.sum("ok").cast("double").alias("auth_success_count"),
        F.sum("failed").cast("double").alias("auth_failure_count"),
        F.sum("n").alias("event_count"),
    )
    return out.select(
        *KEYS,
        (F.col("window_start") + F.make_interval(mins=F.lit(minutes))).alias("window_end"),
        *FEATURES[:10],
        F.hour("window_start").cast("double").alias("hour_of_day"),
        (F.col("event_count") / minutes).alias("activity_density"),
        "event_count",
    )


def counts_by(events: DataFrame, minutes: int, column: str) -> DataFrame:
    """(window keys, key, n) by event type or source; ``as_map`` folds it."""
    return events.groupBy(*PROFILE, aligned(F.col("ts"), minutes).alias("window_start"), F.col(column).alias("key")).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, name: str) -> DataFrame:
    """one sorted map per window; it has as many entries as there are event types or sources."""
    entries = F.array_sort(F.collect_list(F.struct("key", "n")))
    return counts.groupBy(*KEYS).agg(F.map_from_entries(entries).alias(name))


def source_hash(events: DataFrame, minutes: int, span_seconds: int = HASH_SECONDS) -> DataFrame:
    """a digest of each window's events, in two levels.

    The events of each ``span_seconds`` of a window have a digest, over the digests of each in the
    order (id, time, type); the window's is over those of its spans in the order of time. So no row
    gathers more than a span's events, or one digest a span.
    """
    size = span_seconds * 1_000_000
    each = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.unix_micros("ts").cast("string"), "event_type"), 256)
    keyed = events.select(*PROFILE, aligned(F.col("ts"), minutes).alias("window_start"), F.floor(F.unix_micros("ts") / size).alias("span"), F.struct("event_id", each.alias("d")).alias("e"))

    def over(entries: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(entries), lambda x: x["d"]), ""), 256)

    spans = keyed.groupBy(*KEYS, "span").agg(over(F.collect_list("e")).alias("d"))
    return spans.groupBy(*KEYS).agg(over(F.collect_list(F.struct("span", "d"))).alias("source_event_hash"))


def fixed(x: Column) -> Column:
    """A number's text that engines agree on: nine decimals."""
    return F.round(x, 9).cast("decimal(28,9)").cast("string")


def input_hash(windows: DataFrame) -> Column:
    """the digest of a window's key, feature values and source hash."""
    parts = [*PROFILE, F.unix_micros("window_start").cast("string"), F.lit(SCHEMA_VERSION), *[fixed(F.col(f)) for f in FEATURES], "source_event_hash"]
    return F.sha2(F.concat_ws("|", *parts), 256)


def feature_matrix(windows: DataFrame) -> DataFrame:
    """(keys, vector): the twelve features as one array, in order."""
    return windows.select(*KEYS, F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("vector"))


def with_empty_windows(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """windows joined by keys that have no events, their features zero."""
    missing = keys.select(*KEYS).distinct()
    joined = windows.join(missing, KEYS, "full_outer")
    zero = [F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in FEATURES if f != "hour_of_day"]
    named = {f: c for f, c in zip([f for f in FEATURES if f != "hour_of_day"], zero, strict=True)}
    named["hour_of_day"] = F.hour("window_start").cast("double").alias("hour_of_day")
    return joined.select(*KEYS, *[named[f] for f in FEATURES], F.coalesce("event_count", F.lit(0)).alias("event_count"))
