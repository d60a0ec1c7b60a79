"""Queries over telemetry, feature windows and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.operators import coverage as C, windows as W
from loomwatch.plans.registry import FEATURE_SQL, KEY, QUALITY_SQL, SOURCE_HASH, TEL, observations_sql, query, tidy, windows_sql
from loomwatch.sources import telemetry as S

MINUTES = 60


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.telemetry(S.read_events(spark, sf_dir))


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.feature_windows(tel(spark, sf_dir), MINUTES)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(S.read_events(spark, sf_dir))
    return C.window_quality(wins(spark, sf_dir), C.coverage(obs, MINUTES), MINUTES)


def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with quality, the digest of their events and of their input."""
    hashed = quality(spark, sf_dir).join(W.source_hash(tel(spark, sf_dir), MINUTES), W.KEYS)
    return hashed.withColumn("feature_input_hash", W.input_hash(hashed))


@query(f"WITH {TEL} SELECT event_id, ts, dataset_kind, user_id, host_id, source, event_type, k, process_name, remote_address, remote_port, round(cpu_percent, 6) AS cpu_percent, round(ram_percent, 6) AS ram_percent, result FROM tel")
def s11_telemetry(spark, sf_dir):
    return tidy(tel(spark, sf_dir))


@query(f"WITH {TEL}, {windows_sql()} SELECT {KEY}, window_start + INTERVAL 60 minutes AS window_end, {FEATURE_SQL}, event_count FROM win")
def f1_f9_feature_windows(spark, sf_dir):
    return tidy(wins(spark, sf_dir))


@query(f"WITH {TEL}, {windows_sql(15)} SELECT {KEY}, window_start + INTERVAL 15 minutes AS window_end, {FEATURE_SQL}, event_count FROM win")
def f1_feature_windows_15m(spark, sf_dir):
    return tidy(W.feature_windows(tel(spark, sf_dir), 15))


@query(f"WITH {TEL}, {windows_sql()} SELECT dataset_kind, user_id, host_id, event_type, entity, first AS first_seen FROM fs")
def f5_t6_first_seen(spark, sf_dir):
    return tidy(W.first_seen(W.entity_windows(tel(spark, sf_dir), MINUTES)))


@query(f"WITH {TEL} SELECT dataset_kind, user_id, host_id, time_bucket(INTERVAL '60 minutes', ts) AS window_start, event_type AS key, count(*) AS n FROM tel GROUP BY ALL UNION ALL SELECT dataset_kind, user_id, host_id, time_bucket(INTERVAL '60 minutes', ts), source, count(*) FROM tel GROUP BY ALL")
def f10_counts_by(spark, sf_dir):
    t = tel(spark, sf_dir)
    folded = [W.as_map(W.counts_by(t, MINUTES, c), "m") for c in ("event_type", "source")]
    rows = [m.select(*W.KEYS, F.explode("m").alias("key", "n")) for m in folded]
    return tidy(rows[0].unionByName(rows[1]))


@query(f"WITH {TEL} {SOURCE_HASH}")
def f11_source_hash(spark, sf_dir):
    return tidy(W.source_hash(tel(spark, sf_dir), MINUTES))


_FIXED = ", ".join(f"round({f}, 9)::DECIMAL(28,9)::VARCHAR" for f in W.FEATURES)


@query(f"""WITH {TEL}, {windows_sql()},
h AS ({SOURCE_HASH})
SELECT {KEY}, sha256(concat_ws('|', dataset_kind, user_id, host_id, epoch_us(window_start)::VARCHAR, 'feature-windows-v2', {_FIXED}, source_event_hash)) AS feature_input_hash FROM win JOIN h USING ({KEY})""")
def f12_input_hash(spark, sf_dir):
    w = wins(spark, sf_dir).join(W.source_hash(tel(spark, sf_dir), MINUTES), W.KEYS)
    return tidy(w.select(*W.KEYS, W.input_hash(w).alias("feature_input_hash")))


@query(f"WITH {TEL}, {windows_sql()} SELECT {KEY}, unnest(range(12)) AS position, round(unnest([{', '.join(W.FEATURES)}]), 6) AS value FROM win")
def f13_feature_matrix(spark, sf_dir):
    m = W.feature_matrix(wins(spark, sf_dir))
    return tidy(m.select(*W.KEYS, F.posexplode("vector").alias("position", "value")).withColumn("position", F.col("position").cast("long")))


@query(f"""WITH {TEL}, {windows_sql()}, {observations_sql()},
ok AS (SELECT DISTINCT dataset_kind, user_id, host_id, time_bucket(INTERVAL '60 minutes', observed_at + interval_seconds * INTERVAL 1 second) AS window_start FROM obs WHERE dataset_kind = 'real')
SELECT {KEY}, coalesce(process_count, 0) AS process_count, coalesce(round(max_cpu_percent, 6), 0) AS max_cpu_percent, hour(window_start)::DOUBLE AS hour_of_day, coalesce(event_count, 0) AS event_count FROM win FULL JOIN ok USING ({KEY})""")
def f14_empty_windows(spark, sf_dir):
    """All windows, and those of polls that began as the interval of an event's own poll ended, most of them without events."""
    obs = S.observations(S.read_events(spark, sf_dir)).where("dataset_kind = 'real'")
    later = obs.withColumn("observed_at", F.timestamp_micros(F.unix_micros("observed_at") + F.col("interval_seconds").cast("long") * 1_000_000))
    out = W.with_empty_windows(wins(spark, sf_dir), C.observation_keys(later, MINUTES))
    return tidy(out.select(*W.KEYS, "process_count", "max_cpu_percent", "hour_of_day", "event_count"))


@query(f"WITH {TEL}, {observations_sql()} SELECT {KEY}, collector, coverage FROM cov")
def f15_coverage(spark, sf_dir):
    return tidy(C.coverage(S.observations(S.read_events(spark, sf_dir)), MINUTES))


@query(f"WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL} SELECT * EXCLUDE (reasons) FROM qual")
def f16_window_quality(spark, sf_dir):
    return tidy(quality(spark, sf_dir).select(*W.KEYS, "event_count", "system", "process", "network", "heartbeat_coverage", "quality_status", "gap_seconds"))


@query(f"WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL} SELECT {KEY}, unnest(reasons) AS reason FROM qual")
def f16_quality_reasons(spark, sf_dir):
    return tidy(quality(spark, sf_dir).select(*W.KEYS, F.explode("quality_reasons").alias("reason")))
