"""Where queries and their SQL are registered, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name; ``sql`` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, timestamps without zone: what both engines write alike."""
    cast = {"double": lambda c: F.round(c, 6), "timestamp": lambda c: F.col(c).cast("timestamp_ntz")}
    return df.select(*[cast[t](c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


KEY = "dataset_kind, user_id, host_id, window_start"
TEL = """
raw AS (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k,
  CASE event_type WHEN 'click' THEN 'process' WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'system_metrics' ELSE 'authentication' END AS kind
  FROM events),
tel AS (
  SELECT event_id, ts, CASE WHEN user_id % 10 < 5 THEN 'real' ELSE 'synthetic' END AS dataset_kind,
    'user-' || (user_id % 10) AS user_id, 'host-' || (user_id % 10 % 2) AS host_id,
    (['system', 'process', 'network'])[event_id % 3 + 1] AS source, kind AS event_type, k,
    CASE WHEN kind = 'process' THEN 'proc-' || k END AS process_name,
    CASE WHEN kind = 'network' THEN '198.51.100.' || k END AS remote_address,
    CASE WHEN kind = 'network' THEN (1000 + event_id % 50)::INT END AS remote_port,
    CASE WHEN kind = 'system_metrics' THEN least(100.0::DOUBLE, value) END AS cpu_percent,
    CASE WHEN kind = 'system_metrics' THEN least(100.0::DOUBLE, value * 0.9::DOUBLE + 5) END AS ram_percent,
    CASE event_type WHEN 'signup' THEN 'success' WHEN 'error' THEN 'failure' END AS result
  FROM raw)"""


#: The digest of each window's events, minute by minute.
SOURCE_HASH = f"""SELECT {KEY}, sha256(string_agg(d, '' ORDER BY span)) AS source_event_hash FROM (
  SELECT dataset_kind, user_id, host_id, time_bucket(INTERVAL '60 minutes', ts) AS window_start, epoch_us(ts) // 60000000 AS span,
    sha256(string_agg(sha256(event_id || '|' || epoch_us(ts) || '|' || event_type), '' ORDER BY event_id)) AS d FROM tel GROUP BY ALL) GROUP BY {KEY}"""


def windows_sql(minutes: int = 60, source: str = "tel") -> str:
    """CTEs e, fs and win: the feature windows."""
    return f"""
e AS (SELECT *, time_bucket(INTERVAL '{minutes} minutes', ts) AS window_start,
  CASE event_type WHEN 'process' THEN process_name WHEN 'network' THEN remote_address || ':' || remote_port END AS entity FROM {source}),
fs AS (SELECT dataset_kind, user_id, host_id, event_type, entity, min(window_start) AS first FROM e WHERE entity IS NOT NULL GROUP BY ALL),
win AS (
  SELECT {KEY},
    count(DISTINCT entity) FILTER (WHERE event_type = 'process')::DOUBLE AS process_count,
    count(DISTINCT entity) FILTER (WHERE event_type = 'process' AND first = window_start)::DOUBLE AS new_process_count,
    count(DISTINCT entity) FILTER (WHERE event_type = 'network')::DOUBLE AS network_connection_count,
    count(DISTINCT entity) FILTER (WHERE event_type = 'network' AND first = window_start)::DOUBLE AS new_remote_count,
    coalesce(avg(cpu_percent), 0) AS avg_cpu_percent, coalesce(max(cpu_percent), 0) AS max_cpu_percent,
    coalesce(avg(ram_percent), 0) AS avg_ram_percent, coalesce(max(ram_percent), 0) AS max_ram_percent,
    count(*) FILTER (WHERE result = 'success')::DOUBLE AS auth_success_count,
    count(*) FILTER (WHERE result = 'failure')::DOUBLE AS auth_failure_count,
    hour(window_start)::DOUBLE AS hour_of_day, count(*) / {minutes}.0::DOUBLE AS activity_density, count(*) AS event_count
  FROM e LEFT JOIN fs USING (dataset_kind, user_id, host_id, event_type, entity) GROUP BY ALL)"""


FEATURE_SQL = """process_count, new_process_count, network_connection_count, new_remote_count,
  round(avg_cpu_percent, 6) AS avg_cpu_percent, round(max_cpu_percent, 6) AS max_cpu_percent,
  round(avg_ram_percent, 6) AS avg_ram_percent, round(max_ram_percent, 6) AS max_ram_percent,
  auth_success_count, auth_failure_count, hour_of_day, round(activity_density, 6) AS activity_density"""

RISK_SQL = "CASE WHEN detection_score >= 90 THEN 'critical' WHEN detection_score >= 75 THEN 'high' WHEN detection_score >= 55 THEN 'medium' WHEN detection_score >= 35 THEN 'low' ELSE 'none' END"


def decisions_sql(new_remote: float = 2, network: float = 2, failures: float = 3, activity: float = 0.05, gate: float = 0) -> str:
    """CTEs sg, rk and dec over win: signals, their ranks and the decisions (the scaled policy); ``gate`` is the least activity of two rules."""
    return f"""
sig AS (
  SELECT {KEY}, 'rare-process-v1' AS signal_id, new_process_count >= 1 AND process_count >= 1 AND activity_density >= 0 AS m,
    60 + greatest(0, new_process_count - 1) * 5 AS s FROM win
  UNION ALL SELECT {KEY}, 'new-remote-spike-v1', new_remote_count >= {new_remote} AND network_connection_count >= {network} AND activity_density >= {gate}::DOUBLE,
    66 + greatest(0, new_remote_count - {new_remote}) * 2 FROM win
  UNION ALL SELECT {KEY}, 'unusual-hour-activity-v1', (hour_of_day >= 22 OR hour_of_day <= 5) AND activity_density >= {activity}::DOUBLE AND process_count + network_connection_count >= 1,
    58 + greatest(0, activity_density - {activity}::DOUBLE) FROM win
  UNION ALL SELECT {KEY}, 'resource-pressure-v1', avg_cpu_percent >= 70 OR max_cpu_percent >= 90 OR avg_ram_percent >= 85 OR max_ram_percent >= 90,
    64 + greatest(0, greatest(max_cpu_percent, max_ram_percent) - 70) FROM win
  UNION ALL SELECT {KEY}, 'authentication-failure-burst-v1', auth_failure_count >= {failures} AND auth_success_count <= 100000 AND activity_density >= {gate}::DOUBLE,
    70 + greatest(0, auth_failure_count - {failures}) * 3 FROM win),
sg AS (SELECT {KEY}, signal_id, m AS matched, CASE WHEN m THEN least(100, trunc(s)::INT) ELSE 0 END AS strength FROM sig),
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY strength DESC, signal_id) AS r FROM sg WHERE matched),
fu AS (
  SELECT {KEY}, count(*)::INT AS n_matched, max(signal_id) FILTER (WHERE r = 1) AS primary_signal, max(strength) FILTER (WHERE r = 1) AS ps,
    coalesce(sum(round_even(strength * 0.25, 0)) FILTER (WHERE r > 1), 0) AS others, string_agg(signal_id, ',' ORDER BY signal_id) AS rules
  FROM rk GROUP BY ALL),
d0 AS (
  SELECT win.*, coalesce(n_matched, 0) AS n_matched, primary_signal, coalesce(rules, '') AS rules,
    CASE WHEN n_matched IS NULL THEN 0 ELSE least(100, ps + others + least(12, 4 * (n_matched - 1))) END::INT AS detection_score
  FROM win LEFT JOIN fu USING ({KEY})),
dec AS (SELECT *, {RISK_SQL} AS risk_level, CASE WHEN detection_score >= 55 THEN 'finding' ELSE 'no_finding' END AS status,
  left(sha256(concat_ws('|', dataset_kind, user_id, host_id, coalesce(primary_signal, ''), rules, 'scaled', 'rules')), 24) AS fingerprint FROM d0)"""


def observations_sql(minutes: int = 60) -> str:
    """CTEs obs, cov (coverage by collector) and wide."""
    return f"""
obs AS (SELECT event_id AS observation_id, dataset_kind, user_id, host_id, source AS collector, ts AS observed_at,
  (1800 + 900 * (event_id % 4))::INT AS interval_seconds, event_id % 9 <> 0 AS successful FROM tel),
touch AS (SELECT dataset_kind, user_id, host_id, collector, epoch_us(observed_at) AS b, epoch_us(observed_at) + interval_seconds::BIGINT * 1000000 AS f,
  unnest(generate_series(epoch_us(observed_at) // {minutes * 60_000_000}, (epoch_us(observed_at) + interval_seconds::BIGINT * 1000000 - 1) // {minutes * 60_000_000})) AS w
  FROM obs WHERE successful),
cov AS (SELECT dataset_kind, user_id, host_id, make_timestamp(w * {minutes * 60_000_000}) AS window_start, collector,
  round(least(1.0::DOUBLE, sum(least(f, (w + 1) * {minutes * 60_000_000}) - greatest(b, w * {minutes * 60_000_000})) / {minutes * 60_000_000}.0::DOUBLE), 4) AS coverage
  FROM touch GROUP BY dataset_kind, user_id, host_id, w, collector),
wide AS (SELECT {KEY}, max(coverage) FILTER (WHERE collector = 'system') AS system, max(coverage) FILTER (WHERE collector = 'process') AS process,
  max(coverage) FILTER (WHERE collector = 'network') AS network, max(coverage) AS best FROM cov GROUP BY ALL)"""


QUALITY_SQL = f"""
qual AS (
  SELECT {KEY}, event_count, system, process, network,
    CASE WHEN dataset_kind = 'real' THEN best WHEN event_count > 0 THEN 1 ELSE 0 END::DOUBLE AS heartbeat_coverage,
    CASE WHEN dataset_kind <> 'real' THEN CASE WHEN event_count > 0 THEN 'good' ELSE 'insufficient' END
      WHEN best <= 0 THEN 'insufficient'
      WHEN system >= 0.8 AND process >= 0.8 THEN CASE WHEN network >= 0.8 THEN 'good' ELSE 'degraded' END
      WHEN system >= 0.5 AND process >= 0.5 THEN 'degraded' ELSE 'insufficient' END AS quality_status,
    CASE WHEN dataset_kind <> 'real' THEN CASE WHEN event_count > 0 THEN ['quality checks passed'] ELSE ['no synthetic telemetry'] END
      WHEN best > 0 AND system >= 0.8 AND process >= 0.8 AND network >= 0.8 THEN ['quality checks passed']
      ELSE list_filter([CASE WHEN best <= 0 THEN 'no collector observations cover window' WHEN system >= 0.8 AND process >= 0.8 THEN 'network collector coverage below 80 percent'
        WHEN system >= 0.5 AND process >= 0.5 THEN 'core collector coverage is partial' ELSE 'system metrics or process collector coverage is insufficient' END,
        CASE WHEN no_system THEN 'system metrics collector did not poll' END, CASE WHEN no_process THEN 'process collector did not poll' END], lambda r: r IS NOT NULL) END AS reasons,
    round((1 - CASE WHEN dataset_kind = 'real' THEN best WHEN event_count > 0 THEN 1 ELSE 0 END) * 3600, 4)::DOUBLE AS gap_seconds
  FROM (SELECT {KEY}, event_count, system IS NULL AS no_system, process IS NULL AS no_process, coalesce(system, 0) AS system, coalesce(process, 0) AS process, coalesce(network, 0) AS network, coalesce(best, 0) AS best
    FROM win LEFT JOIN wide USING ({KEY})))"""
