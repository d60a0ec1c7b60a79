"""Queries over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.operators import detection as D, windows as W
from loomwatch.plans.detection_queries import NOW, SUPPRESSION_SCHEMA, SUPPRESSIONS
from loomwatch.plans.registry import KEY, QUALITY_SQL, TEL, decisions_sql, observations_sql, query, tidy, windows_sql
from loomwatch.sources import telemetry as S
from loomwatch.streaming import detection as F12, features as F10


CLOSED = "window_start + INTERVAL 60 minutes <= (SELECT max(date_trunc('milliseconds', ts)) FROM tel) - INTERVAL 60 minutes"
MEASURES = """process_count::INT AS process_count, network_connection_count::INT AS network_connection_count, round(avg_cpu_percent, 6) AS avg_cpu_percent, round(max_cpu_percent, 6) AS max_cpu_percent,
round(avg_ram_percent, 6) AS avg_ram_percent, round(max_ram_percent, 6) AS max_ram_percent, auth_success_count::BIGINT AS auth_success_count, auth_failure_count::BIGINT AS auth_failure_count, event_count, hour_of_day, round(activity_density, 6) AS activity_density"""


@query(f"WITH {TEL}, {windows_sql()} SELECT {KEY}, {MEASURES} FROM win WHERE {CLOSED}")
def t10_window_stream(spark, sf_dir):
    return tidy(F10.closed_windows(spark, sf_dir))


#: Decisions on the closed windows under the gate, the scaled policy and the first requests for suppression that are in force.
WATCHED = f"""WITH {TEL}, {windows_sql()}, {decisions_sql()}, {observations_sql()}, {QUALITY_SQL}, cw AS (SELECT {KEY}, new_process_count, new_remote_count, quality_status FROM win JOIN (SELECT {KEY}, quality_status FROM qual) USING ({KEY}) WHERE {CLOSED}),
hit AS (SELECT {KEY}, 1 AS o, 's1' AS id FROM rk WHERE dataset_kind = 'real' AND user_id = 'user-1' AND host_id = 'host-1' AND signal_id = 'rare-process-v1'
  UNION ALL SELECT {KEY}, 5, 's5' FROM rk WHERE dataset_kind = 'real' AND user_id = 'user-1' AND host_id = 'host-1' AND signal_id = 'unusual-hour-activity-v1'
  UNION ALL SELECT {KEY}, 2, 's2' FROM rk WHERE dataset_kind = 'synthetic' AND signal_id = 'authentication-failure-burst-v1'),
fs2 AS (SELECT {KEY}, min_by(id, o) AS suppressed_by FROM hit GROUP BY ALL),
wd AS (SELECT dec.* EXCLUDE (new_process_count, new_remote_count, status), cw.new_process_count, cw.new_remote_count, suppressed_by,
  CASE WHEN quality_status NOT IN ('good', 'degraded') THEN 'skipped' WHEN suppressed_by IS NOT NULL THEN 'suppressed' ELSE status END AS status FROM dec JOIN cw USING ({KEY}) LEFT JOIN fs2 USING ({KEY})),
wg AS (SELECT *, lag(window_start) OVER (PARTITION BY fingerprint ORDER BY window_start) AS p FROM wd WHERE status = 'finding'),
wo AS (SELECT *, sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL 60 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS no FROM wg),
wf AS (SELECT *, 'f-' || fingerprint || '-' || epoch_us(min(window_start) OVER (PARTITION BY fingerprint, no)) AS finding_id FROM wo)"""


def _watch(spark, sf_dir, max_windows: int) -> F12.Store:
    suppressions = spark.createDataFrame(SUPPRESSIONS, SUPPRESSION_SCHEMA)
    suppressions = suppressions.withColumn("expires_at", F.col("expires_at").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    observations = S.observations(S.read_events(spark, sf_dir))
    return F12.detected(spark, sf_dir, F12.Watch(D.scaled_policy(), "scaled", 60, observations, suppressions, NOW), max_windows)


@query(f"{WATCHED} SELECT {KEY}, new_process_count, new_remote_count, n_matched, primary_signal, detection_score, risk_level, status, suppressed_by FROM wd")
def t11_t12_continuous_detection(spark, sf_dir):
    """Gate, rules and suppression on the windows that a stream closes, in cycles of two thousand windows."""
    found = _watch(spark, sf_dir, 2000).evaluations.read()
    return tidy(found.select(*W.KEYS, "new_process_count", "new_remote_count", "n_matched", "primary_signal", "detection_score", "risk_level", "status", "suppressed_by"))


@query(f"""{WATCHED} SELECT finding_id, dataset_kind, user_id, host_id, 'open' AS status, min(window_start) AS first_seen, max(window_start) AS last_seen, count(*) AS occurrences, max(detection_score) AS max_score,
first(risk_level ORDER BY detection_score DESC, window_start) AS risk_level, first(primary_signal ORDER BY window_start) AS primary_signal FROM wf GROUP BY finding_id, dataset_kind, user_id, host_id""")
def t12_stream_findings(spark, sf_dir):
    """The findings that cycle after cycle leaves: what one batch over all windows finds."""
    found = _watch(spark, sf_dir, 2000).findings.read()
    return tidy(found.select("finding_id", *W.PROFILE, "status", "first_seen", "last_seen", "occurrences", "max_score", "risk_level", "primary_signal"))
