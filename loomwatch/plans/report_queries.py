"""Queries over reports, eligibility, snapshot checks, scoring, listings and models' records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.functions import ids
from loomwatch.operators import checks as K, detection as D, findings as G, reports as R, scoring as M, snapshots as P, validation as V, windows as W
from loomwatch.plans.detection_queries import FOUND, NOW, SUPPRESSION_SCHEMA, SUPPRESSIONS, WINDOW_ID, decided, stored_decisions
from loomwatch.plans.ingest_queries import RAW, _checked, _stored
from loomwatch.plans.registry import KEY, QUALITY_SQL, TEL, decisions_sql, observations_sql, query, tidy, windows_sql
from loomwatch.plans.snapshot_queries import PROFILE, SPLIT, _split
from loomwatch.plans.windows_queries import MINUTES, quality, tel, wins
from loomwatch.session import materialize
from loomwatch.sources import telemetry as S

QUAL = f"{TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL}"
BASE = f"WITH {TEL}, {windows_sql()}, {decisions_sql()}"
SESSIONS = """ss AS (SELECT dataset_kind, user_id, host_id, ts::DATE AS day, min(ts) AS started_at, max(ts) AS last_heartbeat_at FROM tel GROUP BY ALL),
se AS (SELECT *, user_id || '|' || day AS session_id, CASE WHEN day < (SELECT max(day) FROM ss) THEN last_heartbeat_at END AS stopped_at, CASE WHEN day < (SELECT max(day) FROM ss) THEN 'stopped' ELSE 'running' END AS status FROM ss)"""
#: Running sessions are counted up to here.
AT = "2024-03-01 00:00:00"
PROGRESS = f"""{SESSIONS}, sp1 AS (SELECT *, CASE WHEN status = 'running' THEN TIMESTAMP '{AT}' ELSE stopped_at END AS stop FROM se),
sp2 AS (SELECT *, greatest(0, (epoch_us(stop) - epoch_us(started_at)) / 1e6) AS seconds, (epoch_us(started_at) - epoch_us(lag(stop) OVER (PARTITION BY {PROFILE} ORDER BY started_at))) / 1e6 AS apart FROM sp1),
pg AS (SELECT {PROFILE}, sum(seconds) AS cumulative_seconds, max(seconds) AS longest_seconds, sum(CASE WHEN status = 'running' THEN seconds ELSE 0 END) AS current_seconds, count(*) FILTER (WHERE apart > 0) AS gaps, coalesce(sum(apart) FILTER (WHERE apart > 0), 0) AS gap_seconds FROM sp2 GROUP BY ALL)"""


def _sessions(spark, sf_dir):
    return S.sessions(S.read_events(spark, sf_dir))


@query(f"""{RAW}, good AS (SELECT * FROM pay WHERE event_id NOT IN (SELECT event_id FROM bad)), {windows_sql()}, {observations_sql()}, {QUALITY_SQL},
dup AS (SELECT event_id FROM tel WHERE ts < TIMESTAMP '2024-01-08 00:00:00' UNION ALL SELECT event_id FROM tel WHERE event_id % 20 = 0),
m AS (SELECT 'accepted' AS metric, '' AS key, count(*) AS value FROM good UNION ALL SELECT 'duplicates', '', count(*) FROM dup UNION ALL SELECT 'quarantined', '', count(*) FROM bad
  UNION ALL SELECT 'by_type', event_type, count(*) FROM good GROUP BY ALL UNION ALL SELECT 'by_collector', source, count(*) FROM good GROUP BY ALL
  UNION ALL SELECT 'first_micros', '', epoch_us(min(ts)) FROM good UNION ALL SELECT 'last_micros', '', epoch_us(max(ts)) FROM good UNION ALL SELECT 'profiles', '', count(DISTINCT user_id) FROM good
  UNION ALL SELECT 'usable_seconds', '', 3600 * count(*) FROM qual WHERE dataset_kind = 'real' AND quality_status = 'good' UNION ALL SELECT 'last_window_micros', '', epoch_us(max(window_start)) + 3600000000 FROM win)
SELECT metric, key, value::BIGINT AS value FROM m UNION ALL SELECT 'received', '', sum(value)::BIGINT FROM m WHERE metric IN ('accepted', 'duplicates', 'quarantined')""")
def a6_quality_report(spark, sf_dir):
    checked = _checked(spark, sf_dir)
    again = V.duplicates(S.arrivals(S.read_events(spark, sf_dir)), _stored(spark, sf_dir))
    return R.quality_report(V.accepted(checked), again, V.quarantined(checked), quality(spark, sf_dir), MINUTES)


@query(f"WITH {QUAL} SELECT dataset_kind, count(*) AS windows, round(avg(heartbeat_coverage), 6) AS avg_heartbeat_coverage FROM qual GROUP BY ALL")
def a7_average_coverage(spark, sf_dir):
    return tidy(R.average_coverage(quality(spark, sf_dir)))


@query(f"""WITH {TEL}, {PROGRESS} SELECT {PROFILE}, round(cumulative_seconds, 6) AS cumulative_seconds, round(longest_seconds, 6) AS longest_seconds, round(current_seconds, 6) AS current_seconds, gaps, round(gap_seconds, 6) AS gap_seconds,
round(least(1.0::DOUBLE, cumulative_seconds / 86400), 6) AS progress_to_24h, longest_seconds >= 86400 AS continuous_24h FROM pg""")
def a9_w8_collection_progress(spark, sf_dir):
    return tidy(R.collection_progress(_sessions(spark, sf_dir), AT))


@query(f"WITH {TEL}, {SESSIONS} SELECT session_id, coalesce(stopped_at, last_heartbeat_at) AS stopped_at, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM se")
def a10_stale_sessions(spark, sf_dir):
    return tidy(R.close_stale(_sessions(spark, sf_dir)).select("session_id", "stopped_at", "status"))


ELIGIBLE = f"""WITH {QUAL}, {PROGRESS}, el AS (SELECT {PROFILE}, count(*) AS windows, count(*) FILTER (WHERE quality_status = 'good') AS good_windows, count(*) FILTER (WHERE quality_status = 'degraded') AS degraded_windows,
  coalesce(avg(system) FILTER (WHERE quality_status = 'good'), 0) AS avg_system, coalesce(avg(process) FILTER (WHERE quality_status = 'good'), 0) AS avg_process FROM qual GROUP BY ALL),
er AS (SELECT el.*, good_windows * 3600 AS usable_seconds, CASE WHEN dataset_kind <> 'real' THEN CASE WHEN windows < 12 THEN 'not enough synthetic windows' ELSE 'ready' END
  WHEN cumulative_seconds < 86400 THEN 'requires 24 cumulative hours of real collection' WHEN good_windows * 3600 < 86400 THEN 'requires 24 cumulative hours of usable real coverage'
  WHEN good_windows < 96 THEN 'not enough good real feature windows' WHEN avg_system < 0.8 THEN 'system metrics coverage is insufficient' WHEN avg_process < 0.8 THEN 'process collector coverage is insufficient'
  WHEN cumulative_seconds < good_windows * 3600 THEN 'cumulative duration is less than usable coverage' ELSE 'ready' END AS reason FROM el JOIN pg USING ({PROFILE}))"""


def _eligible(spark, sf_dir):
    return R.eligibility(quality(spark, sf_dir), R.collection_progress(_sessions(spark, sf_dir), AT), MINUTES)


@query(f"{ELIGIBLE} SELECT {PROFILE}, windows, good_windows, degraded_windows, round(avg_system, 6) AS avg_system, round(avg_process, 6) AS avg_process, usable_seconds::BIGINT AS usable_seconds, reason, reason = 'ready' AS eligible FROM er")
def a11_m27_eligibility(spark, sf_dir):
    return tidy(_eligible(spark, sf_dir).drop("cumulative_seconds"))


@query(f"""{ELIGIBLE}, sn AS (SELECT {PROFILE}, count(*) AS n, count(*) FILTER (WHERE quality_status <> 'good') AS odd, min(window_start) AS first, max(window_start) + INTERVAL 60 minutes AS last FROM qual WHERE quality_status = 'good' OR (dataset_kind = 'synthetic' AND quality_status = 'degraded') GROUP BY ALL)
SELECT {PROFILE}, CASE WHEN dataset_kind <> 'real' THEN 'ready' WHEN reason <> 'ready' THEN 'real training not eligible: ' || reason WHEN user_id = 'user-3' THEN 'real snapshot feature schema is incompatible' WHEN user_id = 'user-4' THEN 'real snapshot must be filtered to good windows'
  WHEN odd > 0 THEN 'real snapshot contains non-good windows' WHEN n < 96 THEN 'real snapshot requires at least 96 good windows' WHEN last - first < INTERVAL 24 hours THEN 'real snapshot requires at least 24 hours of coverage' ELSE 'ready' END AS reason FROM sn JOIN er USING ({PROFILE})""")
def m27_training_gate(spark, sf_dir):
    """Whether the snapshot of each profile may be trained on; two have a manifest that does not fit."""
    rows, user = _snapshot(spark, sf_dir), F.col("user_id")
    manifest = R.manifest(rows).withColumn("feature_schema", F.when(user == "user-3", "feature-windows-v1").otherwise(W.SCHEMA_VERSION))
    manifest = manifest.withColumn("quality_filters", F.when(user == "user-4", F.array(F.lit("good"), F.lit("degraded"))).otherwise(F.array(F.lit("good"))))
    return R.training_gate(rows, manifest, _eligible(spark, sf_dir))


@query(f"{ELIGIBLE} SELECT dataset_kind, count(*) AS profiles, count(*) FILTER (WHERE reason = 'ready') AS ready FROM er GROUP BY ALL")
def a12_readiness(spark, sf_dir):
    return R.readiness(_eligible(spark, sf_dir))


def _snapshot(spark, sf_dir):
    """The snapshot of learnable windows with ids, split, quality and coverage; written once."""
    kept = [*W.KEYS, "window_end", *W.FEATURES, "quality_status", "event_count", "heartbeat_coverage"]
    rows = P.split(P.snapshot(quality(spark, sf_dir).select(*kept)))
    return materialize(rows.withColumn("window_id", ids.window_id(MINUTES)), "snapshot")


SNAP = f"""{SPLIT}, {WINDOW_ID}, sq AS (SELECT sp.*, quality_status, heartbeat_coverage, window_id, window_start + INTERVAL 60 minutes AS window_end FROM sp JOIN (SELECT {KEY}, quality_status, heartbeat_coverage FROM qual) USING ({KEY}) JOIN wid USING ({KEY}))"""
MANIFEST = f"""mf AS (SELECT {PROFILE}, count(*) AS window_count, min(window_start) AS first_start, max(window_end) AS last_end, count(*) FILTER (WHERE quality_status = 'good') AS good, count(*) FILTER (WHERE quality_status = 'degraded') AS degraded,
  round(avg(heartbeat_coverage), 6) AS avg_heartbeat_coverage, round(min(heartbeat_coverage), 6) AS min_heartbeat_coverage, sum(event_count)::BIGINT AS event_count FROM sq GROUP BY ALL)"""


@query(f"{SNAP}, {MANIFEST} SELECT * FROM mf")
def a14_manifest(spark, sf_dir):
    return tidy(R.manifest(_snapshot(spark, sf_dir)))


@query(f"{SNAP} SELECT sq.dataset_kind, sq.user_id, sq.host_id, tel.event_type, count(*)::BIGINT AS n FROM sq JOIN tel ON tel.dataset_kind = sq.dataset_kind AND tel.user_id = sq.user_id AND tel.host_id = sq.host_id AND tel.ts >= sq.window_start AND tel.ts < sq.window_end GROUP BY ALL")
def a14_manifest_events(spark, sf_dir):
    return R.manifest_events(_snapshot(spark, sf_dir), W.counts_by(tel(spark, sf_dir), MINUTES, "event_type"))


@query(f"WITH {QUAL}, {SESSIONS} SELECT 'events' AS \"table\", count(*) AS rows FROM tel UNION ALL SELECT 'observations', count(*) FROM obs UNION ALL SELECT 'sessions', count(*) FROM se UNION ALL SELECT 'windows', count(*) FROM win")
def a20_row_counts(spark, sf_dir):
    e = S.read_events(spark, sf_dir)
    return R.row_counts({"events": tel(spark, sf_dir), "observations": S.observations(e), "sessions": S.sessions(e), "windows": wins(spark, sf_dir)})


# --- snapshot checks

#: What is put wrong in a copy of the snapshot, by profile.
TAMPERED = f"""tm AS (SELECT * REPLACE (CASE WHEN user_id = 'user-1' AND row_index = 3 THEN 4 ELSE row_index END AS row_index, CASE WHEN user_id = 'user-5' AND row_index = 2 THEN 'NaN'::DOUBLE ELSE avg_cpu_percent END AS avg_cpu_percent,
  CASE WHEN user_id = 'user-6' AND row_index = 1 THEN TIMESTAMP '2023-01-01' ELSE window_start END AS window_start) FROM sq WHERE NOT (user_id = 'user-7' AND row_index = 0) UNION ALL SELECT * FROM sq WHERE user_id = 'user-8' AND row_index = 5)"""


def _tampered(rows):
    def at(user: str, index: int):
        return (F.col("user_id") == user) & (F.col("row_index") == index)

    bad = rows.where(~at("user-7", 0)).unionByName(rows.where(at("user-8", 5)))
    return (
        bad.withColumn("window_start", F.when(at("user-6", 1), F.lit("2023-01-01").cast("timestamp")).otherwise(F.col("window_start")))
        .withColumn("avg_cpu_percent", F.when(at("user-5", 2), F.lit(float("nan"))).otherwise(F.col("avg_cpu_percent")))
        .withColumn("row_index", F.when(at("user-1", 3), 4).otherwise(F.col("row_index")))
    )


@query(f"""{SNAP}, {MANIFEST}, {TAMPERED}, pl AS (SELECT *, row_number() OVER w - 1 AS n0, lag(window_start) OVER w AS before FROM tm WINDOW w AS (PARTITION BY {PROFILE} ORDER BY row_index, window_id)),
ag AS (SELECT {PROFILE}, count(*) AS n, count(*) FILTER (WHERE n0 <> row_index) AS a, count(*) - count(DISTINCT window_id) AS b, count(*) FILTER (WHERE before > window_start) AS c, count(*) FILTER (WHERE isnan(avg_cpu_percent)) AS d, min_by(window_start, n0) AS f, max_by(window_end, n0) AS l FROM pl GROUP BY ALL),
j AS (SELECT ag.*, window_count, first_start, last_end FROM ag JOIN mf USING ({PROFILE}))
SELECT {PROFILE}, 'window_count' AS "check", abs(n - window_count)::BIGINT AS n FROM j WHERE n <> window_count UNION ALL SELECT {PROFILE}, 'row_index', a FROM j WHERE a > 0 UNION ALL SELECT {PROFILE}, 'window_id', b FROM j WHERE b > 0
UNION ALL SELECT {PROFILE}, 'order', c FROM j WHERE c > 0 UNION ALL SELECT {PROFILE}, 'features', d FROM j WHERE d > 0 UNION ALL SELECT {PROFILE}, 'range_start', 1 FROM j WHERE f <> first_start UNION ALL SELECT {PROFILE}, 'range_end', 1 FROM j WHERE l <> last_end""")
def m1_s7_snapshot_checks(spark, sf_dir):
    """The checks on a copy of the snapshot that was tampered with, against the manifest of the sound one."""
    rows = _snapshot(spark, sf_dir)
    return K.snapshot_violations(_tampered(rows), R.manifest(rows))


@query(f"{SNAP}, {MANIFEST} SELECT {PROFILE}, row_index, window_id, process_count, event_count FROM sq")
def s7_verified_snapshot(spark, sf_dir):
    """The rows of the profiles whose snapshot passes every check."""
    rows = _snapshot(spark, sf_dir)
    bad = K.snapshot_violations(rows, R.manifest(rows)).select(*W.PROFILE).distinct()
    return rows.join(bad, W.PROFILE, "left_anti").select(*W.PROFILE, "row_index", "window_id", "process_count", "event_count")


def _part(i: int) -> str:
    return f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR"


@query(f"{SNAP} SELECT {PROFILE}, count(*) AS rows, {' || chr(45) || '.join(map(_part, range(4)))} AS fingerprint FROM (SELECT {PROFILE}, sha256(window_id || '|' || row_index || '|' || quality_status || '|' || event_count) AS h FROM sq) GROUP BY ALL")
def m2_content_fingerprint(spark, sf_dir):
    digest = K.row_digest([F.col("window_id"), F.col("row_index").cast("string"), F.col("quality_status"), F.col("event_count").cast("string")])
    return K.content_fingerprint(_snapshot(spark, sf_dir), digest)


@query(f"""{SNAP}, ts2 AS (SELECT * REPLACE (CASE WHEN user_id = 'user-6' AND row_index = 0 THEN 'test' WHEN user_id = 'user-1' AND split = 'train' AND row_index = 5 THEN 'calibration' ELSE split END AS split) FROM sq UNION ALL SELECT * REPLACE ('test' AS split) FROM sq WHERE user_id = 'user-8' AND row_index = 1),
e4 AS (SELECT {PROFILE}, max(window_start) FILTER (WHERE split = 'train') AS t, min(window_start) FILTER (WHERE split = 'calibration') AS c0, max(window_start) FILTER (WHERE split = 'calibration') AS c1, min(window_start) FILTER (WHERE split = 'test') AS s, count(*) - count(DISTINCT window_id) AS d FROM ts2 GROUP BY ALL)
SELECT {PROFILE}, 'train and calibration' AS "check" FROM e4 WHERE t >= c0 UNION ALL SELECT {PROFILE}, 'calibration and test' FROM e4 WHERE c1 >= s UNION ALL SELECT {PROFILE}, 'train and test' FROM e4 WHERE t >= s UNION ALL SELECT {PROFILE}, 'window in two splits' FROM e4 WHERE d > 0""")
def m4_split_checks(spark, sf_dir):
    """The checks on a split with a test row at the start, a calibration row within train and a window in two splits."""
    rows = _snapshot(spark, sf_dir)
    user, index = F.col("user_id"), F.col("row_index")
    moved = F.when((user == "user-6") & (index == 0), "test").when((user == "user-1") & (F.col("split") == "train") & (index == 5), "calibration").otherwise(F.col("split"))
    twice = rows.where((user == "user-8") & (index == 1)).withColumn("split", F.lit("test"))
    return K.split_violations(rows.withColumn("split", moved).unionByName(twice))


@query(f"""WITH {TEL}, {windows_sql()}, p AS (SELECT DISTINCT {PROFILE} FROM win)
SELECT 'm-' || user_id AS model_id, CASE user_id WHEN 'user-1' THEN 'no such dataset' WHEN 'user-2' THEN 'dataset kind differs' WHEN 'user-3' THEN 'profile differs' WHEN 'user-4' THEN 'feature schema differs' WHEN 'user-5' THEN 'feature names differ' END AS mismatch FROM p""")
def m5_compatibility(spark, sf_dir):
    """A model for each profile, some of them recorded with another dataset, kind, profile, schema or feature order."""
    p = wins(spark, sf_dir).select(*W.PROFILE).distinct().withColumn("profile_key", ids.profile_key())
    names = F.lit(",".join(W.FEATURES))
    data = p.select(F.concat(F.lit("d-"), "user_id").alias("dataset_id"), "dataset_kind", "profile_key", F.lit(W.SCHEMA_VERSION).alias("schema_version"), names.alias("feature_names"))
    user = F.col("user_id")
    models = p.select(
        F.concat(F.lit("m-"), user).alias("model_id"), F.concat(F.when(user == "user-1", "x-").otherwise("d-"), user).alias("dataset_id"), F.when(user == "user-2", "other").otherwise(F.col("dataset_kind")).alias("dataset_kind"),
        F.when(user == "user-3", "0").otherwise(F.col("profile_key")).alias("profile_key"), F.when(user == "user-4", "feature-windows-v1").otherwise(W.SCHEMA_VERSION).alias("schema_version"),
        F.when(user == "user-5", ",".join(reversed(W.FEATURES))).otherwise(names).alias("feature_names"),
    )
    return K.compatibility(models, data).select("model_id", "mismatch")


DRIFTED = f"""{SNAP}, cmp AS (SELECT {KEY}, window_id, CASE hour(window_start) WHEN 3 THEN 'missing' WHEN 7 THEN 'quality revision mismatch' WHEN 11 THEN 'range mismatch' WHEN 13 THEN 'range mismatch' WHEN 17 THEN 'feature schema mismatch' WHEN 19 THEN 'profile mismatch' WHEN 5 THEN 'feature revision mismatch' END AS mismatch FROM sq)"""


def _drifted(rows):
    """The windows as they are 'now': some gone, some revised."""
    hour = F.hour("window_start")
    now = rows.where(hour != 3).withColumn("process_count", F.when(hour == 5, F.col("process_count") + 1).otherwise(F.col("process_count")))
    now = now.withColumn("quality_status", F.when(hour == 7, "insufficient").otherwise(F.col("quality_status")))
    now = now.withColumn("feature_schema", F.when(hour == 17, "feature-windows-v1").otherwise(F.col("feature_schema"))).withColumn("host_id", F.when(hour == 19, "elsewhere").otherwise(F.col("host_id")))
    now = now.withColumn("window_end", F.when(hour == 13, F.col("window_end") + F.make_interval(mins=F.lit(1))).otherwise(F.col("window_end")))
    return now.withColumn("window_start", F.when(hour == 11, F.col("window_start") + F.make_interval(mins=F.lit(1))).otherwise(F.col("window_start")))


@query(f"{DRIFTED} SELECT {KEY}, window_id, mismatch FROM cmp")
def j8_snapshot_drift(spark, sf_dir):
    rows = _snapshot(spark, sf_dir)
    rows = rows.withColumn("feature_schema", F.lit(W.SCHEMA_VERSION))
    return tidy(K.snapshot_drift(rows, _drifted(rows)))


#: One revised window refuses the snapshot of its profile: those of two users have one.
@query(f"{SNAP}, {decisions_sql()} SELECT {KEY}, detection_score, status FROM dec JOIN sq USING ({KEY}) WHERE user_id NOT IN ('user-3', 'user-7')")
def d25_verified_backfill(spark, sf_dir):
    """Decisions on the windows of the snapshots of which no window has been revised since."""
    rows = _snapshot(spark, sf_dir).withColumn("feature_schema", F.lit(W.SCHEMA_VERSION))
    revised = F.col("user_id").isin("user-3", "user-7") & (F.col("row_index") == 0)
    drift = K.snapshot_drift(rows, rows.withColumn("process_count", F.col("process_count") + revised.cast("int")))
    current = decided(spark, sf_dir).withColumn("window_id", ids.window_id(MINUTES))
    return tidy(K.backfill(current, snapshot=rows, drift=drift).select(*W.KEYS, "detection_score", "status"))


@query(f"{BASE} SELECT {KEY}, detection_score, status FROM dec WHERE dataset_kind = 'real' AND window_start >= TIMESTAMP '2024-01-05' AND window_start < TIMESTAMP '2024-01-20'")
def d25_range_backfill(spark, sf_dir):
    """Decisions on the windows of real profiles in an explicit range."""
    return tidy(K.backfill(decided(spark, sf_dir), "real", "2024-01-05", "2024-01-20").select(*W.KEYS, "detection_score", "status"))


@query(f"{SNAP}, {decisions_sql()} SELECT {KEY}, detection_score, status FROM dec JOIN sq USING ({KEY})")
def j4_backfill(spark, sf_dir):
    """Decisions on exactly the windows of a snapshot."""
    rows = _snapshot(spark, sf_dir)
    current = decided(spark, sf_dir).withColumn("window_id", ids.window_id(MINUTES))
    return tidy(K.in_snapshot(current, rows).select(*W.KEYS, "detection_score", "status"))


# --- scoring

SCORED = f"""{SPLIT}, zz AS (SELECT {KEY}, split, feature, ((x - mean) / std) * ((x - mean) / std) AS z2 FROM lf JOIN pre USING ({PROFILE}, feature)),
sc AS (SELECT {KEY}, split, round(avg(z2), 6) AS score, list(feature ORDER BY round(z2, 9) DESC, feature)[1:3] AS top FROM zz GROUP BY ALL),
cq AS (SELECT {PROFILE}, score, count(*) OVER (PARTITION BY {PROFILE}) AS n, row_number() OVER (PARTITION BY {PROFILE} ORDER BY score) AS r FROM sc WHERE split = 'calibration'),
th AS (SELECT {PROFILE}, score AS threshold FROM cq WHERE n >= 12 AND r = 1 + ceil((n - 1) * (1 - 0.05::DOUBLE))),
rs AS (SELECT sc.*, threshold, CASE WHEN score < threshold THEN 'normal' WHEN score / nullif(threshold, 0) < 1.25 THEN 'low' WHEN score / nullif(threshold, 0) < 1.75 THEN 'medium' WHEN score / nullif(threshold, 0) < 2.5 THEN 'high' ELSE 'critical' END AS risk_level FROM sc JOIN th USING ({PROFILE})),
an AS (SELECT {KEY}, split, score, risk_level, 'score ' || score::DECIMAL(20,6) || ' driven by ' || array_to_string(top, ', ') AS explanation FROM rs WHERE score >= threshold)"""


def _scored(spark, sf_dir):
    """Scores of the split snapshot under thresholds from its calibration part; written once."""
    rows = _split(spark, sf_dir)
    scores = materialize(M.deviation_scores(rows, P.fit_preprocessor(rows.where("split = 'train'")), "split"), "scores")
    return M.with_risk(scores, P.calibrate(scores.where("split = 'calibration'"), W.PROFILE, 0.05))


@query(f"{SCORED} SELECT {KEY}, split, score, risk_level FROM rs")
def m14_scored_windows(spark, sf_dir):
    return tidy(_scored(spark, sf_dir).select(*W.KEYS, "split", "score", "risk_level"))


@query(f"{SCORED} SELECT * FROM an")
def m15_s12_anomalies(spark, sf_dir):
    return tidy(M.anomalies(_scored(spark, sf_dir)).select(*W.KEYS, "split", "score", "risk_level", "explanation").orderBy(F.desc("score"), *W.KEYS))


@query(f"{SCORED} SELECT risk_level, count(*) AS n, max(score) AS max_score, max(window_start) AS latest FROM an GROUP BY ALL")
def a15_anomaly_summary(spark, sf_dir):
    return tidy(M.anomaly_summary(M.anomalies(_scored(spark, sf_dir))))


@query(f"{SCORED} SELECT {PROFILE}, round(quantile_cont(score, 0.98) + stddev_pop(score), 6) AS threshold FROM sc WHERE split = 'train' GROUP BY ALL")
def m10_old_threshold(spark, sf_dir):
    rows = _split(spark, sf_dir)
    scores = M.deviation_scores(rows, P.fit_preprocessor(rows.where("split = 'train'")), "split")
    return tidy(M.old_threshold(scores.where("split = 'train'")))


@query(f"""{SCORED}, ue AS (SELECT {PROFILE}, avg((score >= threshold)::INT) FILTER (WHERE split = 'calibration') AS a, avg((score >= threshold)::INT) FILTER (WHERE split = 'test') AS b, quantile_cont(score, [0.05, 0.5, 0.95, 0.99]) FILTER (WHERE split = 'test') AS q FROM rs GROUP BY ALL)
SELECT {PROFILE}, round(a, 6) AS calibration_rate, round(b, 6) AS flagged_rate, round(abs(b - a), 6) AS stability, round(q[1], 6) AS p05, round(q[2], 6) AS p50, round(q[3], 6) AS p95, round(q[4], 6) AS p99 FROM ue""")
def m20_unlabelled_evaluation(spark, sf_dir):
    return tidy(M.unlabelled_evaluation(_scored(spark, sf_dir)))


_SQ = ", ".join(f"CASE WHEN s = 'ok' THEN round(quantile_cont(score, {q}::DOUBLE) FILTER (WHERE split = '{split}'), 6) END AS {side}_{n}" for side, split in (("reference", "train"), ("target", "test")) for n, q in P.QUANTILES.items())


@query(f"""{SCORED}, st2 AS (SELECT {PROFILE}, CASE WHEN count(*) FILTER (WHERE split = 'train') < 12 OR count(*) FILTER (WHERE split = 'test') < 12 THEN 'insufficient_data' ELSE 'ok' END AS s FROM rs GROUP BY ALL)
SELECT {PROFILE}, s AS status, count(*) FILTER (WHERE split = 'train') AS reference_count, count(*) FILTER (WHERE split = 'test') AS target_count, CASE WHEN s = 'ok' THEN round(avg((score >= threshold)::INT) FILTER (WHERE split = 'train'), 6) END AS reference_flagged_rate,
  CASE WHEN s = 'ok' THEN round(avg((score >= threshold)::INT) FILTER (WHERE split = 'test'), 6) END AS target_flagged_rate,
  CASE WHEN s = 'ok' THEN round(avg((score >= threshold)::INT) FILTER (WHERE split = 'test') - avg((score >= threshold)::INT) FILTER (WHERE split = 'train'), 6) END AS flagged_rate_difference, {_SQ}
FROM rs JOIN st2 USING ({PROFILE}) GROUP BY {PROFILE}, s""")
def m23_drift_summary(spark, sf_dir):
    """Flagged rates and scores of the train and test parts."""
    rows = _scored(spark, sf_dir)
    cuts = rows.select(*W.PROFILE, "threshold").distinct()
    sides = [rows.where(F.col("split") == part).drop("threshold") for part in ("train", "test")]
    return tidy(P.drift_summary(*sides, cuts))


#: A scenario a profile: its window with the most failed logins, the earliest of them.
SCENARIOS = f"""sn2 AS (SELECT {PROFILE}, arg_min(window_start, (-auth_failure_count, window_start)) AS window_start FROM sp GROUP BY ALL),
mt AS (SELECT 'burst of ' || user_id AS name, sn2.dataset_kind, sn2.user_id, sn2.host_id, sn2.window_start, (score IS NOT NULL)::BIGINT AS match_count, coalesce(score, 0) AS best_score, coalesce(risk_level, 'none') AS max_risk_level, score IS NOT NULL AS detected FROM sn2 LEFT JOIN an USING ({KEY}))"""


def _matched(spark, sf_dir):
    rows = _split(spark, sf_dir)
    earliest = F.min_by("window_start", F.struct(-F.col("auth_failure_count"), "window_start"))
    scenarios = rows.groupBy(*W.PROFILE).agg(earliest.alias("window_start")).withColumn("name", F.concat(F.lit("burst of "), "user_id"))
    return M.match_scenarios(scenarios, M.anomalies(_scored(spark, sf_dir)))


@query(f"{SCORED}, {SCENARIOS} SELECT * FROM mt")
def j9_scenario_matches(spark, sf_dir):
    return tidy(_matched(spark, sf_dir))


@query(f"{SCORED}, {SCENARIOS} SELECT dataset_kind, round(avg(detected::INT), 6) AS recall, count(*) FILTER (WHERE NOT detected) AS missed, bool_and(detected) AS all_detected FROM mt GROUP BY ALL")
def m19_m26_scenario_recall(spark, sf_dir):
    return tidy(M.scenario_recall(_matched(spark, sf_dir)))


@query(f"""{SPLIT}, lb AS (SELECT {PROFILE}, min(window_start) AS first FROM sp WHERE auth_failure_count >= 2 AND window_start >= TIMESTAMP '2024-01-15' GROUP BY ALL),
b1 AS (SELECT {KEY}, window_start < first AS before, row_number() OVER (PARTITION BY {PROFILE} ORDER BY window_start) - 1 AS i, count(*) OVER (PARTITION BY {PROFILE}) AS n, count(*) FILTER (WHERE window_start < first) OVER (PARTITION BY {PROFILE}) AS m FROM sp JOIN lb USING ({PROFILE}))
SELECT {KEY}, CASE WHEN i < floor(0.7::DOUBLE * m) THEN 'train' WHEN before THEN 'calibration' ELSE 'test' END AS split, floor(0.7::DOUBLE * m) >= 32 AND m - floor(0.7::DOUBLE * m) >= 12 AND n - m >= 12 AS enough FROM b1""")
def w2_boundary_split(spark, sf_dir):
    """Labelled are windows from mid-January on with two failed logins or more."""
    rows = _split(spark, sf_dir)
    labelled = rows.where((F.col("auth_failure_count") >= 2) & (F.col("window_start") >= F.lit("2024-01-15").cast("timestamp")))
    return tidy(M.boundary_split(rows.drop("split", "enough"), labelled).select(*W.KEYS, "split", "enough"))


@query(f"{SPLIT} SELECT {KEY} FROM (SELECT {KEY}, row_index, greatest(8, floor(0.62::DOUBLE * n)) AS cut FROM sp) WHERE row_index >= cut")
def m29_fallback_range(spark, sf_dir):
    return tidy(M.fallback_range(_split(spark, sf_dir)).select(*W.KEYS))


@query(f"{SPLIT} SELECT {PROFILE}, row_index, split, round(avg_cpu_percent, 6) AS avg_cpu_percent FROM sp")
def j10_split_matrices(spark, sf_dir):
    """The rows of each split by their window ids, joined back to the snapshot."""
    rows = _snapshot(spark, sf_dir)
    plan = rows.select("window_id", "split")
    return tidy(rows.drop("split").join(plan, "window_id").select(*W.PROFILE, "row_index", "split", "avg_cpu_percent"))


# --- listings and records


@query(f"{FOUND} SELECT fingerprint, finding_no, last_seen, max_score FROM fin WHERE dataset_kind = 'real' AND risk_level <> 'low' ORDER BY last_seen DESC, fingerprint, finding_no LIMIT 50")
def w6_findings_listed(spark, sf_dir):
    """The fifty findings of real data seen last."""
    found = G.roll_up(G.correlate(stored_decisions(spark, sf_dir))).where("dataset_kind = 'real' and risk_level <> 'low'")
    return tidy(found.orderBy(F.desc("last_seen"), "fingerprint", "finding_no").limit(50).select("fingerprint", "finding_no", "last_seen", "max_score"))


#: Evaluations of three models a profile, a day each.
EVALS = f"""ea AS (SELECT {PROFILE}, 'm' || (day(window_start) % 3) || '-' || user_id AS model_id, window_start::DATE AS day, count(*) AS n, count(*) FILTER (WHERE status = 'finding') AS hits, round(avg(detection_score), 6) AS mean FROM dec GROUP BY ALL)"""


def _evaluations(spark, sf_dir):
    model = F.concat(F.lit("m"), F.day("window_start") % 3, F.lit("-"), "user_id")
    out = decided(spark, sf_dir).groupBy(*W.PROFILE, model.alias("model_id"), F.col("window_start").cast("date").alias("day"))
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "finding").alias("hits"), F.round(F.avg("detection_score"), 6).alias("mean"))


@query(f"{BASE}, {EVALS} SELECT model_id, max(day)::VARCHAR AS day, arg_max(n, day) AS n, arg_max(hits, day) AS hits FROM ea GROUP BY ALL")
def w7_latest_evaluation(spark, sf_dir):
    latest = M.latest_per(_evaluations(spark, sf_dir), ["model_id"], "day", "model_id")
    return latest.select("model_id", F.col("day").cast("string").alias("day"), "n", "hits")


def _policies(spark, sf_dir):
    """The default policy for each user, a parameter a row."""
    users = tel(spark, sf_dir).select(F.col("user_id").alias("policy_id")).distinct()
    return users.join(F.broadcast(D.policy_table(spark, D.DEFAULT_POLICY).drop("policy_id")))  # the rows of one policy


#: What is wrong by user, of the parameters and of the rest of a policy.
WRONG = {
    "user-1": [("rare-process-v1", "base", "out of bounds")], "user-2": [("unusual-hour-activity-v1", "start_hour", "not a whole number")], "user-3": [("no-such-rule", "base", "unknown rule or parameter")],
    "user-4": [("rare-process-v1", "base", "given twice")], "user-5": [("resource-pressure-v1", "max_ram_min", "missing")], "user-6": [("new-remote-spike-v1", "network_min", "config values must be finite")],
    "user-7": [(None, "mode", "unknown detection mode"), (None, "fusion_method", "unknown detection fusion method")], "user-8": [(None, "thresholds", "risk thresholds must satisfy low < medium < high < critical")],
    "user-9": [(None, "quality_gate", "quality_gate contains unknown quality status"), (None, "thresholds", "out of bounds")], "user-0": [(None, "quality_gate", "quality_gate must not be empty")],
}
_WRONG_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (u, *w)) + ")" for u, some in WRONG.items() for w in some)


@query(f"WITH {TEL}, w(policy_id, rule_id, param, reason) AS (VALUES {_WRONG_ROWS}) SELECT w.* FROM w WHERE policy_id IN (SELECT user_id FROM tel)")
def d8_policy_violations(spark, sf_dir):
    """A policy a user, each of them wrong in its own way."""
    p, user = _policies(spark, sf_dir), F.col("policy_id")

    def at(u: str, rule: str, param: str):
        return (user == u) & (F.col("rule_id") == rule) & (F.col("param") == param)

    value = F.when(at("user-1", "rare-process-v1", "base"), 101.0).when(at("user-2", "unusual-hour-activity-v1", "start_hour"), 21.5).when(at("user-6", "new-remote-spike-v1", "network_min"), float("nan")).otherwise(F.col("value"))
    given = p.where(~at("user-5", "resource-pressure-v1", "max_ram_min")).withColumn("value", value)
    given = given.unionByName(given.where(at("user-4", "rare-process-v1", "base"))).unionByName(given.where(at("user-3", "rare-process-v1", "base")).withColumn("rule_id", F.lit("no-such-rule")))
    gate = F.when(user == "user-9", F.array(F.lit("good"), F.lit("fine"))).when(user == "user-0", F.array().cast("array<string>")).otherwise(F.array(F.lit("good"), F.lit("degraded")))
    heads = p.select("policy_id").distinct().select(
        user, F.when(user == "user-7", "either").otherwise("hybrid").alias("mode"), F.when(user == "user-7", "sum").otherwise(D.FUSION).alias("fusion_method"), F.lit(55).alias("finding_threshold"), F.lit(35).alias("low"),
        F.when(user == "user-8", 75).otherwise(55).alias("medium"), F.lit(75).alias("high"), F.when(user == "user-9", 190).otherwise(90).alias("critical"), gate.alias("quality_gate"),
    )
    return D.policy_violations(given, heads)


@query(f"WITH {TEL} SELECT DISTINCT user_id AS policy_id, CASE user_id WHEN 'user-2' THEN 'missing' ELSE 'policy hash mismatch' END AS reason FROM tel WHERE user_id IN ('user-2', 'user-3', 'user-7')")
def d9_tampered_policies(spark, sf_dir):
    """Registered policies of which one is gone, one has a changed value and one a parameter less."""
    p, user = _policies(spark, sf_dir), F.col("policy_id")
    registered = materialize(D.policy_hash(p), "policies")
    now = p.where((user != "user-2") & ~((user == "user-7") & (F.col("param") == "end_hour")))
    now = now.withColumn("value", F.when((user == "user-3") & (F.col("param") == "failure_min"), 6.0).otherwise(F.col("value")))
    return D.tampered_policies(now, registered)


@query("""WITH u AS (SELECT DISTINCT 'user-' || (user_id % 10) AS policy_id, user_id % 10 AS n FROM events)
SELECT policy_id, sha256('rare-process-v1.base=' || n || '.000000;rare-process-v1.new_process_min=1.500000') AS policy_hash FROM u""")
def d9_policy_hash(spark, sf_dir):
    """Policies that differ in one value."""
    users = S.read_events(spark, sf_dir).select((F.col("user_id") % 10).alias("n")).distinct().select(F.concat(F.lit("user-"), "n").alias("policy_id"), F.col("n").cast("double").alias("n"))
    rows = users.select("policy_id", F.lit("rare-process-v1").alias("rule_id"), F.explode(F.create_map(F.lit("base"), F.col("n"), F.lit("new_process_min"), F.lit(1.5))).alias("param", "value"))
    return D.policy_hash(rows)


@query(f"""WITH {TEL}, s(suppression_id, live) AS (VALUES ('s1', true), ('s2', true), ('s3', false), ('s4', false), ('s5', true)), r AS (SELECT DISTINCT 's' || (event_id % 3 + 4) AS suppression_id FROM tel)
SELECT suppression_id FROM s WHERE live AND suppression_id NOT IN (SELECT suppression_id FROM r)""")
def d22_effective_after_revoke(spark, sf_dir):
    """Suppressions in force after a batch of revocations, repeated ones and ones of unknown ids among them."""
    fixed = spark.createDataFrame(SUPPRESSIONS, SUPPRESSION_SCHEMA).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    gone = S.read_events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("event_id") % 3 + 4).alias("suppression_id"))
    return G.effective(G.revoke(fixed, gone), NOW).select("suppression_id")
