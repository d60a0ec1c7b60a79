"""Queries over collectors, reports, snapshots, splits, calibration, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomwatch.operators import collectors as X, snapshots as P, windows as W
from loomwatch.plans.detection_queries import decided
from loomwatch.plans.registry import KEY, ORACLES, QUALITY_SQL, TEL, decisions_sql, observations_sql, query, tidy, windows_sql
from loomwatch.plans.windows_queries import MINUTES, quality, tel
from loomwatch.session import materialize
from loomwatch.sources import telemetry as S

PROFILE = "dataset_kind, user_id, host_id"
_UNPIVOT = " UNION ALL ".join(f"SELECT {KEY}, split, '{f}' AS feature, {f} AS x FROM sp" for f in W.FEATURES)
SPLIT = f"""WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL},
sn AS (SELECT win.*, row_number() OVER (PARTITION BY {PROFILE} ORDER BY window_start) - 1 AS row_index, count(*) OVER (PARTITION BY {PROFILE}) AS n
  FROM win JOIN (SELECT {KEY}, quality_status FROM qual) USING ({KEY}) WHERE quality_status = 'good' OR (dataset_kind = 'synthetic' AND quality_status = 'degraded')),
sp AS (SELECT *, floor(0.7::DOUBLE * n) AS c1, floor(0.15::DOUBLE * n) AS c2,
  CASE WHEN row_index < floor(0.7::DOUBLE * n) THEN 'train' WHEN row_index < floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'calibration' ELSE 'test' END AS split FROM sn),
lf AS ({_UNPIVOT}),
pre AS (SELECT {PROFILE}, feature, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std, quantile_cont(x, 0.5) AS median,
  CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) < 1e-6 THEN 1 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS iqr FROM lf WHERE split = 'train' GROUP BY ALL)"""
DECIDED = f"WITH {TEL}, {windows_sql()}, {decisions_sql()}"


def _split(spark, sf_dir):
    """The split snapshot, written once: its readers meet it more than once."""
    kept = [*W.KEYS, *W.FEATURES, "quality_status", "event_count"]
    return materialize(P.split(P.snapshot(quality(spark, sf_dir).select(*kept))), "split-windows")


@query("""SELECT 'host-' || (user_id % 10 % 2) AS source, event_id AS record_id, ts, 'user-' || (user_id % 10) AS account, ([2, 3, 7, 10, 11, NULL])[event_id % 6 + 1]::INT AS logon_type,
CASE WHEN event_id % 5 < 2 THEN 'login' ELSE 'logout' END AS action, CASE WHEN event_id % 5 = 1 THEN 'failure' ELSE 'success' END AS result
FROM events WHERE event_id % 4 = 0 AND event_id % 5 < 4 AND event_id % 6 <> 1""")
def x1_auth_events(spark, sf_dir):
    return tidy(X.auth_events(S.auth_log(S.read_events(spark, sf_dir))))


@query("""SELECT 'host-' || (user_id % 10 % 2) AS source, ([4624, 4625, 4634, 4647, 4688])[event_id % 5 + 1]::VARCHAR AS event_id, event_id::VARCHAR AS record_id,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_created, (['user-' || (user_id % 10), 'SYSTEM', 'HOST$', NULL])[event_id % 4 + 1] AS target_user_name, ([2, 3, 7, 10, 11, NULL])[event_id % 6 + 1]::VARCHAR AS logon_type FROM events""")
def x2_log_fields(spark, sf_dir):
    fields = X.log_fields(S.raw_auth_log(S.read_events(spark, sf_dir)))
    return fields.select("source", "event_id", "record_id", "time_created", "target_user_name", "logon_type")


@query("""WITH l AS (SELECT 'host-' || (user_id % 10 % 2) AS source, event_id, ts FROM events), d AS (SELECT source, min(ts) + INTERVAL 1 day AS until FROM l GROUP BY ALL),
c AS (SELECT source, max(event_id) AS m FROM l JOIN d USING (source) WHERE ts < until GROUP BY ALL)
SELECT source, count(*) AS fresh, max(event_id) AS record_id FROM l LEFT JOIN c USING (source) WHERE m IS NULL OR event_id > m GROUP BY ALL""")
def x3_auth_cursor(spark, sf_dir):
    """What came after the cursors that each source's first day of records left."""
    log = materialize(S.auth_log(S.read_events(spark, sf_dir)), "auth-log")
    until = log.groupBy("source").agg((F.min("ts") + F.make_interval(days=F.lit(1))).alias("until"))
    seen = log.join(until, "source").where(F.col("ts") < F.col("until"))
    fresh = X.after_record(log, X.last_records(seen))
    return fresh.groupBy("source").agg(F.count("*").alias("fresh"), F.max("record_id").alias("record_id"))


def _changes_sql(rows: str, keys: str, appeared: str, gone: str) -> str:
    same = " AND ".join(f"o.{k.strip()} IS NOT DISTINCT FROM s.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""WITH {TEL}, s AS ({rows}), nx AS (SELECT host_id, snapshot, lag(snapshot) OVER w AS before, lead(snapshot) OVER w AS after FROM (SELECT DISTINCT host_id, snapshot FROM s) WINDOW w AS (PARTITION BY host_id ORDER BY snapshot))
SELECT s.host_id, s.snapshot, '{appeared}' AS action, {mine} FROM s JOIN nx USING (host_id, snapshot) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.host_id = s.host_id AND o.snapshot = before AND {same})
UNION ALL SELECT s.host_id, after, '{gone}', {mine} FROM s JOIN nx USING (host_id, snapshot) WHERE after IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.host_id = s.host_id AND o.snapshot = after AND {same})"""


@query(_changes_sql("SELECT DISTINCT host_id, ts::DATE - DATE '1970-01-01' AS snapshot, k AS pid, floor((ts::DATE - DATE '1970-01-01') / 3)::INT AS create_time FROM tel WHERE event_type = 'process'", "pid, create_time", "started", "stopped"))
def x4_process_changes(spark, sf_dir):
    return X.snapshot_changes(S.process_snapshots(S.read_events(spark, sf_dir)), ["pid", "create_time"], "started", "stopped")


@query(_changes_sql("SELECT DISTINCT host_id, ts::DATE - DATE '1970-01-01' AS snapshot, 'tcp' AS protocol, remote_address, remote_port, CASE WHEN k % 5 <> 0 THEN k END AS pid FROM tel WHERE event_type = 'network'", "protocol, remote_address, remote_port, pid", "opened", "closed"))
def x5_connection_changes(spark, sf_dir):
    return X.snapshot_changes(S.connection_snapshots(S.read_events(spark, sf_dir)), ["protocol", "remote_address", "remote_port", "pid"], "opened", "closed")


@query(f"WITH {TEL} SELECT dataset_kind, event_type, count(*) AS n FROM tel GROUP BY ALL")
def a1_event_summary(spark, sf_dir):
    return tel(spark, sf_dir).groupBy("dataset_kind", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL} SELECT dataset_kind, quality_status, count(*) AS n FROM qual GROUP BY ALL")
def a2_window_summary(spark, sf_dir):
    return quality(spark, sf_dir).groupBy("dataset_kind", "quality_status").agg(F.count("*").alias("n"))


@query(f"WITH {TEL}, {observations_sql()} SELECT collector, count(*) FILTER (WHERE successful) AS ok, count(*) FILTER (WHERE NOT successful) AS failed FROM obs GROUP BY ALL")
def a8_observation_outcomes(spark, sf_dir):
    obs = S.observations(S.read_events(spark, sf_dir))
    return obs.groupBy("collector").agg(F.count_if("successful").alias("ok"), F.count_if(~F.col("successful")).alias("failed"))


@query(f"WITH {TEL} SELECT dataset_kind, event_type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM tel WHERE dataset_kind = 'real' AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL")
def a13_retention_preview(spark, sf_dir):
    old = tel(spark, sf_dir).where("dataset_kind = 'real' and ts < timestamp '2024-01-15'")
    return tidy(old.groupBy("dataset_kind", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")))


@query(f"WITH {TEL}, {windows_sql()} SELECT DISTINCT {PROFILE} FROM win WHERE window_start >= TIMESTAMP '2024-01-05' AND window_start < TIMESTAMP '2024-01-20'")
def u3_profiles_in_range(spark, sf_dir):
    start = W.aligned(F.col("ts"), MINUTES)
    ranged = tel(spark, sf_dir).where((start >= F.lit("2024-01-05").cast("timestamp")) & (start < F.lit("2024-01-20").cast("timestamp")))
    return ranged.select(*W.PROFILE).distinct()


@query(f"{DECIDED}, t AS (SELECT {KEY}, detection_score, row_number() OVER (PARTITION BY {PROFILE} ORDER BY detection_score DESC, window_start)::INT AS place FROM dec) SELECT * FROM t WHERE place <= 3")
def w4_top_windows(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy(*W.PROFILE).orderBy(F.desc("detection_score"), "window_start"))
    return tidy(decided(spark, sf_dir).select(*W.KEYS, "detection_score", place.alias("place")).where("place <= 3"))


@query(f"{SPLIT} SELECT {KEY}, row_index, split, c1 >= 32 AND c2 >= 12 AND n - c1 - c2 >= 12 AS enough FROM sp")
def s6_w1_split_snapshot(spark, sf_dir):
    return tidy(_split(spark, sf_dir).select(*W.KEYS, "row_index", "split", "enough"))


@query(f"{SPLIT} SELECT {PROFILE}, feature, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(iqr, 6) AS iqr FROM pre")
def m6_preprocessor(spark, sf_dir):
    return tidy(P.fit_preprocessor(_split(spark, sf_dir).where("split = 'train'")))


@query(f"""{SPLIT}, z AS (SELECT {KEY}, feature, round((x - median) / iqr, 6) + 0 AS deviation, (x - mean) / std AS z FROM lf JOIN pre USING ({PROFILE}, feature) WHERE split = 'test'),
r AS (SELECT *, (row_number() OVER (PARTITION BY {KEY} ORDER BY abs(deviation) DESC, feature) - 1)::INT AS rank FROM z)
SELECT {KEY}, rank, feature, deviation, round(z, 6) + 0 AS z, CASE WHEN deviation < 0 THEN 'below' ELSE 'above' END AS direction FROM r WHERE rank < 5""")
def m7_m8_deviations(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return tidy(P.deviations(rows.where("split = 'test'"), P.fit_preprocessor(rows.where("split = 'train'"))))


@query(f"""{DECIDED}, s AS (SELECT {PROFILE}, detection_score + activity_density AS score FROM dec), n AS (SELECT *, count(*) OVER (PARTITION BY {PROFILE}) AS n, row_number() OVER (PARTITION BY {PROFILE} ORDER BY score) AS r FROM s),
t AS (SELECT {PROFILE}, score AS threshold FROM n WHERE n >= 12 AND r = 1 + ceil((n - 1) * (1 - 0.05::DOUBLE)))
SELECT {PROFILE}, round(threshold, 6) AS threshold, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS most, round(median(score), 6) AS median, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS spread, round(avg((score >= threshold)::INT), 6) AS flagged_rate FROM n JOIN t USING ({PROFILE}) GROUP BY {PROFILE}, threshold""")
def m9_m22_calibration(spark, sf_dir):
    scores = decided(spark, sf_dir).select(*W.PROFILE, (F.col("detection_score") + F.col("activity_density")).alias("score"))
    return tidy(P.calibrate(scores, W.PROFILE, 0.05))


@query(f"""{DECIDED}, s AS (SELECT dataset_kind, detection_score AS score, detection_score >= 55 AS flagged, auth_failure_count >= 1 AS positive FROM dec),
g AS (SELECT dataset_kind, score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n, count(*) FILTER (WHERE positive AND flagged) AS tp, count(*) FILTER (WHERE NOT positive AND flagged) AS fp FROM s GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(n) OVER (PARTITION BY dataset_kind) AS an FROM g WINDOW w AS (PARTITION BY dataset_kind ORDER BY score DESC)),
o AS (SELECT dataset_kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(p)::BIGINT AS pos, sum(n)::BIGINT AS neg, sum(p * (an - cn + n / 2)) AS u, sum(p * cp / (cp + cn)) AS ap FROM c GROUP BY ALL),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(pos, 0), 0) AS re FROM o)
SELECT dataset_kind, tp, fp, neg - fp AS tn, pos - tp AS fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1,
  round(coalesce(fp / nullif(neg, 0), 0), 6) AS fpr, round(u / nullif(pos * neg, 0), 6) AS roc_auc, round(ap / nullif(pos, 0), 6) AS pr_auc FROM q""")
def m16_m18_evaluation(spark, sf_dir):
    scored = decided(spark, sf_dir).select(
        "dataset_kind", F.col("detection_score").alias("score"), (F.col("detection_score") >= 55).alias("flagged"), (F.col("auth_failure_count") >= 1).alias("positive")
    )
    return tidy(P.ranking_quality(scored, ["dataset_kind"]))


@query(f"""{DECIDED} SELECT {PROFILE}, unnest(['p05', 'p50', 'p95', 'p99']) AS name, round(unnest(quantile_cont(detection_score::DOUBLE, [0.05, 0.5, 0.95, 0.99])), 6) AS value FROM dec GROUP BY {PROFILE}""")
def m21_score_percentiles(spark, sf_dir):
    at = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = decided(spark, sf_dir).groupBy(*W.PROFILE).agg(F.percentile("detection_score", F.array(*map(F.lit, at.values()))).alias("v"))
    rows = found.select(*W.PROFILE, F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("name"), F.col("v").alias("value"))).alias("r"))
    return tidy(rows.select(*W.PROFILE, F.col("r")["name"].alias("name"), F.col("r")["value"].alias("value")))


@query(f"""{SPLIT}, d0 AS (SELECT {PROFILE}, feature, avg(x) AS mean, stddev_pop(x) AS s, list_sort(list_distinct(list_transform(quantile_cont(round(x, 9), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda e: round(e, 9)))) AS e FROM lf WHERE split = 'train' GROUP BY ALL),
d AS (SELECT * EXCLUDE (e), CASE WHEN len(e) = 1 THEN [e[1] - greatest(abs(e[1]) * 1e-6, 1e-6), e[1] + greatest(abs(e[1]) * 1e-6, 1e-6)]
  ELSE list_concat(list_concat([e[1] - 1e-9::DOUBLE], e[2:len(e) - 1]), [e[len(e)] + 1e-9::DOUBLE]) END AS e FROM d0),
b AS (SELECT {PROFILE}, feature, split, least(len(list_filter(e, lambda v: v <= round(x, 9))), len(e) - 1) AS bin, count(*) AS n
  FROM lf JOIN d USING ({PROFILE}, feature) WHERE split <> 'calibration' AND round(x, 9) BETWEEN e[1] AND e[len(e)] GROUP BY ALL),
a AS (SELECT {PROFILE}, feature, unnest(range(1, len(e))) AS bin FROM d),
w AS (SELECT a.*, coalesce(p.n, 0) AS p, coalesce(q.n, 0) AS q FROM a LEFT JOIN (SELECT * FROM b WHERE split = 'train') p USING ({PROFILE}, feature, bin) LEFT JOIN (SELECT * FROM b WHERE split = 'test') q USING ({PROFILE}, feature, bin)),
v AS (SELECT {PROFILE}, feature, greatest(p / greatest(sum(p) OVER g, 1), 1e-6) AS p, greatest(q / greatest(sum(q) OVER g, 1), 1e-6) AS q FROM w WINDOW g AS (PARTITION BY {PROFILE}, feature)),
i AS (SELECT {PROFILE}, feature, sum((q - p) * ln(q / p)) AS psi FROM v GROUP BY ALL), t AS (SELECT {PROFILE}, feature, avg(x) AS now FROM lf WHERE split = 'test' GROUP BY ALL)
SELECT {PROFILE}, feature, round(abs(now - mean) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS shift, round(psi, 6) AS psi FROM d JOIN t USING ({PROFILE}, feature) JOIN i USING ({PROFILE}, feature)""")
def m23_m24_drift(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return tidy(P.drift(rows.where("split = 'train'"), rows.where("split = 'test'")))


_Q = ", ".join(f"round(quantile_cont(x, {q}::DOUBLE), 6) AS {{p}}{n}" for n, q in P.QUANTILES.items())
DRIFT = ORACLES["m23_m24_drift"]


@query(f"""{SPLIT}, fd AS (SELECT {PROFILE}, feature, avg(x) AS mean, stddev_pop(x) AS std, {_Q.format(p="")} FROM lf WHERE split = 'test' GROUP BY {PROFILE}, feature),
pl AS (SELECT *, row_number() OVER (PARTITION BY {PROFILE} ORDER BY round(std, 6) DESC, feature)::INT AS place FROM fd)
SELECT * REPLACE (round(mean, 6) AS mean, round(std, 6) AS std) FROM pl WHERE place <= 5""")
def m20_feature_distribution(spark, sf_dir):
    """The features of the test part that spread most."""
    return tidy(P.feature_distribution(_split(spark, sf_dir).where("split = 'test'")))


@query(f"""WITH dr AS ({DRIFT}), {SPLIT.replace("WITH ", "", 1)}, en AS (SELECT {PROFILE} FROM sp GROUP BY ALL HAVING count(*) FILTER (WHERE split = 'train') >= 12 AND count(*) FILTER (WHERE split = 'test') >= 12),
a AS (SELECT {PROFILE}, feature, {_Q.format(p="train_")} FROM lf WHERE split = 'train' GROUP BY {PROFILE}, feature), b AS (SELECT {PROFILE}, feature, {_Q.format(p="target_")} FROM lf WHERE split = 'test' GROUP BY {PROFILE}, feature),
pl AS (SELECT dr.*, a.* EXCLUDE (dataset_kind, user_id, host_id, feature), b.* EXCLUDE (dataset_kind, user_id, host_id, feature), row_number() OVER (PARTITION BY {PROFILE} ORDER BY shift DESC, feature)::INT AS place FROM dr JOIN en USING ({PROFILE}) JOIN a USING ({PROFILE}, feature) JOIN b USING ({PROFILE}, feature))
SELECT * FROM pl WHERE place <= 5""")
def m23_drift_report(spark, sf_dir):
    """The features of each profile that moved most from train to test."""
    rows = _split(spark, sf_dir)
    return tidy(P.drift_report(rows.where("split = 'train'"), rows.where("split = 'test'")))
