"""Queries over scans, validation, identities, deduplication and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.functions import ids
from loomwatch.operators import collectors as X, incremental as I, scans, validation as V, windows as W
from loomwatch.plans.registry import FEATURE_SQL, KEY, QUALITY_SQL, TEL, observations_sql, query, tidy, windows_sql
from loomwatch.plans.windows_queries import MINUTES, quality, tel, wins
from loomwatch.session import materialize
from loomwatch.sources import telemetry as S

#: Batches of the incremental queries: what was ingested before this, and from then on.
CUT = "2024-01-16 00:00:00"


def _hundredths(x: str) -> str:
    """Two decimals cut off, written as the JSON parser gives numbers back: without a second 0."""
    return f"regexp_replace((floor({x} * 100)::BIGINT // 100) || '.' || lpad((floor({x} * 100)::BIGINT % 100)::VARCHAR, 2, '0'), '0$', '')"


#: Raw telemetry from the mapping's rules; err has a row a failed check, in the order of the checks.
RAW = f"""WITH {TEL}, pay AS (
  SELECT event_id, event_type, dataset_kind, source, user_id, event_id % 50 AS dirt, CASE WHEN event_id % 50 = 5 THEN TIMESTAMP '1999-06-01 00:00:00' ELSE ts END AS ts,
    CASE event_type
      WHEN 'process' THEN [struct_pack(k := 'pid', v := k::VARCHAR), struct_pack(k := 'process_name', v := CASE WHEN event_id % 50 = 4 THEN '' ELSE process_name END)]
      WHEN 'network' THEN [struct_pack(k := 'remote_address', v := remote_address), struct_pack(k := 'remote_port', v := CASE WHEN event_id % 50 = 2 THEN '70000' ELSE remote_port::VARCHAR END)]
      WHEN 'system_metrics' THEN [struct_pack(k := 'cpu_percent', v := CASE event_id % 50 WHEN 1 THEN '140.0' WHEN 6 THEN 'NaN' ELSE {_hundredths('cpu_percent')} END), struct_pack(k := 'ram_percent', v := {_hundredths('ram_percent')})]
      ELSE [struct_pack(k := 'method', v := 'local'), struct_pack(k := 'result', v := CASE WHEN event_id % 50 = 3 THEN 'maybe' ELSE result END)] END AS fields
  FROM tel),
js AS (SELECT *, '{{' || array_to_string(list_transform(fields, lambda f: '"' || f.k || '":"' || f.v || '"'), ',') || '}}' AS safe,
  '{{' || array_to_string(list_transform(fields, lambda f: '"' || f.k || '":"' || f.v || '"'), ',') || CASE WHEN dirt = 0 THEN ',"unexpected":"1"' ELSE '' END || '}}' AS whole FROM pay),
err AS (
  SELECT event_id, 1 AS o, 'identifier' AS c, 'ValidationError' AS kind, 'user_id' AS what FROM pay WHERE dirt = 7
  UNION ALL SELECT event_id, 2, 'unknown_keys', 'ValueError', 'unknown or forbidden payload field(s): unexpected' FROM pay WHERE dirt = 0
  UNION ALL SELECT event_id, 3, 'timestamp', 'ValueError', 'timestamp is outside supported range' FROM pay WHERE dirt = 5
  UNION ALL SELECT event_id, 5, 'not_finite', 'ValidationError', 'cpu_percent' FROM pay WHERE dirt = 6 AND event_type = 'system_metrics'
  UNION ALL SELECT event_id, 6, 'contract', 'ValidationError', CASE event_type WHEN 'process' THEN 'process_name' WHEN 'network' THEN 'remote_port' WHEN 'system_metrics' THEN 'cpu_percent' ELSE 'result' END
    FROM pay WHERE (event_type, dirt) IN (('process', 4), ('network', 2), ('system_metrics', 1), ('system_metrics', 6), ('authentication', 3))),
bad AS (SELECT event_id, min_by(kind, o) AS error_class, min_by(c, o) AS failed_check, string_agg(c || ': ' || what, '; ' ORDER BY o) AS reason FROM err GROUP BY ALL)"""


def _raw(spark, sf_dir):
    return S.raw_telemetry(S.read_events(spark, sf_dir))


def _checked(spark, sf_dir):
    """Validated events, written once: a filter on the errors would otherwise run all checks again."""
    return materialize(V.validate(_raw(spark, sf_dir)), "validated")


@query(f"{RAW} SELECT event_id, safe AS kept, CASE WHEN dirt = 0 THEN 'unexpected' ELSE '' END AS unknown FROM js")
def v1_v2_payload_keys(spark, sf_dir):
    t = _raw(spark, sf_dir).withColumn("fields", V.payload_map(F.col("payload")))
    return t.select("event_id", F.to_json(ids.sorted_payload(V.whitelist(F.col("fields")))).alias("kept"), F.array_join(V.unknown_keys(F.col("fields")), ",").alias("unknown"))


@query(f"{RAW} SELECT event_id, event_type, what AS field FROM err JOIN pay USING (event_id) WHERE c = 'contract'")
def v3_v6_contract_errors(spark, sf_dir):
    t = _raw(spark, sf_dir).withColumn("fields", V.payload_map(F.col("payload")))
    return t.select("event_id", "event_type", F.explode(V.broken_fields(F.col("fields"))).alias("field"))


@query(f"{RAW} SELECT event_id, what AS field FROM err WHERE c = 'not_finite'")
def v7_not_finite(spark, sf_dir):
    t = _raw(spark, sf_dir).withColumn("fields", V.payload_map(F.col("payload")))
    return t.select("event_id", F.explode(V.not_finite(F.col("fields"))).alias("field"))


@query(f"{RAW} SELECT event_id, dirt = 5 AS outside, octet_length(encode(whole))::INT AS payload_bytes, CASE WHEN dirt = 7 THEN '' ELSE user_id END AS user_id FROM js")
def v8_v10_bounds(spark, sf_dir):
    t = _checked(spark, sf_dir)
    return t.select("event_id", (~F.year("ts").between(2000, 2100)).alias("outside"), F.octet_length(F.to_json(ids.sorted_payload(F.col("fields")))).alias("payload_bytes"), "user_id")


@query(f"{RAW} SELECT event_id, sha256(whole) AS payload_hash FROM js")
def v11_payload_hash(spark, sf_dir):
    t = _raw(spark, sf_dir)
    return t.select("event_id", ids.payload_hash(V.payload_map(F.col("payload"))).alias("payload_hash"))


@query(f"{RAW} SELECT event_id, ts, user_id, event_type FROM pay WHERE event_id NOT IN (SELECT event_id FROM bad)")
def v12_accepted(spark, sf_dir):
    return tidy(V.accepted(_checked(spark, sf_dir)).select("event_id", "ts", "user_id", "event_type"))


@query(f"{RAW} SELECT event_id, event_type, dataset_kind, error_class, failed_check, reason, safe AS safe_payload FROM js JOIN bad USING (event_id)")
def v13_quarantine(spark, sf_dir):
    bad = V.quarantined(_checked(spark, sf_dir))
    return bad.select("event_id", "event_type", "dataset_kind", "error_class", "failed_check", "reason", "safe_payload")


@query(f"{RAW} SELECT event_type, error_class, count(*) AS n FROM pay JOIN bad USING (event_id) GROUP BY ALL")
def a3_quarantine_summary(spark, sf_dir):
    bad = V.quarantined(_checked(spark, sf_dir))
    return bad.groupBy("event_type", "error_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "error_class")


ARRIVALS = f"""WITH {TEL}, arr AS (SELECT event_id, dataset_kind, event_type, ts, 1 AS arrival FROM tel UNION ALL SELECT event_id, dataset_kind, event_type, ts, 2 FROM tel WHERE event_id % 20 = 0),
stored AS (SELECT event_id, ts AS first_seen_at FROM tel WHERE ts < TIMESTAMP '2024-01-08 00:00:00')"""


def _stored(spark, sf_dir):
    return tel(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-08").cast("timestamp")).select("event_id", F.col("ts").alias("first_seen_at"))


@query(f"{ARRIVALS} SELECT event_id, min(arrival)::INT AS arrival FROM arr WHERE event_id NOT IN (SELECT event_id FROM stored) GROUP BY event_id")
def v14_j3_new_events(spark, sf_dir):
    return V.deduplicate(S.arrivals(S.read_events(spark, sf_dir)), _stored(spark, sf_dir)).select("event_id", "arrival")


DUPLICATES = f"""{ARRIVALS}, dup AS (SELECT event_id, dataset_kind, event_type, arrival, coalesce(first_seen_at, ts) AS first_seen_at FROM arr LEFT JOIN stored USING (event_id) WHERE arrival > 1 OR first_seen_at IS NOT NULL)"""


@query(f"{DUPLICATES} SELECT event_id, dataset_kind, event_type, arrival, first_seen_at FROM dup")
def v15_duplicates(spark, sf_dir):
    return tidy(V.duplicates(S.arrivals(S.read_events(spark, sf_dir)), _stored(spark, sf_dir)))


@query(f"{DUPLICATES} SELECT dataset_kind, count(*) AS n FROM dup GROUP BY ALL")
def a4_duplicate_summary(spark, sf_dir):
    return V.duplicates(S.arrivals(S.read_events(spark, sf_dir)), _stored(spark, sf_dir)).groupBy("dataset_kind").agg(F.count("*").alias("n"))


@query(f"""WITH {TEL} SELECT event_id, 'user-' || left(sha256('pepper:' || user_id), 16) AS user_alias, 'host-' || left(sha256('pepper:' || host_id), 16) AS host_alias,
left(sha256('{{"host_id":"' || host_id || '","user_id":"' || user_id || '"}}'), 16) AS profile_key FROM tel""")
def v16_v19_identities(spark, sf_dir):
    t = tel(spark, sf_dir)
    return t.select("event_id", ids.pseudonym("user", "pepper", F.col("user_id")).alias("user_alias"), ids.pseudonym("host", "pepper", F.col("host_id")).alias("host_alias"), ids.profile_key().alias("profile_key"))


@query(f"""WITH {TEL}, {windows_sql()}, d AS (SELECT {KEY}, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', dataset_kind, user_id, host_id, epoch_us(window_start), epoch_us(window_start) + 3600000000, 'feature-windows-v2'))) AS h FROM win)
SELECT {KEY}, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS window_id FROM d""")
def v17_v18_window_ids(spark, sf_dir):
    return tidy(wins(spark, sf_dir).select(*W.KEYS, ids.window_id(MINUTES).alias("window_id")))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'manual update' WHEN 1 THEN 'closed by ' || event_type WHEN 2 THEN repeat('r', 500) ELSE 'manual update' END AS reason FROM events""")
def v20_clean_reasons(spark, sf_dir):
    n = F.col("event_id") % 4
    given = F.when(n == 0, F.lit(" \t ")).when(n == 1, F.concat(F.lit("  closed\n  by\0"), "event_type", F.lit(" "))).when(n == 2, F.repeat(F.lit("r"), F.lit(600)))
    return S.read_events(spark, sf_dir).select("event_id", ids.clean_reason(given).alias("reason"))


# --- scans


@query(f"WITH {TEL} SELECT event_id, ts FROM tel WHERE dataset_kind = 'real' AND event_type = 'network' ORDER BY ts, event_id LIMIT 100 OFFSET 25")
def s1_event_scan(spark, sf_dir):
    return tidy(scans.event_scan(tel(spark, sf_dir), "real", "network", limit=100, offset=25).select("event_id", "ts"))


INGESTED = f"""WITH {TEL}, ing AS (SELECT *, ts + (CASE WHEN event_id % 11 = 0 THEN 180 WHEN event_id % 7 = 0 THEN 45 ELSE 0 END) * INTERVAL 1 minute AS ingested_at FROM tel)"""


def _ingested(spark, sf_dir):
    return tel(spark, sf_dir).withColumn("ingested_at", S.ingestion_time())


@query(f"""{INGESTED}, c AS (SELECT dataset_kind, max(ingested_at) AS t, max_by(event_id, (ingested_at, event_id)) AS i FROM ing WHERE ingested_at < TIMESTAMP '{CUT}' GROUP BY ALL)
SELECT event_id, ing.dataset_kind, ingested_at FROM ing LEFT JOIN c USING (dataset_kind) WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' AND (t IS NULL OR ingested_at > t OR (ingested_at = t AND event_id > i))""")
def s2_range_after_cursor(spark, sf_dir):
    rows = _ingested(spark, sf_dir)
    cursors = I.cursor(rows.where(F.col("ingested_at") < F.lit(CUT).cast("timestamp")), "ingested_at", "event_id")
    ranged = scans.time_range(rows, "ts", "2024-01-03", "2024-01-25")
    return tidy(I.after_cursor(ranged, cursors, "ingested_at", "event_id").select("event_id", "dataset_kind", "ingested_at"))


@query(f"""WITH {TEL}, {observations_sql()}, c AS (SELECT dataset_kind, max((observed_at, observation_id)) AS c FROM obs WHERE observed_at < TIMESTAMP '{CUT}' GROUP BY ALL)
SELECT observation_id, dataset_kind, observed_at FROM obs LEFT JOIN c USING (dataset_kind) WHERE c IS NULL OR (observed_at, observation_id) > c""")
def s3_observations_after_cursor(spark, sf_dir):
    obs = S.observations(S.read_events(spark, sf_dir))
    cursors = I.cursor(obs.where(F.col("observed_at") < F.lit(CUT).cast("timestamp")), "observed_at", "observation_id")
    return tidy(I.after_cursor(obs, cursors, "observed_at", "observation_id").select("observation_id", "dataset_kind", "observed_at"))


@query(f"""WITH {TEL}, {observations_sql()} SELECT observation_id, observed_at FROM obs WHERE observed_at < TIMESTAMP '2024-01-12 06:00:00' AND observed_at + interval_seconds * INTERVAL 1 second > TIMESTAMP '2024-01-10 18:00:00'""")
def s4_overlapping_observations(spark, sf_dir):
    obs = S.observations(S.read_events(spark, sf_dir))
    return tidy(scans.overlapping(obs, "2024-01-10 18:00:00", "2024-01-12 06:00:00").select("observation_id", "observed_at"))


@query(f"""WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL} SELECT {KEY}, quality_status, event_count FROM qual WHERE dataset_kind = 'real' AND quality_status IN ('good', 'degraded', 'insufficient')
AND window_start >= TIMESTAMP '2024-01-02' AND window_start < TIMESTAMP '2024-02-01' AND (window_start, user_id, host_id) > (TIMESTAMP '2024-01-03 12:00:00', 'user-2', 'host-0') ORDER BY window_start, user_id, host_id LIMIT 200""")
def s5_window_scan(spark, sf_dir):
    found = scans.window_scan(quality(spark, sf_dir), "real", ("good", "degraded", "insufficient"), "2024-01-02", "2024-02-01", after=("2024-01-03 12:00:00", "user-2", "host-0"), limit=200)
    return tidy(found.select(*W.KEYS, "quality_status", "event_count"))


VERSIONS = f"""WITH {TEL}, {windows_sql()}, o AS (SELECT {KEY}, process_count, TIMESTAMP '2024-03-01' AS created_at FROM win WHERE window_start < TIMESTAMP '2024-01-20'),
n AS (SELECT {KEY}, process_count + 1 AS process_count, TIMESTAMP '2024-04-01' AS created_at FROM win WHERE window_start >= TIMESTAMP '2024-01-10')"""


def _versions(spark, sf_dir):
    w = wins(spark, sf_dir).select(*W.KEYS, "process_count")
    old = w.where(F.col("window_start") < F.lit("2024-01-20").cast("timestamp")).withColumn("created_at", F.lit("2024-03-01").cast("timestamp"))
    new = w.where(F.col("window_start") >= F.lit("2024-01-10").cast("timestamp")).withColumn("process_count", F.col("process_count") + 1)
    return old, new.withColumn("created_at", F.lit("2024-04-01").cast("timestamp"))


@query(f"{VERSIONS} SELECT {KEY}, coalesce(n.process_count, o.process_count) AS process_count, coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n USING ({KEY})")
def s8_window_upsert(spark, sf_dir):
    return tidy(I.upsert(*_versions(spark, sf_dir)))


@query(f"WITH {TEL}, {windows_sql()} SELECT {KEY}, event_count FROM win WHERE dataset_kind <> 'synthetic'")
def s13_clear_kind(spark, sf_dir):
    return tidy(scans.without_kind(wins(spark, sf_dir), "synthetic").select(*W.KEYS, "event_count"))


# --- incremental runs

BATCHES = f"""{INGESTED}, one AS (SELECT * FROM ing WHERE ingested_at < TIMESTAMP '{CUT}'), two AS (SELECT * FROM ing WHERE ingested_at >= TIMESTAMP '{CUT}'),
mark AS (SELECT dataset_kind, max(ts) AS watermark FROM one GROUP BY ALL),
cls AS (SELECT two.*, watermark, CASE WHEN watermark IS NULL OR ts >= watermark THEN 'on_time' WHEN ts >= watermark - INTERVAL 60 minutes THEN 'within' ELSE 'outside' END AS lateness FROM two LEFT JOIN mark USING (dataset_kind)),
rng AS (SELECT dataset_kind, min(time_bucket(INTERVAL '60 minutes', ts)) AS range_start, CASE WHEN bool_or(lateness = 'within') THEN NULL ELSE max(time_bucket(INTERVAL '60 minutes', ts)) + INTERVAL 60 minutes END AS range_end FROM cls WHERE lateness <> 'outside' GROUP BY ALL)"""


def _batches(spark, sf_dir):
    rows, cut = _ingested(spark, sf_dir), F.lit(CUT).cast("timestamp")
    return rows.where(F.col("ingested_at") < cut), rows.where(F.col("ingested_at") >= cut)


def _classified(spark, sf_dir):
    one, two = _batches(spark, sf_dir)
    return I.classify_late(two, I.watermark(one))


@query(f"{BATCHES} SELECT dataset_kind, greatest(max(watermark), max(ts)) AS watermark FROM (SELECT dataset_kind, watermark, NULL::TIMESTAMP AS ts FROM mark UNION ALL SELECT dataset_kind, NULL, ts FROM two) GROUP BY ALL")
def t1_watermark(spark, sf_dir):
    one, two = _batches(spark, sf_dir)
    return tidy(I.watermark(two, I.watermark(one)))


@query(f"{BATCHES} SELECT event_id, ts, lateness FROM cls")
def t2_lateness(spark, sf_dir):
    return tidy(_classified(spark, sf_dir).select("event_id", "ts", "lateness"))


@query(f"{BATCHES} SELECT dataset_kind, range_start, range_end FROM rng")
def t3_affected_range(spark, sf_dir):
    return tidy(I.affected_range(_classified(spark, sf_dir), MINUTES))


@query(f"{BATCHES} SELECT dataset_kind, event_id, ts, ingested_at, lateness FROM cls WHERE lateness <> 'on_time' AND event_id % 3 <> 0")
def t4_late_audit(spark, sf_dir):
    """The audit of a batch of which every third late event is audited already."""
    audit = I.late_audit(_classified(spark, sf_dir))
    return tidy(I.late_audit(_classified(spark, sf_dir), audit.where("event_id % 3 = 0")))


@query(f"{BATCHES} SELECT dataset_kind, lateness, count(*) AS n FROM cls WHERE lateness <> 'on_time' GROUP BY ALL")
def a5_late_summary(spark, sf_dir):
    return I.late_audit(_classified(spark, sf_dir)).groupBy("dataset_kind", "lateness").agg(F.count("*").alias("n"))


@query(f"""{BATCHES}, ent AS (SELECT one.*, time_bucket(INTERVAL '60 minutes', ts) AS w, CASE event_type WHEN 'process' THEN process_name WHEN 'network' THEN remote_address || ':' || remote_port END AS entity FROM one)
SELECT dataset_kind, user_id, host_id, event_type, entity, min(w) AS first_seen FROM ent JOIN rng USING (dataset_kind) WHERE entity IS NOT NULL AND ts < range_start GROUP BY ALL""")
def t5_novelty_baseline(spark, sf_dir):
    one, _ = _batches(spark, sf_dir)
    return tidy(I.novelty_baseline(one, I.affected_range(_classified(spark, sf_dir), MINUTES), MINUTES))


@query(f"{BATCHES}, acc AS (SELECT one.* FROM one UNION ALL SELECT * EXCLUDE (watermark, lateness) FROM cls WHERE lateness <> 'outside'), {windows_sql(60, 'acc')} SELECT {KEY}, {FEATURE_SQL}, event_count FROM win")
def t7_incremental_windows(spark, sf_dir):
    """Two batches one after the other; its SQL builds all windows at once from the accepted events."""
    one, two = (materialize(b, "batch") for b in _batches(spark, sf_dir))
    state = I.materialize_increment(I.materialize_increment(None, one, MINUTES), two, MINUTES)
    return tidy(state.windows.select(*W.KEYS, *W.FEATURES, "event_count"))


@query(f"{BATCHES}, {windows_sql(60, 'one')} SELECT {KEY}, event_count, true AS same_state FROM win")
def t8_no_op_run(spark, sf_dir):
    """A run without events gives back the state that it was given: windows, watermarks, audit and events alike."""
    one = materialize(_batches(spark, sf_dir)[0], "batch")
    before = I.materialize_increment(None, one, MINUTES)
    after = I.materialize_increment(before, one.where("false"), MINUTES)
    return tidy(after.windows.select(*W.KEYS, "event_count", F.lit(after is before).alias("same_state")))


@query(f"{INGESTED} SELECT dataset_kind, max(ingested_at) AS ingested_at, max_by(event_id, (ingested_at, event_id)) AS event_id FROM ing GROUP BY ALL")
def t9_cursors(spark, sf_dir):
    return tidy(I.cursor(_ingested(spark, sf_dir), "ingested_at", "event_id"))


@query("""WITH t AS (SELECT 'user-' || (user_id % 10) AS user_id, ts, event_id, round(value * 1000)::BIGINT AS n, floor((ts::DATE - DATE '2024-01-01') / 7) AS week FROM events),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id, week ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS counter FROM t)
SELECT user_id, ts, event_id, counter, greatest(0, counter - coalesce(lag(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id), counter))::BIGINT AS delta FROM c""")
def x6_counter_deltas(spark, sf_dir):
    return tidy(X.counter_deltas(S.counters(S.read_events(spark, sf_dir))))
