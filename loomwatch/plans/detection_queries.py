"""Queries over rules, fusion, suppression and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.functions import ids
from loomwatch.operators import detection as D, findings as G, windows as W
from loomwatch.operators.incremental import detection_watermark
from loomwatch.plans.registry import KEY, QUALITY_SQL, SOURCE_HASH, TEL, decisions_sql, observations_sql, query, tidy, windows_sql
from loomwatch.plans.windows_queries import quality, whole_windows, wins
from loomwatch.session import materialize

NOW = "2024-02-01 00:00:00"
BASE = f"WITH {TEL}, {windows_sql()}, {decisions_sql()}"
WITH_QUALITY = f"WITH {TEL}, {windows_sql()}, {decisions_sql()}, {observations_sql()}, {QUALITY_SQL}"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the scaled policy, rules only, with fingerprints."""
    return D.with_fingerprint(D.fuse(D.with_signals(wins(spark, sf_dir), D.scaled_policy())), "scaled")


def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions, written once: for queries that meet them more than once."""
    return materialize(decided(spark, sf_dir), "decisions")


@query(f"{BASE} SELECT {KEY}, n_matched, primary_signal, detection_score, risk_level, status FROM dec")
def flagship_risk(spark, sf_dir):
    """Risk level and score per profile and hour, from raw events."""
    return tidy(decided(spark, sf_dir).select(*W.KEYS, "n_matched", "primary_signal", "detection_score", "risk_level", "status"))


@query(f"{BASE} SELECT {KEY}, signal_id, matched, strength FROM sg")
def d1_d6_signals(spark, sf_dir):
    return tidy(D.signal_rows(D.with_signals(wins(spark, sf_dir), D.scaled_policy())))


@query(f"WITH {TEL}, {windows_sql()}, {decisions_sql(3, 10, 5, 12)} SELECT {KEY}, signal_id, matched, strength FROM sg")
def d1_d6_default_policy(spark, sf_dir):
    return tidy(D.signal_rows(D.with_signals(wins(spark, sf_dir), D.DEFAULT_POLICY)))


def _evidence_sql() -> str:
    """A row a rule and piece of evidence, from the rules' definitions."""
    density = "Activity density gate."
    rows = [
        ("rare-process-v1", "new_process_count", 1, "New process count."), ("rare-process-v1", "process_count", 1, "Process activity gate."), ("rare-process-v1", "activity_density", 0, density),
        ("new-remote-spike-v1", "new_remote_count", 2, "New remote count."), ("new-remote-spike-v1", "network_connection_count", 2, "Network activity gate."), ("new-remote-spike-v1", "activity_density", 0, density),
        ("unusual-hour-activity-v1", "hour_of_day", 22, "Unusual hour gate."), ("unusual-hour-activity-v1", "activity_density", 0.05, density),
        ("unusual-hour-activity-v1", "process_count", "NULL", "Process side of process/network gate."), ("unusual-hour-activity-v1", "network_connection_count", "NULL", "Network side of process/network gate."),
        ("resource-pressure-v1", "avg_cpu_percent", 70, "Average CPU gate."), ("resource-pressure-v1", "max_cpu_percent", 90, "Maximum CPU gate."),
        ("resource-pressure-v1", "avg_ram_percent", 85, "Average RAM gate."), ("resource-pressure-v1", "max_ram_percent", 90, "Maximum RAM gate."),
        ("authentication-failure-burst-v1", "auth_failure_count", 3, "Authentication failure count."), ("authentication-failure-burst-v1", "auth_success_count", 100000, "Authentication success gate."),
        ("authentication-failure-burst-v1", "activity_density", 0, density),
    ]
    return " UNION ALL ".join(f"SELECT {KEY}, signal_id, '{f}' AS feature, round({f}::DOUBLE, 6) AS observed, {t}::DOUBLE AS threshold, 'above' AS direction, '{text}' AS text FROM sg JOIN win USING ({KEY}) WHERE matched AND signal_id = '{r}'" for r, f, t, text in rows)


@query(f"{BASE} {_evidence_sql()}")
def d7_evidence(spark, sf_dir):
    return tidy(D.evidence_rows(D.with_signals(wins(spark, sf_dir), D.scaled_policy())))


@query(f"WITH {TEL}, {windows_sql()}, {decisions_sql(gate=0.05)} SELECT {KEY}, signal_id, matched, strength FROM sg WHERE signal_id IN ('new-remote-spike-v1', 'authentication-failure-burst-v1')")
def d2_d5_activity_gates(spark, sf_dir):
    """Two rules under a policy that asks for activity."""
    policy = {rule: params | {"activity_min": 0.05} for rule, params in D.scaled_policy().items() if rule in ("new-remote-spike-v1", "authentication-failure-burst-v1")}
    return tidy(D.signal_rows(D.with_signals(wins(spark, sf_dir), policy)))


@query(f"""{WITH_QUALITY}, k AS (SELECT {KEY}, quality_status FROM qual)
SELECT {KEY}, detection_score, CASE WHEN quality_status NOT IN ('good', 'degraded') THEN 'skipped' ELSE status END AS status,
  CASE WHEN quality_status NOT IN ('good', 'degraded') THEN 'quality is ' || quality_status END AS skip_reason,
  CASE WHEN n_matched > 0 THEN primary_signal || ' leads; ' || (n_matched - 1) || ' corroborating signal(s); score ' || detection_score END AS explanation
FROM dec JOIN k USING ({KEY})""")
def d11_d20_d28_gated(spark, sf_dir):
    out = D.fuse(D.with_signals(quality(spark, sf_dir), D.scaled_policy()))
    return tidy(out.select(*W.KEYS, "detection_score", "status", "skip_reason", "explanation"))


@query(f"{BASE} SELECT {KEY}, fingerprint FROM dec WHERE status = 'finding'")
def d14_fingerprints(spark, sf_dir):
    return tidy(decided(spark, sf_dir).where("status = 'finding'").select(*W.KEYS, "fingerprint"))


HYBRID = f"""{BASE}, md AS (SELECT {KEY}, round(activity_density * 20 + new_process_count / 4, 6) AS sc FROM win),
ms AS (SELECT {KEY}, signal_id, strength FROM rk UNION ALL SELECT {KEY}, 'model-m1', greatest(1, least(100, round_even(50 + 50 * least(1.0::DOUBLE, (sc - 1.5) / 1.5), 0)))::INT FROM md WHERE sc > 1.5),
hy AS (SELECT {KEY}, first(signal_id ORDER BY strength DESC, signal_id) AS primary_signal, count(*) AS n, max(strength) AS ps, coalesce(string_agg(signal_id, ',' ORDER BY signal_id) FILTER (WHERE NOT starts_with(signal_id, 'model-')), '') AS rules,
  sum(round_even(strength * 0.25, 0)) - round_even(max(strength) * 0.25, 0) AS others FROM ms GROUP BY ALL)"""


@query(f"""{HYBRID} SELECT {KEY}, primary_signal, least(100, ps + others + least(12, 4 * (n - 1)))::INT AS detection_score,
left(sha256(concat_ws('|', dataset_kind, user_id, host_id, primary_signal, rules, 'scaled', 'm1')), 24) AS fingerprint FROM hy""")
def d10_d14_hybrid(spark, sf_dir):
    """Rules and a model together: the model's signal leads or corroborates, and is no part of the rules in a fingerprint."""
    w = wins(spark, sf_dir).withColumn("sc", F.round(F.col("activity_density") * 20 + F.col("new_process_count") / 4, 6))
    signals = D.with_signals(w, D.scaled_policy(), D.model_signal(F.col("sc"), F.lit(1.5), F.lit("m1")))
    out = D.with_fingerprint(D.fuse(signals), "scaled", F.lit("m1")).where("n_matched > 0")
    return tidy(out.select(*W.KEYS, "primary_signal", "detection_score", "fingerprint"))


FOUND = f"""{BASE}, g AS (SELECT *, lag(window_start) OVER (PARTITION BY fingerprint ORDER BY window_start) AS p FROM dec WHERE status = 'finding'),
occ AS (SELECT *, sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL 60 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY window_start ROWS UNBOUNDED PRECEDING)::INT AS finding_no FROM g),
fin AS (SELECT dataset_kind, user_id, host_id, fingerprint, finding_no, min(window_start) AS first_seen, max(window_start) AS last_seen, count(*) AS occurrences,
  max(detection_score) AS max_score, first(risk_level ORDER BY detection_score DESC, window_start) AS risk_level, first(primary_signal ORDER BY window_start) AS primary_signal FROM occ GROUP BY dataset_kind, user_id, host_id, fingerprint, finding_no)"""


@query(f"{FOUND} SELECT fingerprint, finding_no, {KEY}, detection_score FROM occ")
def d15_d18_occurrences(spark, sf_dir):
    return tidy(G.occurrence_rows(G.correlate(decided(spark, sf_dir))))


@query(f"{FOUND} SELECT * FROM fin")
def d16_findings(spark, sf_dir):
    return tidy(G.roll_up(G.correlate(decided(spark, sf_dir))))


@query(f"{FOUND} SELECT dataset_kind, user_id, host_id, count(DISTINCT (fingerprint, finding_no)) AS new_findings, count(*) - count(DISTINCT (fingerprint, finding_no)) AS updated_findings, count(*) AS occurrences FROM occ GROUP BY ALL")
def a17_finding_counters(spark, sf_dir):
    return D.finding_counters(G.correlate(decided(spark, sf_dir)))


@query(f"{FOUND} SELECT dataset_kind, user_id, host_id, fingerprint, finding_no, max_score, CASE WHEN occurrences > 1 THEN 2 ELSE 1 END AS steps, CASE WHEN occurrences > 1 THEN 'acknowledged' ELSE 'open' END AS last_status, len(list(window_start))::INT AS n, min(occ.window_start) AS first_at, sum(occ.detection_score)::BIGINT AS total FROM fin JOIN occ USING (dataset_kind, user_id, host_id, fingerprint, finding_no) GROUP BY ALL")
def j7_finding_detail(spark, sf_dir):
    """Findings with occurrences and history: opened at first, acknowledged where they came again."""
    occ = G.correlate(stored_decisions(spark, sf_dir))
    found = G.roll_up(occ)
    opened = found.select("fingerprint", "finding_no", F.lit("open").alias("to_status"), F.col("first_seen").alias("at"))
    seen = found.where("occurrences > 1").select("fingerprint", "finding_no", F.lit("acknowledged").alias("to_status"), F.col("last_seen").alias("at"))
    d = G.detail(found, occ, opened.unionByName(seen))
    steps = F.col("history_list")
    rows = F.col("occurrence_list")
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, o: a + o["detection_score"])
    return tidy(d.select("dataset_kind", "user_id", "host_id", "fingerprint", "finding_no", "max_score", F.size(steps).alias("steps"), F.element_at(steps, -1)["to_status"].alias("last_status"), F.size(rows).alias("n"), rows[0]["window_start"].alias("first_at"), total.alias("total")))


SUPPRESSIONS = [
    ("s1", "signal_for_profile", "real", "user-1", "host-1", "rare-process-v1", None, True, "2024-12-31 00:00:00", "2024-01-01 00:00:00"),
    ("s2", "signal_for_dataset_kind", "synthetic", None, None, "authentication-failure-burst-v1", None, True, "2024-12-31 00:00:00", "2024-01-02 00:00:00"),
    ("s3", "signal_for_dataset_kind", "real", None, None, "resource-pressure-v1", None, True, "2024-01-15 00:00:00", "2024-01-03 00:00:00"),
    ("s4", "signal_for_dataset_kind", "real", None, None, "unusual-hour-activity-v1", None, False, "2024-12-31 00:00:00", "2024-01-04 00:00:00"),
    ("s5", "signal_for_profile", "real", "user-1", "host-1", "unusual-hour-activity-v1", None, True, "2024-12-31 00:00:00", "2024-01-05 00:00:00"),
]
SUPPRESSION_SCHEMA = "suppression_id string, scope string, dataset_kind string, user_id string, host_id string, signal_id string, fingerprint string, active boolean, expires_at string, created_at string"


def suppressions(spark: SparkSession, dec: DataFrame) -> DataFrame:
    """The fixed requests and, from the data, one for the commonest of the fingerprints of user-3."""
    fixed = spark.createDataFrame(SUPPRESSIONS, SUPPRESSION_SCHEMA)
    fixed = fixed.withColumn("expires_at", F.col("expires_at").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    own = dec.where("status = 'finding' and user_id = 'user-3'").groupBy("fingerprint").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fingerprint").limit(1)
    nothing = {c: F.lit(None).cast("string") for c in ("dataset_kind", "user_id", "host_id", "signal_id")}
    own = own.select(F.lit("s6").alias("suppression_id"), F.lit("finding_fingerprint").alias("scope"), *[v.alias(k) for k, v in nothing.items()], "fingerprint", F.lit(True).alias("active"), F.lit("2024-12-31").cast("timestamp").alias("expires_at"), F.lit("2024-01-06").cast("timestamp").alias("created_at"))
    return fixed.unionByName(own)


SUPPRESSED = f"""{BASE}, m AS (SELECT {KEY}, signal_id FROM rk),
top AS (SELECT fingerprint FROM dec WHERE status = 'finding' AND user_id = 'user-3' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
hit AS (
  SELECT {KEY}, 1 AS o, 's1' AS id FROM m WHERE dataset_kind = 'real' AND user_id = 'user-1' AND host_id = 'host-1' AND signal_id = 'rare-process-v1'
  UNION ALL SELECT {KEY}, 5, 's5' FROM m WHERE dataset_kind = 'real' AND user_id = 'user-1' AND host_id = 'host-1' AND signal_id = 'unusual-hour-activity-v1'
  UNION ALL SELECT {KEY}, 2, 's2' FROM m WHERE dataset_kind = 'synthetic' AND signal_id = 'authentication-failure-burst-v1'
  UNION ALL SELECT {KEY}, 100, 's6' FROM dec JOIN top USING (fingerprint) WHERE status = 'finding'),
f AS (SELECT {KEY}, min_by(id, o) AS suppressed_by FROM hit GROUP BY ALL),
sup AS (SELECT dec.* REPLACE (CASE WHEN suppressed_by IS NOT NULL THEN 'suppressed' ELSE status END AS status), suppressed_by FROM dec LEFT JOIN f USING ({KEY}))"""


@query(f"{SUPPRESSED} SELECT {KEY}, status, suppressed_by FROM sup")
def d19_j6_suppressed(spark, sf_dir):
    dec = stored_decisions(spark, sf_dir)
    return tidy(G.suppress(dec, suppressions(spark, dec), NOW).select(*W.KEYS, "status", "suppressed_by"))


@query(f"{SUPPRESSED} SELECT dataset_kind, user_id, host_id, count(*) AS examined, count(*) AS evaluated, 0::BIGINT AS skipped, count(*) FILTER (WHERE status = 'finding') AS findings, count(*) FILTER (WHERE status = 'suppressed') AS suppressed, max(detection_score) AS max_score FROM sup GROUP BY ALL")
def a17_run_counters(spark, sf_dir):
    dec = stored_decisions(spark, sf_dir)
    return D.run_counters(G.suppress(dec, suppressions(spark, dec), NOW))


@query(f"""{SUPPRESSED}, r AS (SELECT dataset_kind, user_id, count(*) AS examined, count(*) FILTER (WHERE status = 'finding') AS findings FROM sup GROUP BY ALL)
SELECT dataset_kind AS parent, sum(examined)::BIGINT AS examined, sum(findings)::BIGINT AS findings, count(*) AS children,
  CASE WHEN bool_or(user_id = 'user-7') THEN 'failed' WHEN bool_or(user_id = 'user-2') THEN 'partial' ELSE 'completed' END AS run_status FROM r GROUP BY ALL""")
def a18_run_rollup(spark, sf_dir):
    dec = stored_decisions(spark, sf_dir)
    runs = D.run_counters(G.suppress(dec, suppressions(spark, dec), NOW))
    status = F.when(F.col("user_id") == "user-7", "failed").when(F.col("user_id") == "user-2", "partial").otherwise("completed")
    return D.run_rollup(runs.withColumn("parent", F.col("dataset_kind")).withColumn("run_status", status))


@query(f"{BASE} SELECT risk_level, status, count(*) AS windows FROM dec GROUP BY ALL")
def a19_dry_run(spark, sf_dir):
    return D.dry_run(decided(spark, sf_dir))[0]


@query(f"{BASE} SELECT {KEY}, detection_score, risk_level, primary_signal FROM dec ORDER BY detection_score DESC, {KEY} LIMIT 5")
def a19_dry_run_samples(spark, sf_dir):
    return tidy(D.dry_run(decided(spark, sf_dir))[1])


WINDOW_ID = f"""wid AS (SELECT {KEY}, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS window_id FROM (
  SELECT {KEY}, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', dataset_kind, user_id, host_id, epoch_us(window_start), epoch_us(window_start) + 3600000000, 'feature-windows-v2'))) AS h FROM win))"""
_FIXED = ", ".join(f"round({f}, 9)::DECIMAL(28,9)::VARCHAR" for f in W.FEATURES)
INPUTS = f"""WITH {TEL}, {windows_sql()}, WINDOW_ID, h AS ({SOURCE_HASH}),
inp AS (SELECT {KEY}, window_id, process_count, sha256(concat_ws('|', dataset_kind, user_id, host_id, epoch_us(window_start)::VARCHAR, 'feature-windows-v2', {_FIXED}, source_event_hash)) AS feature_input_hash FROM win JOIN h USING ({KEY}) JOIN wid USING ({KEY})),
ev AS (SELECT window_id, CASE WHEN hour(window_start) % 3 = 0 THEN feature_input_hash ELSE 'stale' END AS feature_input_hash, CASE WHEN hour(window_start) % 2 = 0 THEN 'p1' ELSE 'p0' END AS policy_hash FROM inp WHERE process_count > 0)"""


@query(INPUTS.replace("WINDOW_ID", WINDOW_ID) + f" SELECT {KEY}, window_id FROM inp WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.window_id = inp.window_id AND ev.feature_input_hash = inp.feature_input_hash AND ev.policy_hash = 'p1')")
def j1_pending(spark, sf_dir):
    """Windows to evaluate under policy p1: of those with processes some are evaluated, some with an older input or policy."""
    w = whole_windows(spark, sf_dir).select(*W.KEYS, "process_count", "feature_input_hash", ids.window_id(60).alias("window_id"))
    w = materialize(w.withColumn("policy_hash", F.lit("p1")).withColumn("model_id", F.lit(None).cast("string")), "inputs")
    seen = w.where("process_count > 0").select(
        "window_id", F.when(F.hour("window_start") % 3 == 0, F.col("feature_input_hash")).otherwise("stale").alias("feature_input_hash"),
        F.when(F.hour("window_start") % 2 == 0, "p1").otherwise("p0").alias("policy_hash"), "model_id",
    )
    return tidy(D.pending(w, seen).select(*W.KEYS, "window_id"))


@query(f"""WITH {TEL}, {windows_sql()} SELECT dataset_kind, user_id, host_id, CASE WHEN user_id IN ('user-0', 'user-4', 'user-8') THEN 'm-' || user_id END AS model_id,
CASE WHEN user_id IN ('user-0', 'user-4', 'user-8') THEN 'rules+model' ELSE 'rules_only' END AS hybrid, CASE WHEN user_id IN ('user-0', 'user-4', 'user-8') THEN 'model_only' ELSE 'blocked' END AS model_only, count(*) AS windows FROM win GROUP BY ALL""")
def j5_d26_route(spark, sf_dir):
    w = wins(spark, sf_dir)
    champions = w.where("user_id in ('user-0', 'user-4', 'user-8')").select(*W.PROFILE).distinct().withColumn("model_id", F.concat(F.lit("m-"), "user_id"))
    both = D.route(w, champions, "hybrid").select(*W.KEYS, "model_id", F.col("path").alias("hybrid"))
    only = D.route(w, champions, "model_only").select(*W.KEYS, F.col("path").alias("model_only"))
    return both.join(only, W.KEYS).groupBy(*W.PROFILE, "model_id", "hybrid", "model_only").agg(F.count("*").alias("windows"))


@query(f"""{BASE} SELECT {KEY}, sc > 1.5 AS matched, CASE WHEN sc > 1.5 THEN greatest(1, least(100, round_even(50 + 50 * least(1.0::DOUBLE, (sc - 1.5) / 1.5), 0)))::INT ELSE 0 END AS strength
FROM (SELECT {KEY}, round(activity_density * 20 + new_process_count / 4, 6) AS sc FROM win)""")
def d10_model_signal(spark, sf_dir):
    w = wins(spark, sf_dir).withColumn("sc", F.round(F.col("activity_density") * 20 + F.col("new_process_count") / 4, 6))
    s = D.model_signal(F.col("sc"), F.lit(1.5), F.lit("m1"))
    return tidy(w.select(*W.KEYS, s["matched"].alias("matched"), s["strength"].alias("strength")))


MOVES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in G.MOVES.items() for b in to) + ") m(from_status, to_status)"
REQUESTS = """r AS (SELECT event_id AS finding_id, (['open', 'acknowledged', 'investigating', 'suppressed', 'resolved', 'false_positive'])[event_id % 6 + 1] AS from_status,
  (['open', 'acknowledged', 'investigating', 'suppressed', 'resolved', 'false_positive'])[(event_id // 6) % 6 + 1] AS to_status, event_id % 5 <> 0 AS confirm, ts FROM events)"""


@query(f"WITH {REQUESTS} SELECT r.finding_id, r.from_status, r.to_status, CASE WHEN r.to_status IN ('resolved', 'false_positive') AND NOT confirm THEN 'needs confirmation' WHEN m.to_status IS NULL THEN 'no such move' END AS refused FROM r LEFT JOIN {MOVES_SQL} ON m.from_status = r.from_status AND m.to_status = r.to_status")
def d23_transitions(spark, sf_dir):
    return G.transitions(_requests(spark, sf_dir), G.moves_table(spark)).select("finding_id", "from_status", "to_status", "refused")


def _requests(spark, sf_dir):
    from loomwatch.sources.telemetry import read_events

    states = F.array(*map(F.lit, ("open", "acknowledged", "investigating", "suppressed", "resolved", "false_positive")))
    e = read_events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("finding_id"), F.get(states, (F.col("event_id") % 6).cast("int")).alias("from_status"),
        F.get(states, (F.floor(F.col("event_id") / 6) % 6).cast("int")).alias("to_status"), (F.col("event_id") % 5 != 0).alias("confirm"), F.col("ts").cast("timestamp").alias("at"),
    )


@query(f"WITH {REQUESTS} SELECT finding_id % 500 AS finding_id, max_by(to_status, ts) AS status, count(*) AS moves FROM r GROUP BY ALL")
def d23_latest_state(spark, sf_dir):
    return G.latest_state(_requests(spark, sf_dir).withColumn("finding_id", F.col("finding_id") % 500))


@query(f"""WITH {TEL}, p AS (SELECT DISTINCT dataset_kind, user_id, host_id FROM tel),
r AS (SELECT *, (substr(user_id, 6)::INT) AS u FROM p)
SELECT user_id AS request_id, CASE WHEN u = 9 THEN 'unknown scope' WHEN u = 8 THEN 'fields do not fit the scope' WHEN u = 7 THEN 'duration out of bounds' WHEN u = 6 THEN 'unknown signal' WHEN u = 1 THEN 'an equal one is in force' END AS refused FROM r""")
def d21_suppression_requests(spark, sf_dir):
    p = wins(spark, sf_dir).select(*W.PROFILE).distinct().withColumn("u", F.substring("user_id", 6, 9).cast("int"))
    r = p.select(
        F.col("user_id").alias("request_id"), F.when(F.col("u") == 9, "everything").otherwise("signal_for_profile").alias("scope"), "dataset_kind",
        F.when(F.col("u") != 8, F.col("user_id")).alias("user_id"), "host_id", F.when(F.col("u") == 6, "none-such").otherwise("rare-process-v1").alias("signal_id"),
        F.lit(None).cast("string").alias("fingerprint"), F.when(F.col("u") == 7, 0).otherwise(60).alias("ttl_minutes"),
    )
    fixed = spark.createDataFrame(SUPPRESSIONS, SUPPRESSION_SCHEMA).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return G.check_requests(r, fixed, list(D.DEFAULT_POLICY), NOW).select("request_id", "refused")


@query("""WITH l AS (SELECT 'scope-' || (user_id % 10) AS scope, 'policy-' || (event_id % 7) AS policy_id, ts AS "at", event_id FROM events)
SELECT scope, policy_id, "at", lag(policy_id) OVER (PARTITION BY scope ORDER BY "at", policy_id) AS previous, row_number() OVER (PARTITION BY scope ORDER BY "at" DESC, policy_id DESC) = 1 AS active FROM l""")
def d27_activation(spark, sf_dir):
    from loomwatch.sources.telemetry import read_events

    e = read_events(spark, sf_dir)
    log = e.select(F.concat(F.lit("scope-"), F.col("user_id") % 10).alias("scope"), F.concat(F.lit("policy-"), F.col("event_id") % 7).alias("policy_id"), F.col("ts").cast("timestamp").alias("at"))
    return tidy(D.activation_log(log))


@query(f"{BASE}, r AS (SELECT status AS s, count(*) AS n, max(detection_score) AS m, max(window_start) AS latest FROM dec GROUP BY ALL) SELECT s AS status, n AS evaluations, m AS max_score, latest FROM r")
def a16_detection_status(spark, sf_dir):
    out = decided(spark, sf_dir).groupBy("status").agg(F.count("*").alias("evaluations"), F.max("detection_score").alias("max_score"), F.max("window_start").alias("latest"))
    return tidy(out)


@query(f"{BASE}, {WINDOW_ID} SELECT dataset_kind, user_id, host_id, 'scaled' AS policy_hash, CASE WHEN hour(window_start) < 12 THEN 'm1' ELSE 'none' END AS model_id, max(window_start) AS window_start, max_by(window_id, window_start) AS window_id, count(*) AS evaluated FROM dec JOIN wid USING ({KEY}) GROUP BY ALL")
def t13_detection_watermark(spark, sf_dir):
    """Where detection stands; windows before noon went through a model."""
    model = F.when(F.hour("window_start") < 12, "m1")
    rows = decided(spark, sf_dir).withColumn("policy_hash", F.lit("scaled")).withColumn("model_id", model).withColumn("window_id", ids.window_id(60))
    return tidy(detection_watermark(rows))
