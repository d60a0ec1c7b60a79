"""Queries over what depends on order: findings that go on, requests on findings and models, and the comparison of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomwatch.functions import ids
from loomwatch.operators import detection as D, findings as G, model_registry as R, scoring as M, snapshots as P, windows as W
from loomwatch.plans.detection_queries import BASE, stored_decisions
from loomwatch.plans.registry import KEY, TEL, query, tidy, windows_sql
from loomwatch.plans.report_queries import SCORED, _scored
from loomwatch.plans.snapshot_queries import PROFILE, SPLIT, _split
from loomwatch.plans.windows_queries import tel, wins
from loomwatch.session import materialize
from loomwatch.sources import telemetry as S

# --- findings that go on

#: Stored are findings of the hours 0, 1, 6, 7, ... of a day, a third of them resolved; the other hours come after them, one by one.
CHAINS = f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, fd AS (SELECT * FROM dec WHERE status = 'finding'),
og AS (SELECT *, lag(window_start) OVER (PARTITION BY fingerprint ORDER BY window_start) AS p FROM fd WHERE hour(window_start) % 6 < 2),
od AS (SELECT *, sum(CASE WHEN p IS NULL OR window_start - p > INTERVAL 60 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY window_start) AS no FROM og),
st AS (SELECT dataset_kind, user_id, host_id, fingerprint, 's-' || fingerprint || '-' || no AS finding_id, min(window_start) AS first_seen, max(window_start) AS last_seen, count(*) AS occurrences, max(detection_score) AS max_score,
  first(risk_level ORDER BY detection_score DESC, window_start) AS risk_level, first(primary_signal ORDER BY window_start) AS primary_signal, CASE no % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'investigating' END AS status FROM od GROUP BY dataset_kind, user_id, host_id, fingerprint, no),
nw AS (SELECT fingerprint, window_start, epoch_us(window_start) AS t, row_number() OVER (PARTITION BY fingerprint ORDER BY window_start) AS i FROM fd WHERE hour(window_start) % 6 >= 2),
s0 AS (SELECT fingerprint, coalesce(list({{'id': finding_id, 'f': epoch_us(first_seen), 'l': epoch_us(last_seen), 'x': false}}) FILTER (WHERE finding_id IS NOT NULL AND status <> 'resolved'), []) AS held FROM (SELECT DISTINCT fingerprint FROM nw) LEFT JOIN st USING (fingerprint) GROUP BY fingerprint),
rc AS (SELECT fingerprint, 0::BIGINT AS i, held, NULL::VARCHAR AS finding_id, NULL::BOOLEAN AS is_new FROM s0
  UNION ALL SELECT fingerprint, i, CASE WHEN hit IS NULL THEN list_append(held, {{'id': 'f-' || fingerprint || '-' || t, 'f': t, 'l': t, 'x': true}})
    ELSE list_transform(held, lambda s: CASE WHEN s.id = hit.id THEN {{'id': s.id, 'f': least(s.f, t), 'l': greatest(s.l, t), 'x': s.x OR t > s.l}} ELSE s END) END, coalesce(hit.id, 'f-' || fingerprint || '-' || t),
    CASE WHEN hit IS NULL THEN true ELSE starts_with(hit.id, 'f-') END
  FROM (SELECT rc.fingerprint, nw.i, held, nw.t, list_reverse_sort(list_transform(list_filter(held, lambda s: s.f <= nw.t + 3600000000 AND s.l >= nw.t - 3600000000), lambda s: {{'l': s.l, 'x': s.x, 'id': s.id}}))[1] AS hit
    FROM rc JOIN nw ON nw.fingerprint = rc.fingerprint AND nw.i = rc.i + 1)),
att AS (SELECT fd.*, rc.finding_id, rc.is_new FROM rc JOIN nw USING (fingerprint, i) JOIN fd ON fd.fingerprint = nw.fingerprint AND fd.window_start = nw.window_start),
ag AS (SELECT finding_id, fingerprint, dataset_kind, user_id, host_id, bool_or(is_new) AS fresh, min(window_start) AS f, max(window_start) AS l, count(*) AS n, max(detection_score) AS s, first(risk_level ORDER BY detection_score DESC, window_start) AS r, first(primary_signal ORDER BY window_start) AS p FROM att GROUP BY ALL),
cl AS (SELECT fingerprint, max_by(finding_id, last_seen) AS related_previous FROM st WHERE status = 'resolved' GROUP BY ALL)"""


def _chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(stored findings, occurrences that come after)."""
    rows = stored_decisions(spark, sf_dir).where("status = 'finding'")
    early = F.hour("window_start") % 6 < 2
    found = G.roll_up(G.correlate(rows.where(early)))
    status = F.when(F.col("finding_no") % 3 == 0, "resolved").when(F.col("finding_no") % 3 == 1, "open").otherwise("investigating")
    stored = found.select(
        F.concat_ws("-", F.lit("s"), "fingerprint", "finding_no").alias("finding_id"), "fingerprint", *W.PROFILE, status.alias("status"), "first_seen", "last_seen", "occurrences", "max_score", "risk_level", "primary_signal",
        F.lit(None).cast("string").alias("related_previous"),
    )
    return materialize(stored, "stored-findings"), rows.where(~early)


@query(f"{CHAINS} SELECT {KEY}, fingerprint, finding_id, is_new FROM att")
def d15_attach_to_stored(spark, sf_dir):
    """Where each later occurrence goes: to a stored finding, also through a chain of others, or to a new one."""
    stored, later = _chains(spark, sf_dir)
    return tidy(G.attach(later, stored).select(*W.KEYS, "fingerprint", "finding_id", "is_new"))


@query(f"""{CHAINS} SELECT st.finding_id, st.dataset_kind, st.user_id, st.host_id, st.status, least(first_seen, f) AS first_seen, greatest(last_seen, l) AS last_seen, occurrences + coalesce(n, 0) AS occurrences, greatest(max_score, s) AS max_score,
  CASE WHEN s > max_score THEN r ELSE risk_level END AS risk_level, primary_signal, NULL AS related_previous FROM st LEFT JOIN ag USING (finding_id)
UNION ALL SELECT finding_id, dataset_kind, user_id, host_id, 'open', f, l, n, s, r, p, related_previous FROM ag LEFT JOIN cl USING (fingerprint) WHERE fresh""")
def d15_d17_merged_findings(spark, sf_dir):
    """All findings after the later occurrences, new ones with the resolved finding before them."""
    stored, later = _chains(spark, sf_dir)
    placed = materialize(G.attach(later, stored), "attached")
    return tidy(G.merge_findings(stored, placed).drop("fingerprint"))


@query(f"{CHAINS} SELECT finding_id, related_previous FROM ag LEFT JOIN cl USING (fingerprint) WHERE fresh")
def d17_related_previous(spark, sf_dir):
    stored, later = _chains(spark, sf_dir)
    fresh = G.attach(later, stored).where("is_new").select("finding_id", "fingerprint").distinct()
    return G.related_previous(fresh, stored.where(F.col("status").isin(*G.ENDED))).select("finding_id", "related_previous")


# --- requests on findings

STATES = ("open", "acknowledged", "investigating", "suppressed", "resolved", "false_positive")
#: Every event asks for a move of one of some findings, as many as there are 64 events.
FINDING_LOG = f"""WITH RECURSIVE n AS (SELECT greatest(1, count(*) // 64) AS n FROM events),
q AS (SELECT 'f' || (event_id % n) AS finding_id, event_id AS request_id, ts AS "at", ([{', '.join(f"'{s}'" for s in STATES)}])[(event_id // 7) % 6 + 1] AS to_status, event_id % 5 <> 0 AS confirm, row_number() OVER (PARTITION BY event_id % n ORDER BY ts, event_id) AS i FROM events, n),
mv(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, to in G.MOVES.items() for b in to)}),
rc AS (SELECT DISTINCT finding_id, 0::BIGINT AS i, 'open' AS status, NULL::BIGINT AS request_id, NULL::VARCHAR AS from_status, NULL::VARCHAR AS to_status, NULL::VARCHAR AS refused FROM q
  UNION ALL SELECT finding_id, i, CASE WHEN refused IS NULL THEN to_status ELSE from_status END, request_id, from_status, to_status, refused FROM (
    SELECT rc.finding_id, q.i, rc.status AS from_status, q.request_id, q.to_status,
      CASE WHEN q.to_status IN ('resolved', 'false_positive') AND NOT confirm THEN 'needs confirmation' WHEN b IS NULL THEN 'no such move' END AS refused
    FROM rc JOIN q ON q.finding_id = rc.finding_id AND q.i = rc.i + 1 LEFT JOIN mv ON a = rc.status AND b = q.to_status))"""


def _finding_log(spark, sf_dir):
    e = S.read_events(spark, sf_dir)
    n = e.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 64)).alias("n"))
    to = F.get(F.array(*map(F.lit, STATES)), (F.floor(F.col("event_id") / 7) % 6).cast("int"))
    rows = e.crossJoin(F.broadcast(n))  # one row
    return rows.select(F.concat(F.lit("f"), F.col("event_id") % F.col("n")).alias("finding_id"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), to.alias("to_status"), (F.col("event_id") % 5 != 0).alias("confirm"))


@query(f"{FINDING_LOG} SELECT finding_id, request_id, from_status, to_status, refused FROM rc WHERE i > 0")
def d23_finding_moves(spark, sf_dir):
    """Each request judged by the state that the accepted ones before it left."""
    return G.finding_moves(_finding_log(spark, sf_dir)).select("finding_id", "request_id", "from_status", "to_status", "refused")


#: Every event asks for a suppression of a signal for its profile, for up to a week.
SIGNALS = list(D.DEFAULT_POLICY)
ADMITTED = f"""WITH RECURSIVE {TEL}, q0 AS (SELECT event_id AS request_id, ts AS "at", dataset_kind, user_id, host_id, ([{', '.join(f"'{s}'" for s in SIGNALS)}, 'none-such'])[k % 6 + 1] AS signal_id, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 60 * (1 + event_id % 168) END AS ttl FROM tel),
q AS (SELECT *, row_number() OVER (PARTITION BY {PROFILE}, signal_id ORDER BY "at", request_id) AS i, CASE WHEN ttl = 0 THEN 'duration out of bounds' WHEN signal_id = 'none-such' THEN 'unknown signal' END AS wrong FROM q0),
rc AS (SELECT DISTINCT {PROFILE}, signal_id, 0::BIGINT AS i, CASE WHEN user_id = 'user-1' AND signal_id = 'rare-process-v1' THEN TIMESTAMP '2024-01-12' ELSE TIMESTAMP '2000-01-01' END AS until, NULL::BIGINT AS request_id, NULL::VARCHAR AS refused FROM q
  UNION ALL SELECT {PROFILE}, signal_id, i, CASE WHEN refused IS NULL THEN "at" + to_minutes(ttl) ELSE until END, request_id, refused FROM (
    SELECT q.dataset_kind, q.user_id, q.host_id, q.signal_id, q.i, q."at", q.ttl, rc.until, q.request_id, coalesce(q.wrong, CASE WHEN rc.until > q."at" THEN 'an equal one is in force' END) AS refused
    FROM rc JOIN q ON q.dataset_kind = rc.dataset_kind AND q.user_id = rc.user_id AND q.host_id = rc.host_id AND q.signal_id = rc.signal_id AND q.i = rc.i + 1))"""


@query(f"{ADMITTED} SELECT {PROFILE}, signal_id, request_id, refused FROM rc WHERE i > 0")
def d21_admission(spark, sf_dir):
    """Of equal requests the first is in force until its time is over."""
    t = tel(spark, sf_dir)
    signal = F.get(F.array(*map(F.lit, [*SIGNALS, "none-such"])), F.col("k") % 6)
    ttl = F.when(F.col("event_id") % 13 == 0, 0).otherwise(60 * (1 + F.col("event_id") % 168))
    r = t.select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"), F.lit("signal_for_profile").alias("scope"), *W.PROFILE, signal.alias("signal_id"), F.lit(None).cast("string").alias("fingerprint"), ttl.alias("ttl_minutes"))
    one = t.where("user_id = 'user-1'").select(*W.PROFILE).distinct()
    held = one.select(F.lit("signal_for_profile").alias("scope"), *W.PROFILE, F.lit("rare-process-v1").alias("signal_id"), F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("active"), F.lit("2024-01-12").cast("timestamp").alias("expires_at"))
    return G.admit_requests(r, held, SIGNALS).select(*W.PROFILE, "signal_id", "request_id", "refused")


# --- requests on models

#: Every event asks for a move of one of five models of its profile; the fourth has no evaluation, the third fails its checks for one user, the fifth is unknown.
ACTIONS = ("promote", "recommend", "rollback", "retire", "promote", "rollback")
MODEL_LOG = f"""WITH RECURSIVE {TEL}, q AS (SELECT {PROFILE}, event_id AS request_id, ts AS "at", k % 5 AS m, ([{', '.join(f"'{a}'" for a in ACTIONS)}])[event_id % 6 + 1] AS action, event_id % 11 <> 0 AS confirm, NOT (k % 5 = 2 AND user_id = 'user-4') AS fine,
  row_number() OVER (PARTITION BY {PROFILE} ORDER BY ts, event_id) AS i FROM tel),
rc AS (SELECT DISTINCT {PROFILE}, 0::BIGINT AS i, ['candidate', 'candidate', 'candidate', 'candidate'] AS st, NULL::VARCHAR AS champion, NULL::BIGINT AS request_id, NULL::TIMESTAMP AS "at", NULL::VARCHAR AS action, NULL::VARCHAR AS model_id, NULL::VARCHAR AS refused, NULL::VARCHAR AS previous FROM q
  UNION ALL SELECT {PROFILE}, i,
    CASE WHEN refused IS NOT NULL THEN st ELSE list_transform(st, lambda s, j: CASE WHEN j = m + 1 THEN CASE action WHEN 'recommend' THEN 'recommended' WHEN 'retire' THEN 'retired' ELSE 'champion' END WHEN s = 'champion' AND action IN ('promote', 'rollback') THEN 'retired' ELSE s END) END,
    CASE WHEN refused IS NOT NULL OR action = 'recommend' THEN champion WHEN action = 'retire' THEN NULL ELSE 'm' || m END, request_id, "at", action, 'm' || m, refused, CASE WHEN refused IS NULL AND action <> 'recommend' THEN champion END
  FROM (SELECT q.dataset_kind, q.user_id, q.host_id, q.i, rc.st, rc.champion, q.request_id, q."at", q.action, q.m,
    CASE WHEN NOT confirm THEN CASE q.action WHEN 'promote' THEN 'promotion' WHEN 'recommend' THEN 'recommendation' WHEN 'retire' THEN 'retirement' ELSE 'rollback' END || ' requires confirmation'
      WHEN m = 4 THEN 'model is not registered' WHEN q.action = 'recommend' AND NOT fine THEN 'model is not verified'
      WHEN q.action = 'promote' AND rc.st[m + 1] = 'champion' THEN 'model is already champion' WHEN q.action = 'promote' AND rc.st[m + 1] = 'retired' THEN 'retired model cannot be promoted'
      WHEN q.action = 'rollback' AND rc.st[m + 1] <> 'retired' THEN 'rollback is allowed only for retired models' WHEN q.action = 'retire' AND rc.st[m + 1] <> 'champion' THEN 'only champion models can be retired'
      WHEN q.action = 'recommend' AND rc.st[m + 1] <> 'candidate' THEN 'only candidate models can be recommended' WHEN NOT fine THEN 'model is not verified'
      WHEN m = 3 AND q.action <> 'retire' THEN 'model evaluation is required before promotion' END AS refused
    FROM rc JOIN q ON q.dataset_kind = rc.dataset_kind AND q.user_id = rc.user_id AND q.host_id = rc.host_id AND q.i = rc.i + 1)),
z AS (SELECT {PROFILE}, max_by(st, i) AS st, max_by(champion, i) AS champion FROM (SELECT * REPLACE (coalesce(champion, '') AS champion) FROM rc) GROUP BY ALL)"""


def _registry(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(models, moves); the moves written once."""
    t = tel(spark, sf_dir)
    model = F.concat(F.lit("m"), F.col("k") % 5)
    action = F.get(F.array(*map(F.lit, ACTIONS)), (F.col("event_id") % 6).cast("int"))
    log = t.select(*W.PROFILE, F.col("event_id").alias("request_id"), F.col("ts").alias("at"), model.alias("model_id"), action.alias("action"), (F.col("event_id") % 11 != 0).alias("confirm"))
    models = t.select(*W.PROFILE).distinct().withColumn("model_id", F.explode(F.array(*[F.lit(f"m{i}") for i in range(4)])))
    models = models.withColumn("evaluated", F.col("model_id") != "m3").withColumn("verified", (F.col("model_id") != "m2") | (F.col("user_id") != "user-4"))
    return models, materialize(R.registry_moves(log, models), "registry-moves")


@query(f'{MODEL_LOG} SELECT {PROFILE}, request_id, model_id, action, refused, previous, champion FROM rc WHERE i > 0')
def m25_registry_moves(spark, sf_dir):
    """Each request on a model judged by what the accepted ones before it left."""
    return _registry(spark, sf_dir)[1].select(*W.PROFILE, "request_id", "model_id", "action", "refused", "previous", "champion")


@query(f"""{MODEL_LOG}, c AS (SELECT {PROFILE}, max("at") AS since FROM rc WHERE i > 0 AND refused IS NULL AND action <> 'recommend' GROUP BY ALL)
SELECT {PROFILE}, champion AS model_id, since FROM z JOIN c USING ({PROFILE}) WHERE champion <> ''""")
def m25_champions(spark, sf_dir):
    """One champion a profile at most."""
    return tidy(R.champions(_registry(spark, sf_dir)[1]))


@query(f"{MODEL_LOG} SELECT {PROFILE}, 'm' || unnest(range(4)) AS model_id, unnest(st) AS lifecycle_status FROM z")
def m25_lifecycle(spark, sf_dir):
    models, moves = _registry(spark, sf_dir)
    return R.lifecycle(models, moves).select(*W.PROFILE, "model_id", "lifecycle_status")


# --- listings


@query(f"""{MODEL_LOG} SELECT {PROFILE}, request_id, "at", action, CASE WHEN action = 'retire' THEN NULL ELSE model_id END AS new_model_id, previous FROM rc WHERE i > 0 AND refused IS NULL AND action <> 'recommend' AND dataset_kind = 'real'""")
def w6_promotions_listed(spark, sf_dir):
    """The moves of champions of real profiles, the newest first."""
    moves = _registry(spark, sf_dir)[1].where("refused is null and action <> 'recommend'")
    rows = moves.select(*W.PROFILE, "request_id", "at", "action", F.when(F.col("action") != "retire", F.col("model_id")).alias("new_model_id"), "previous")
    return tidy(M.listed(rows, "at", "request_id", dataset_kind="real"))


@query(f"{MODEL_LOG}, a AS (SELECT {PROFILE}, 'm' || unnest(range(4)) AS model_id, unnest(st) AS lifecycle_status FROM z) SELECT * FROM a WHERE dataset_kind = 'synthetic' AND lifecycle_status = 'champion'")
def w6_models_listed(spark, sf_dir):
    """The champions of synthetic profiles."""
    rows = R.lifecycle(*_registry(spark, sf_dir)).select(*W.PROFILE, "model_id", "lifecycle_status")
    return M.listed(rows, "model_id", "user_id", dataset_kind="synthetic", lifecycle_status="champion")


@query("""WITH l AS (SELECT 'scope-' || (user_id % 10) AS scope, 'policy-' || (event_id % 7) AS policy_id, ts AS "at" FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY "at" DESC, policy_id DESC) AS r FROM l)
SELECT scope, policy_id, "at" FROM a WHERE r = 1""")
def w6_policies_listed(spark, sf_dir):
    """The policies in force, those activated last first."""
    e = S.read_events(spark, sf_dir)
    log = e.select(F.concat(F.lit("scope-"), F.col("user_id") % 10).alias("scope"), F.concat(F.lit("policy-"), F.col("event_id") % 7).alias("policy_id"), F.col("ts").cast("timestamp").alias("at"))
    return tidy(M.listed(D.activation_log(log).where("active").select("scope", "policy_id", "at"), "at", "policy_id"))


# --- comparison of models

#: Three models a profile flag 2, 5 and 15 % of its calibration; positives of the test part are windows with two failed logins. One user's strict model has another split, another's is not verified.
RATES = {"loose": 0.15, "strict": 0.02, "usual": 0.05}
CANDIDATES = f"""{SCORED}, cr(model_id, rate) AS (VALUES {', '.join(f"('{m}', {r}::DOUBLE)" for m, r in RATES.items())}),
ct AS (SELECT {PROFILE}, model_id, score AS threshold FROM cq, cr WHERE n >= 12 AND r = 1 + ceil((n - 1) * (1 - rate))),
cs AS (SELECT sc.dataset_kind, sc.user_id, sc.host_id, model_id, score, score >= threshold AS flagged, auth_failure_count >= 2 AS positive FROM sc JOIN sp USING ({KEY}) JOIN ct ON ct.dataset_kind = sc.dataset_kind AND ct.user_id = sc.user_id AND ct.host_id = sc.host_id WHERE sc.split = 'test'),
cg AS (SELECT {PROFILE}, model_id, score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n, count(*) FILTER (WHERE positive AND flagged) AS tp, count(*) FILTER (WHERE NOT positive AND flagged) AS fp FROM cs GROUP BY ALL),
cc AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM cg WINDOW w AS (PARTITION BY {PROFILE}, model_id ORDER BY score DESC)),
ce AS (SELECT {PROFILE}, model_id, coalesce(sum(tp) / nullif(sum(p), 0), 0) AS recall, coalesce(sum(fp) / nullif(sum(n), 0), 0) AS fpr, sum(p * cp / (cp + cn)) / nullif(sum(p), 0) AS pr_auc, NOT (user_id = 'user-8' AND model_id = 'strict') AS verified,
  CASE WHEN user_id = 'user-6' AND model_id = 'strict' THEN 'other' ELSE 'split' END AS split_id FROM cc GROUP BY ALL),
cv AS (SELECT *, row_number() OVER (PARTITION BY {PROFILE} ORDER BY round(recall, 9) DESC, round(fpr, 9), round(coalesce(pr_auc, 0), 9) DESC, model_id)::INT AS place FROM ce)"""


def _candidates(spark, sf_dir) -> DataFrame:
    """(profile, model_id, recall, scenario_recall, fpr, pr_auc, verified and what models are compared by); written once."""
    scored = materialize(_scored(spark, sf_dir).drop("threshold", "risk_level"), "candidate-scores")
    rows = _split(spark, sf_dir)
    marked = scored.where("split = 'test'").join(rows.select(*W.KEYS, (F.col("auth_failure_count") >= 2).alias("positive")), W.KEYS)
    calibration = scored.where("split = 'calibration'")
    cuts = reduce(DataFrame.unionByName, [P.calibrate(calibration, W.PROFILE, r).select(*W.PROFILE, "threshold", F.lit(m).alias("model_id")) for m, r in RATES.items()])
    flagged = marked.join(cuts, W.PROFILE).withColumn("flagged", F.col("score") >= F.col("threshold"))
    found = P.ranking_quality(flagged, [*W.PROFILE, "model_id"]).select(*W.PROFILE, "model_id", *[F.round(c, 9).alias(c) for c in ("recall", "fpr", "pr_auc")])
    strict = F.col("model_id") == "strict"
    named = found.withColumn("scenario_recall", F.col("recall")).withColumn("inference_seconds", F.lit(0.0)).withColumn("verified", ~(strict & (F.col("user_id") == "user-8")))
    named = named.withColumn("dataset_id", F.concat(F.lit("d-"), "user_id")).withColumn("split_id", F.when(strict & (F.col("user_id") == "user-6"), "other").otherwise("split"))
    return materialize(named.withColumn("schema_version", F.lit(W.SCHEMA_VERSION)).withColumn("feature_names", F.lit(",".join(W.FEATURES))), "candidates")


@query(f"{CANDIDATES} SELECT {PROFILE}, model_id, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(pr_auc, 6) AS pr_auc, place FROM cv")
def w5_candidate_ranking(spark, sf_dir):
    """Candidates of each profile by what their flags and scores are worth on the test part."""
    return tidy(M.rank_candidates(_candidates(spark, sf_dir), W.PROFILE).select(*W.PROFILE, "model_id", "recall", "fpr", "pr_auc", "place"))


COMPARED_BY = ["dataset_kind", "user_id", "host_id", "schema_version", "feature_names", "dataset_id", "split_id"]


@query(f"{CANDIDATES} SELECT a.dataset_kind, a.user_id, a.host_id, a.model_id AS left_model_id, b.model_id AS right_model_id FROM ce a JOIN ce b USING ({PROFILE}) WHERE a.model_id < b.model_id AND a.split_id <> b.split_id")
def m28_pairs_that_do_not_compare(spark, sf_dir):
    return R.comparison(_candidates(spark, sf_dir), W.PROFILE, COMPARED_BY)[0].select(*W.PROFILE, "left_model_id", "right_model_id")


@query(f"{CANDIDATES} SELECT {PROFILE}, model_id, place FROM cv WHERE dataset_kind = 'synthetic' AND user_id NOT IN ('user-6', 'user-8')")
def m28_recommendation_order(spark, sf_dir):
    """Orders only where all models of a synthetic profile are verified and compare."""
    return R.comparison(_candidates(spark, sf_dir), W.PROFILE, COMPARED_BY)[1].select(*W.PROFILE, "model_id", "place")


@query(f"{CANDIDATES} SELECT {PROFILE}, model_id, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM cv WHERE place = 1 AND dataset_kind = 'synthetic' AND recall = 1 AND fpr <= 0.15")
def m26_auto_promotion(spark, sf_dir):
    """The best candidates that may become champions without a request: whole recall, few false alarms."""
    best = M.rank_candidates(_candidates(spark, sf_dir), W.PROFILE).withColumn("recommended", F.col("place") == 1)
    return tidy(R.auto_promoted(best).select(*W.PROFILE, "model_id", "recall", "fpr"))


# --- contracts of models and runs

#: A model for each profile with enough rows, from the fitted preprocessor, some of them put wrong.
@query(f"""{SPLIT}, u AS (SELECT DISTINCT user_id FROM sp WHERE c1 >= 32 AND c2 >= 12 AND n - c1 - c2 >= 12)
SELECT 'm-' || user_id AS model_id, unnest(CASE user_id WHEN 'user-5' THEN ['spread above zero'] WHEN 'user-6' THEN ['feature names or order'] WHEN 'user-7' THEN ['feature names or order', 'twelve values'] WHEN 'user-8' THEN ['finite values', 'input width'] WHEN 'user-9' THEN ['finite threshold', 'split ranges in order', 'split counts'] END) AS "check" FROM u""")
def m30_parameter_checks(spark, sf_dir):
    rows = _split(spark, sf_dir).where("enough")
    fitted = P.fit_preprocessor(rows.where("split = 'train'"))
    user, position = F.col("user_id"), F.array_position(F.array(*map(F.lit, W.FEATURES)), F.col("feature"))
    pre = fitted.withColumn("position", F.when((user == "user-6") & (position < 3), 3 - position).otherwise(position))
    pre = pre.where((user != "user-7") | (F.col("position") != 12)).withColumn("std", F.when((user == "user-5") & (F.col("position") == 4), 0.0).otherwise(F.col("std")))
    pre = pre.withColumn("median", F.when((user == "user-8") & (F.col("position") == 2), F.lit(float("nan"))).otherwise(F.col("median")))
    at = lambda split, f: f(F.when(F.col("split") == split, F.col("window_start")))
    parts = ("train", "calibration", "test")
    ranges = rows.groupBy(*W.PROFILE).agg(*[c for p in parts for c in (at(p, F.min).alias(f"{p}_start"), at(p, F.max).alias(f"{p}_end"), at(p, F.count).alias(f"{p}_count"))])
    model = F.concat(F.lit("m-"), user).alias("model_id")
    odd = user == "user-9"
    models = ranges.select(
        model, F.when(user == "user-8", 11).otherwise(12).alias("input_width"), F.when(odd, F.lit(float("inf"))).otherwise(1.0).alias("threshold"),
        *[F.when(odd & F.lit(p == "test"), F.col("train_start")).otherwise(F.col(f"{p}_start")).alias(f"{p}_start") for p in parts], *[f"{p}_end" for p in parts], *[f"{p}_count" for p in parts],
        *[(F.col(f"{p}_count") + odd.cast("int")).alias(f"{p}_rows") for p in parts],
    )
    return R.parameter_violations(pre.select(model, "position", "feature", "mean", "std", "median", "iqr"), models)


#: A training run a profile and day that claims two models; what is wrong with it goes by the day.
RUNS = f"""WITH {TEL}, {windows_sql()}, d AS (SELECT DISTINCT {PROFILE}, user_id || '|' || window_start::DATE AS run, day(window_start) AS n FROM win),
v AS (SELECT *, CASE n % 10 WHEN 0 THEN 'training run finalization requires at least one model' WHEN 1 THEN 'training run is not running' WHEN 2 THEN 'not all candidate model rows exist' WHEN 3 THEN 'candidate model is already finalized' WHEN 4 THEN 'candidate dataset id does not match training run'
  WHEN 5 THEN 'candidate dataset hash does not match training run' WHEN 6 THEN 'candidate profile does not match training run' WHEN 7 THEN 'candidate split does not match training run' END AS reason FROM d)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    day = F.col("window_start").cast("date")
    n = F.col("n") % 10
    d = wins(spark, sf_dir).select(*W.PROFILE, F.concat_ws("|", "user_id", day.cast("string")).alias("training_run_id"), F.day("window_start").alias("n")).distinct()
    runs = d.select(
        "training_run_id", F.when(n == 1, "success").otherwise("running").alias("status"), F.concat(F.lit("d-"), "user_id").alias("dataset_id"), F.lit("h").alias("dataset_hash"), "dataset_kind", ids.profile_key().alias("profile_key"), F.lit("s").alias("split_id"), "n",
    )
    each = d.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b"))))
    model = F.concat_ws("|", "training_run_id", "part")
    b = F.col("part") == "b"
    models = each.where((n != 2) | ~b).select(
        model.alias("model_id"), "training_run_id", F.concat(F.when(b & (n == 4), "x-").otherwise("d-"), "user_id").alias("dataset_id"), F.when(b & (n == 5), "other").otherwise("h").alias("dataset_hash"), "dataset_kind",
        F.when(b & (n == 6), "0").otherwise(ids.profile_key()).alias("profile_key"), F.when(b & (n == 7), "other").otherwise("s").alias("split_id"), F.when(b & (n == 3), F.lit("2024-01-01").cast("timestamp")).alias("verified_at"),
    )
    claims = each.where(n != 0).select("training_run_id", model.alias("model_id"))
    return runs, claims, models


@query(f"{RUNS} SELECT run AS training_run_id, CASE WHEN n % 10 = 1 OR reason IS NULL THEN 'success' ELSE 'failed' END AS status, reason FROM v")
def m31_run_outcomes(spark, sf_dir):
    return R.finalise_runs(*_runs(spark, sf_dir))[0].select("training_run_id", "status", "reason")


@query(f"{RUNS} SELECT run AS training_run_id, dataset_kind, reason FROM v WHERE NOT (n % 10 = 1 OR reason IS NULL) AND dataset_kind = 'real'")
def w6_failed_runs_listed(spark, sf_dir):
    """The failed training runs of real profiles with their reasons."""
    rows = R.finalise_runs(*_runs(spark, sf_dir))[0].select("training_run_id", "dataset_kind", "status", "reason")
    return M.listed(rows, "training_run_id", "reason", dataset_kind="real", status="failed").drop("status")


@query(f"{RUNS} SELECT run || '|' || unnest(['a', 'b']) AS model_id, reason IS NULL AS finalised FROM v WHERE reason IS NULL OR n % 10 = 1")
def m31_models_kept(spark, sf_dir):
    """The models that their runs' outcomes left, and whether they are final."""
    return R.finalise_runs(*_runs(spark, sf_dir))[1].select("model_id", "finalised")
