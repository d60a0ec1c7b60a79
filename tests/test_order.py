"""What depends on order, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomwatch.operators import findings as G, model_registry as R, windows as W

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


# --- findings that go on

OCCURRENCE = "dataset_kind string, user_id string, host_id string, fingerprint string, window_start timestamp, detection_score int, risk_level string, primary_signal string"
STORED = "finding_id string, fingerprint string, dataset_kind string, user_id string, host_id string, status string, first_seen timestamp, last_seen timestamp, occurrences long, max_score int, risk_level string, primary_signal string, related_previous string"


def one_by_one(stored, new):
    """(fingerprint, minute) to finding, taking the occurrences in order."""
    held = [dict(s) for s in stored if s["status"] not in G.ENDED]
    out = {}
    for f, t in sorted(new, key=lambda x: x[1]):
        near = [h for h in held if h["fp"] == f and h["first"] <= t + 60 and h["last"] >= t - 60]
        if near:
            hit = max(near, key=lambda h: (h["last"], h.get("grown", False), h["id"]))
            hit["grown"] = hit.get("grown", False) or t > hit["last"]
        else:
            hit = {"fp": f, "id": f"f-{f}-{int(at(t).timestamp() * 1e6)}", "first": t, "last": t}
            held.append(hit)
        hit["first"], hit["last"] = min(hit["first"], t), max(hit["last"], t)
        out[f, t] = hit["id"]
    return out


def attached(spark, stored, new):
    s = [(x["id"], x["fp"], "real", "u", "h", x["status"], at(x["first"]), at(x["last"]), 1, 60, "medium", "a", None) for x in stored]
    o = [("real", "u", "h", f, at(t), 60, "medium", "a") for f, t in new]
    return G.attach(spark.createDataFrame(o, OCCURRENCE), spark.createDataFrame(s, STORED))


def minute(t):
    return round((t.replace(tzinfo=None) - START.replace(tzinfo=None)).total_seconds() / 60)


def test_an_occurrence_extends_the_finding_that_the_next_one_meets(spark):
    stored = [{"id": "s1", "fp": "x", "first": 600, "last": 600, "status": "open"}]
    rows = attached(spark, stored, [("x", 650), ("x", 700), ("x", 761)]).collect()
    assert {minute(r.window_start): r.finding_id for r in rows if not r.is_new} == {650: "s1", 700: "s1"}
    assert [minute(r.window_start) for r in rows if r.is_new] == [761]


def test_attaching_equals_taking_one_by_one(spark):
    random.seed(5)
    stored, new = [], []
    for n in range(80):
        t = 0
        for i in range(random.randint(0, 6)):
            t += random.choice([15, 30, 45, 60, 75, 90, 200])
            end = t + random.choice([0, 15, 60, 120])
            stored.append({"id": f"s{n}-{i}", "fp": f"p{n}", "first": t, "last": end, "status": random.choice(["open", "investigating", "suppressed", "resolved"])})
            t = random.choice([end, t]) + 1  # some overlap; no two are seen last at the same time
        new += [(f"p{n}", m) for m in sorted(random.sample(range(0, 1000, 15), random.randint(1, 30)))]
    got = {(r.fingerprint, minute(r.window_start)): r.finding_id for r in attached(spark, stored, new).collect()}
    assert got == one_by_one(stored, new)


def test_merged_findings_grow_and_point_at_the_last_closed_one(spark):
    s = [("s1", "x", "real", "u", "h", "open", at(0), at(60), 2, 60, "medium", "a", None), ("s2", "x", "real", "u", "h", "resolved", at(5000), at(5000), 1, 60, "medium", "a", None), ("s3", "y", "real", "u", "h", "open", at(0), at(0), 1, 90, "critical", "a", None)]
    stored = spark.createDataFrame(s, STORED)
    o = [("real", "u", "h", "x", at(120), 80, "high", "b"), ("real", "u", "h", "x", at(1000), 60, "medium", "b"), ("real", "u", "h", "y", at(-30), 60, "medium", "b")]
    rows = {r.finding_id: r for r in G.merge_findings(stored, G.attach(spark.createDataFrame(o, OCCURRENCE), stored)).collect()}
    assert len(rows) == 4
    assert (rows["s1"].occurrences, rows["s1"].max_score, rows["s1"].risk_level, minute(rows["s1"].last_seen)) == (3, 80, "high", 120)
    assert (rows["s3"].max_score, rows["s3"].risk_level, minute(rows["s3"].first_seen)) == (90, "critical", -30)
    (fresh,) = [r for i, r in rows.items() if i.startswith("f-")]
    assert (fresh.status, fresh.related_previous, fresh.occurrences) == ("open", "s2", 1)  # whatever its time
    assert G.merge_findings(stored, G.attach(spark.createDataFrame([], OCCURRENCE), stored)).count() == 3


def test_a_finding_that_has_ended_is_left_no_more(spark):
    log = [("f", 1, at(1), "acknowledged", False), ("f", 2, at(2), "open", False), ("f", 3, at(3), "resolved", False), ("f", 4, at(4), "resolved", True), ("f", 5, at(5), "open", True), ("g", 6, at(0), "open", True)]
    rows = G.finding_moves(spark.createDataFrame(log, "finding_id string, request_id long, at timestamp, to_status string, confirm boolean")).collect()
    assert {r.request_id: (r.from_status, r.refused) for r in rows} == {
        1: ("open", None), 2: ("acknowledged", "no such move"), 3: ("acknowledged", "needs confirmation"), 4: ("acknowledged", None), 5: ("resolved", "no such move"), 6: ("open", "no such move"),
    }


def test_the_first_of_equal_requests_is_in_force_until_it_ends(spark):
    shape = "request_id long, at timestamp, scope string, dataset_kind string, user_id string, host_id string, signal_id string, fingerprint string, ttl_minutes int"
    base = ("signal_for_dataset_kind", "real", None, None, "a", None)
    rows = [(1, at(0), *base, 60), (2, at(59), *base, 600), (3, at(60), *base, 30), (4, at(61), *base[:4], "b", None, 5), (5, at(62), *base, 0), (6, at(90), *base, 1)]
    held = spark.createDataFrame([(*base, True, at(30))], "scope string, dataset_kind string, user_id string, host_id string, signal_id string, fingerprint string, active boolean, expires_at timestamp")
    requests = spark.createDataFrame(rows, shape)
    refused = {r.request_id: r.refused for r in G.admit_requests(requests, held.where("false"), ["a", "b"]).collect()}
    assert refused == {1: None, 2: "an equal one is in force", 3: None, 4: None, 5: "duration out of bounds", 6: None}
    refused = {r.request_id: r.refused for r in G.admit_requests(requests, held, ["a"]).collect()}
    assert refused[1] == "an equal one is in force" and refused[2] is None and refused[4] == "unknown signal"


def test_a_group_stays_whole_where_its_join_turns_into_a_broadcast(spark):
    """As on tables too large to be broadcast by their estimate: the join on the key is planned as a shuffle, which adaptive execution then reads piecewise."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    one = (F.lit("signal_for_dataset_kind").alias("scope"), F.lit("real").alias("dataset_kind"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("host_id"))
    kinds = (F.when(F.col("id") < 0, "b").otherwise("a").alias("signal_id"), F.lit(None).cast("string").alias("fingerprint"))
    minutes = F.timestamp_seconds(1_700_000_000 + 60 * F.col("id"))
    requests = spark.range(0, 400, 1, 8).select(F.col("id").alias("request_id"), minutes.alias("at"), *one, *kinds, F.lit(50).alias("ttl_minutes"))
    held = spark.range(0, 40, 1, 4).select(*one, *kinds, F.lit(True).alias("active"), minutes.alias("expires_at"))  # until minute 39
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        accepted = sorted(r.request_id for r in G.admit_requests(requests, held, ["a"]).where("refused is null").collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert accepted == list(range(39, 400, 50))


# --- models

LOG = "dataset_kind string, user_id string, host_id string, request_id long, at timestamp, model_id string, action string, confirm boolean"


def moved(spark, *requests, **flags):
    models = spark.createDataFrame([("real", "u", "h", m, flags.get("verified", True), flags.get("evaluated", True)) for m in ("m1", "m2")], "dataset_kind string, user_id string, host_id string, model_id string, verified boolean, evaluated boolean")
    log = spark.createDataFrame([("real", "u", "h", i, at(i), m, a, True) for i, (a, m) in enumerate(requests)], LOG)
    moves = R.registry_moves(log, models)
    return moves.orderBy("request_id").collect(), R.champions(moves).collect(), {r.model_id: r.lifecycle_status for r in R.lifecycle(models, moves).collect()}


def test_a_rollback_brings_a_retired_model_back(spark):
    moves, champions, status = moved(spark, ("promote", "m1"), ("promote", "m2"), ("retire", "m2"), ("rollback", "m1"))
    assert [m.refused for m in moves] == [None] * 4 and [m.previous for m in moves] == [None, "m1", "m2", None]
    assert [c.model_id for c in champions] == ["m1"] and status == {"m1": "champion", "m2": "retired"}


def test_moves_that_the_state_forbids(spark):
    moves, champions, status = moved(
        spark, ("retire", "m1"), ("rollback", "m1"), ("recommend", "m1"), ("recommend", "m1"), ("promote", "m1"), ("promote", "m1"), ("retire", "m1"), ("promote", "m1"), ("promote", "m9"), ("dance", "m1"), ("recommend", "m2")
    )
    assert [m.refused for m in moves] == [
        "only champion models can be retired", "rollback is allowed only for retired models", None, "only candidate models can be recommended", None, "model is already champion", None,
        "retired model cannot be promoted", "model is not registered", "unknown action", None,
    ]
    assert champions == [] and status == {"m1": "retired", "m2": "recommended"}
    assert [m.refused for m in moved(spark, ("promote", "m1"), evaluated=False)[0]] == ["model evaluation is required before promotion"]
    assert [m.refused for m in moved(spark, ("recommend", "m1"), verified=False)[0]] == ["model is not verified"]


def test_each_fault_in_a_models_parameters_is_told(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, f, 1.0, 1.0, 1.0, 1.0) for i, f in enumerate(W.FEATURES)]
    sets = {
        "sound": base, "short": base[:11], "swapped": [(1, base[0][1], *base[0][2:]), (0, base[1][1], *base[1][2:]), *base[2:]], "flat": [(*base[0][:3], 0.0, 1.0, 1.0), *base[1:]], "odd": [(*base[0][:4], nan, 1.0), *base[1:]],
        "narrow": base, "endless": base, "crossed": base, "miscounted": base,
    }
    pre = [(m, *r) for m, rows in sets.items() for r in rows]
    p = spark.createDataFrame(pre, "model_id string, position int, feature string, mean double, std double, median double, iqr double")
    fields = "model_id string, input_width int, threshold double, " + ", ".join(f"{part}_{x} {t}" for part in ("train", "calibration", "test") for x, t in (("start", "timestamp"), ("end", "timestamp"), ("count", "long"), ("rows", "long")))

    def model(name):
        ranges = [(at(0), at(5), 3, 3), (at(6), at(8), 2, 2), (at(9), at(9), 1, 1)]
        if name == "crossed":
            ranges[1] = (at(4), at(8), 2, 2)
        if name == "miscounted":
            ranges[2] = (at(9), at(9), 1, 2)
        return (name, 11 if name == "narrow" else 12, inf if name == "endless" else 0.5, *ranges[0], *ranges[1], *ranges[2])

    found = {}
    for r in R.parameter_violations(p, spark.createDataFrame([model(m) for m in [*sets, "bare"]], fields)).collect():
        found.setdefault(r.model_id, set()).add(r.check)
    assert found == {
        "short": {"feature names or order", "twelve values"}, "swapped": {"feature names or order"}, "flat": {"spread above zero"}, "odd": {"finite values"}, "narrow": {"input width"}, "endless": {"finite threshold"},
        "crossed": {"split ranges in order"}, "miscounted": {"split counts"}, "bare": {"feature names or order", "twelve values", "finite values", "spread above zero"},
    }


def test_one_odd_candidate_fails_its_run(spark):
    fields = "training_run_id string, status string, dataset_id string, dataset_hash string, dataset_kind string, profile_key string, split_id string"
    runs = spark.createDataFrame([(r, "running", "d", "h", "real", "p", "s") for r in ("r1", "r2", "r3")], fields)
    shape = "model_id string, training_run_id string, dataset_id string, dataset_hash string, dataset_kind string, profile_key string, split_id string, verified_at timestamp"
    models = spark.createDataFrame([("a", "r1", "d", "h", "real", "p", "s", None), ("b", "r1", "d", "h", "real", "p", "other", None), ("c", "r2", "d", "h", "real", "p", "s", None), ("e", "r2", "d", "h", "real", "p", "s", None)], shape)
    claims = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r2", "c")], "training_run_id string, model_id string")
    outcome, kept = R.finalise_runs(runs, claims, models)
    assert {r.training_run_id: (r.status, r.reason) for r in outcome.collect()} == {
        "r1": ("failed", "candidate split does not match training run"), "r2": ("success", None), "r3": ("failed", "training run finalization requires at least one model"),
    }
    assert {r.model_id: r.finalised for r in kept.collect()} == {"c": True, "e": False}


@pytest.mark.parametrize(("verified", "split", "places"), [(True, "s", {"m1": 2, "m2": 1}), (True, "other", {}), (False, "s", {})])
def test_models_are_ordered_only_if_all_compare(spark, verified, split, places):
    rows = [("synthetic", "m1", 0.5, 0.1, None, verified, "s", None), ("synthetic", "m2", 0.5, 0.1, 0.2, True, split, None)]
    models = spark.createDataFrame(rows, "dataset_kind string, model_id string, scenario_recall double, fpr double, pr_auc double, verified boolean, split_id string, inference_seconds double")
    failed, order = R.comparison(models.withColumn("g", F.lit(1)), ["g"], ["split_id"])
    assert failed.count() == (split != "s") and {r.model_id: r.place for r in order.collect()} == places
