"""Detection: rules and model signals per window, fused into one decision each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.functions.ids import fingerprint
from loomwatch.operators.windows import KEYS

# Default policy parameters, bounds of scores and of risk.
DEFAULT_POLICY = {
    "rare-process-v1": {"enabled": True, "new_process_min": 1.0, "process_min": 1.0, "activity_min": 0.0, "base": 60.0},
    "new-remote-spike-v1": {"enabled": True, "new_remote_min": 3.0, "network_min": 10.0, "activity_min": 0.0, "base": 66.0},
    "unusual-hour-activity-v1": {"enabled": True, "start_hour": 22.0, "end_hour": 5.0, "activity_min": 12.0, "event_min": 1.0, "base": 58.0},
    "resource-pressure-v1": {"enabled": True, "avg_cpu_min": 70.0, "max_cpu_min": 90.0, "avg_ram_min": 85.0, "max_ram_min": 90.0, "base": 64.0},
    "authentication-failure-burst-v1": {"enabled": True, "failure_min": 5.0, "success_max": 100000.0, "activity_min": 0.0, "base": 70.0},
}
RISK_LEVELS = (("critical", 90), ("high", 75), ("medium", 55), ("low", 35))
FINDING_THRESHOLD = 55
QUALITY_GATE = ("good", "degraded")
MODES = ("hybrid", "rules_only", "model_only")


def scaled_policy() -> dict:
    """The defaults with thresholds for sparse data."""
    policy = {rule: dict(params) for rule, params in DEFAULT_POLICY.items()}
    policy["new-remote-spike-v1"] |= {"new_remote_min": 2.0, "network_min": 2.0}
    policy["authentication-failure-burst-v1"] |= {"failure_min": 3.0}
    policy["unusual-hour-activity-v1"] |= {"activity_min": 0.05}
    return policy


def policy_table(spark, policy: dict, policy_id: str = "default") -> DataFrame:
    """(policy_id, rule_id, param, value), a row a parameter."""
    rows = [(policy_id, rule, param, float(value)) for rule, params in policy.items() for param, value in params.items()]
    return spark.createDataFrame(rows, "policy_id string, rule_id string, param string, value double")


# The least and greatest value of each rule's parameters, and those that are whole numbers.
BOUNDS = {
    "rare-process-v1": {"new_process_min": (1, 10_000), "process_min": (1, 100_000), "activity_min": (0, 100_000), "base": (1, 100), "enabled": (0, 1)},
    "new-remote-spike-v1": {"new_remote_min": (1, 100_000), "network_min": (1, 1_000_000), "activity_min": (0, 100_000), "base": (1, 100), "enabled": (0, 1)},
    "unusual-hour-activity-v1": {"start_hour": (0, 23), "end_hour": (0, 23), "activity_min": (0, 100_000), "event_min": (0, 1_000_000), "base": (1, 100), "enabled": (0, 1)},
    "resource-pressure-v1": {"avg_cpu_min": (0, 100), "max_cpu_min": (0, 100), "avg_ram_min": (0, 100), "max_ram_min": (0, 100), "base": (1, 100), "enabled": (0, 1)},
    "authentication-failure-burst-v1": {"failure_min": (1, 100_000), "success_max": (0, 100_000), "activity_min": (0, 100_000), "base": (1, 100), "enabled": (0, 1)},
}
WHOLE = ("new_process_min", "process_min", "new_remote_min", "network_min", "start_hour", "end_hour", "failure_min", "success_max", "base", "enabled")
QUALITIES = ("good", "degraded", "insufficient")
FUSION = "hybrid-fusion-v1"


def policy_violations(policies: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(policy_id, rule_id, param, reason) of what is wrong in policies; no row for a sound one.

    ``policies`` has a parameter a row; a rule that has any must have all of its own. ``heads`` has a
    policy a row: mode, fusion_method, finding_threshold, low, medium, high, critical and quality_gate.
    """
    spark = policies.sparkSession
    rows = [(r, p, float(lo), float(hi), p in WHOLE) for r, params in BOUNDS.items() for p, (lo, hi) in params.items()]
    known = F.broadcast(spark.createDataFrame(rows, "rule_id string, param string, lo double, hi double, whole boolean"))  # the parameters of five rules
    joined = policies.join(known, ["rule_id", "param"], "left")
    v = F.col("value")
    reason = (
        F.when(F.col("lo").isNull(), "unknown rule or parameter")
        .when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "config values must be finite")
        .when(~v.between(F.col("lo"), F.col("hi")), "out of bounds")
        .when(F.col("whole") & (v != F.floor(v)), "not a whole number")
    )
    odd = joined.select("policy_id", "rule_id", "param", reason.alias("reason")).where("reason is not null")
    twice = policies.groupBy("policy_id", "rule_id", "param").agg(F.count("*").alias("n")).where("n > 1").select("policy_id", "rule_id", "param", F.lit("given twice").alias("reason"))
    wanted = policies.select("policy_id", "rule_id").distinct().join(known.where("param <> 'enabled'").select("rule_id", "param"), "rule_id")
    missing = wanted.join(policies, ["policy_id", "rule_id", "param"], "left_anti").select("policy_id", "rule_id", "param", F.lit("missing").alias("reason"))
    found = odd.unionByName(twice).unionByName(missing)
    if heads is None:
        return found

    def wrong(c: Column) -> Column:
        return F.coalesce(c, F.lit(True))

    levels = ["low", "medium", "high", "critical"]
    disordered = wrong(F.col("low") >= F.col("medium")) | wrong(F.col("medium") >= F.col("high")) | wrong(F.col("high") >= F.col("critical"))
    outside = wrong(~F.col("finding_threshold").between(0, 100))
    for level in levels:
        outside = outside | wrong(~F.col(level).between(0, 100))
    checks = {
        ("mode", "unknown detection mode"): wrong(~F.col("mode").isin(*MODES)), ("fusion_method", "unknown detection fusion method"): wrong(F.col("fusion_method") != FUSION),
        ("thresholds", "out of bounds"): outside, ("thresholds", "risk thresholds must satisfy low < medium < high < critical"): disordered,
        ("quality_gate", "quality_gate must not be empty"): wrong(F.size("quality_gate") <= 0), ("quality_gate", "quality_gate contains unknown quality status"): F.size(F.array_except("quality_gate", F.array(*map(F.lit, QUALITIES)))) > 0,
    }
    said = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("param"), F.lit(r).alias("reason"))) for (p, r), c in checks.items()]))
    of_heads = heads.select("policy_id", F.explode(said).alias("s")).select("policy_id", F.lit(None).cast("string").alias("rule_id"), "s.param", "s.reason")
    return found.unionByName(of_heads)


def tampered_policies(policies: DataFrame, registered: DataFrame) -> DataFrame:
    """(policy_id, reason) of registered policies (policy_id, policy_hash) whose parameters give another hash now, or are gone."""
    now = policy_hash(policies).select("policy_id", F.col("policy_hash").alias("_now"))
    joined = registered.join(now, "policy_id", "left")
    reason = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("policy_hash"), "policy hash mismatch")
    return joined.select("policy_id", reason.alias("reason")).where("reason is not null")


def policy_hash(policies: DataFrame) -> DataFrame:
    """(policy_id, policy_hash): a digest of all parameters in order; a changed value changes it."""
    text = F.concat_ws("=", F.concat_ws(".", "rule_id", "param"), F.round("value", 6).cast("decimal(20,6)").cast("string"))
    return policies.groupBy("policy_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";"), 256).alias("policy_hash"))


def _evidence(*rows: tuple[str, float | None, str]) -> Column:
    """Observed values against thresholds (none for the parts of a sum), with what each says."""
    return F.array(*[
        F.struct(
            F.col(f).cast("double").alias("observed"), F.lit(None if t is None else float(t)).cast("double").alias("threshold"),
            F.lit(f).alias("feature"), F.lit("above").alias("direction"), F.lit(text).alias("text"),
        )
        for f, t, text in rows
    ])


def _density(params: dict) -> tuple[str, float, str]:
    return "activity_density", params["activity_min"], "Activity density gate."


def rule_signals(policy: dict) -> list[Column]:
    """A struct (signal_id, matched, strength, evidence) for each rule of the policy."""
    f = F.col
    signals = []

    def add(rule: str, matched: Column, strength: Column, evidence: Column) -> None:
        matched = matched & F.lit(bool(policy[rule]["enabled"]))
        whole = F.least(F.lit(100), strength.cast("int"))
        signals.append(F.struct(F.lit(rule).alias("signal_id"), matched.alias("matched"), F.when(matched, whole).otherwise(0).alias("strength"), evidence.alias("evidence")))

    if p := policy.get("rare-process-v1"):
        add(
            "rare-process-v1",
            (f("new_process_count") >= p["new_process_min"]) & (f("process_count") >= p["process_min"]) & (f("activity_density") >= p["activity_min"]),
            p["base"] + F.greatest(F.lit(0.0), f("new_process_count") - 1) * 5,
            _evidence(("new_process_count", p["new_process_min"], "New process count."), ("process_count", p["process_min"], "Process activity gate."), _density(p)),
        )
    if p := policy.get("new-remote-spike-v1"):
        add(
            "new-remote-spike-v1",
            (f("new_remote_count") >= p["new_remote_min"]) & (f("network_connection_count") >= p["network_min"]) & (f("activity_density") >= p["activity_min"]),
            p["base"] + F.greatest(F.lit(0.0), f("new_remote_count") - p["new_remote_min"]) * 2,
            _evidence(("new_remote_count", p["new_remote_min"], "New remote count."), ("network_connection_count", p["network_min"], "Network activity gate."), _density(p)),
        )
    if p := policy.get("unusual-hour-activity-v1"):
        add(
            "unusual-hour-activity-v1",
            ((f("hour_of_day") >= p["start_hour"]) | (f("hour_of_day") <= p["end_hour"]))
            & (f("activity_density") >= p["activity_min"])
            & (f("process_count") + f("network_connection_count") >= p["event_min"]),
            p["base"] + F.greatest(F.lit(0.0), f("activity_density") - p["activity_min"]),
            _evidence(
                ("hour_of_day", p["start_hour"], "Unusual hour gate."), _density(p),
                ("process_count", None, "Process side of process/network gate."), ("network_connection_count", None, "Network side of process/network gate."),
            ),
        )
    if p := policy.get("resource-pressure-v1"):
        names = ("avg_cpu", "max_cpu", "avg_ram", "max_ram")
        limits = {f"{n}_percent": p[f"{n}_min"] for n in names}
        over = F.lit(False)
        for name, limit in limits.items():
            over = over | (f(name) >= limit)
        add(
            "resource-pressure-v1",
            over,
            p["base"] + F.greatest(F.lit(0.0), F.greatest("max_cpu_percent", "max_ram_percent") - min(limits.values())),
            _evidence(*[(name, limit, f"{'Average' if name[:3] == 'avg' else 'Maximum'} {name[4:7].upper()} gate.") for name, limit in limits.items()]),
        )
    if p := policy.get("authentication-failure-burst-v1"):
        add(
            "authentication-failure-burst-v1",
            (f("auth_failure_count") >= p["failure_min"]) & (f("auth_success_count") <= p["success_max"]) & (f("activity_density") >= p["activity_min"]),
            p["base"] + F.greatest(F.lit(0.0), f("auth_failure_count") - p["failure_min"]) * 3,
            _evidence(("auth_failure_count", p["failure_min"], "Authentication failure count."), ("auth_success_count", p["success_max"], "Authentication success gate."), _density(p)),
        )
    return signals


def model_signal(score: Column, threshold: Column, model: Column) -> Column:
    """Matched strictly over the threshold; strength by the margin, halves to even; null without a model."""
    margin = score - threshold
    scale = F.when(threshold <= 0, F.greatest(F.abs(score), F.lit(1e-9))).otherwise(F.greatest(F.abs(threshold), F.lit(1e-9)))
    strength = F.greatest(F.lit(1), F.least(F.lit(100), F.bround(50 + 50 * F.least(F.lit(1.0), margin / scale)).cast("int")))
    matched = score > threshold
    none = F.array().cast("array<struct<observed:double,threshold:double,feature:string,direction:string,text:string>>")
    signal = F.struct(F.concat(F.lit("model-"), model).alias("signal_id"), matched.alias("matched"), F.when(matched, strength).otherwise(0).alias("strength"), none.alias("evidence"))
    return F.when(model.isNotNull() & score.isNotNull(), signal)


def with_signals(windows: DataFrame, policy: dict, model: Column | None = None) -> DataFrame:
    """``windows`` with signals, one per rule, and the model's where there is one."""
    signals = F.array(*rule_signals(policy), *([model] if model is not None else []))
    return windows.withColumn("signals", F.array_compact(signals))


def signal_rows(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The long form, one row per window and signal."""
    return scored.select(*keys, F.explode("signals").alias("s")).select(*keys, "s.signal_id", "s.matched", "s.strength")


def evidence_rows(scored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per window, matched signal and piece of evidence."""
    s = scored.select(*keys, F.explode("signals").alias("s")).where("s.matched")
    return s.select(*keys, "s.signal_id", F.explode("s.evidence").alias("e")).select(*keys, "signal_id", "e.feature", "e.observed", "e.threshold", "e.direction", "e.text")


def fuse(scored: DataFrame, gate: tuple[str, ...] = QUALITY_GATE, finding_threshold: int = FINDING_THRESHOLD) -> DataFrame:
    """One decision a window, inside the row (no shuffle).

    The strongest matched signal leads (ties to the smaller id); a quarter of each other's strength
    (halves to even) and four points a corroborating signal (twelve at most) are added, to 100.
    """
    ranked = F.array_sort(
        F.filter("signals", lambda s: s["matched"]),
        lambda a, b: F.when(a["strength"] != b["strength"], b["strength"] - a["strength"]).when(a["signal_id"] < b["signal_id"], -1).when(a["signal_id"] > b["signal_id"], 1).otherwise(0),
    )
    df = scored.withColumn("matched_signals", ranked)
    n = F.size("matched_signals")
    primary = F.try_element_at("matched_signals", F.lit(1))
    others = F.aggregate(F.slice("matched_signals", 2, 100), F.lit(0), lambda acc, s: acc + F.bround(s["strength"] * F.lit(0.25)).cast("int"))
    df = df.withColumn("n_matched", n).withColumn("primary_signal", primary["signal_id"])
    total = F.when(n == 0, 0).otherwise(F.least(F.lit(100), primary["strength"] + others + F.least(F.lit(12), 4 * (n - 1))))
    df = df.withColumn("detection_score", total.cast("int")).withColumn("risk_level", risk(F.col("detection_score")))
    skipped = ~F.col("quality_status").isin(*gate) if "quality_status" in scored.columns else F.lit(False)
    df = df.withColumn("skip_reason", F.when(skipped, F.concat(F.lit("quality is "), F.col("quality_status") if "quality_status" in scored.columns else F.lit(""))))
    status = F.when(skipped, "skipped").when(F.col("detection_score") >= finding_threshold, "finding").otherwise("no_finding")
    text = F.format_string("%s leads; %d corroborating signal(s); score %d", "primary_signal", F.greatest(F.lit(0), n - 1), "detection_score")
    return df.withColumn("status", status).withColumn("explanation", F.when(n > 0, text))


def risk(score: Column) -> Column:
    """The level of a score."""
    chain = None
    for level, least in RISK_LEVELS:
        chain = F.when(score >= least, level) if chain is None else chain.when(score >= least, level)
    return chain.otherwise("none")


def with_fingerprint(decided: DataFrame, policy_hash: str | Column, model: Column | None = None) -> DataFrame:
    """What makes two findings the same: profile, leading signal, matched rules (no model signal), policy and model."""
    own = F.filter("matched_signals", lambda s: ~F.startswith(s["signal_id"], F.lit("model-")))
    rules = F.array_join(F.array_sort(F.transform(own, lambda s: s["signal_id"])), ",")
    policy = F.lit(policy_hash) if isinstance(policy_hash, str) else policy_hash
    return decided.withColumn("fingerprint", fingerprint("dataset_kind", "user_id", "host_id", F.coalesce("primary_signal", F.lit("")), rules, policy, model if model is not None else F.lit("rules")))


def pending(windows: DataFrame, evaluations: DataFrame, keys: tuple[str, ...] = ("window_id", "feature_input_hash", "policy_hash", "model_id")) -> DataFrame:
    """Windows that have no evaluation under the same input, policy and model (nulls equal nulls)."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & windows[k].eqNullSafe(evaluations[k])
    return windows.join(evaluations, condition, "left_anti")


def route(windows: DataFrame, champions: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Windows with their own profile's champion and the path they take."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    joined = windows.join(champions, ["dataset_kind", "user_id", "host_id"], "left")
    has = F.col("model_id").isNotNull()
    path = {
        "hybrid": F.when(has, "rules+model").otherwise("rules_only"),
        "rules_only": F.lit("rules_only"),
        "model_only": F.when(has, "model_only").otherwise("blocked"),
    }[mode]
    return joined.withColumn("path", path)


def activation_log(log: DataFrame) -> DataFrame:
    """Each activation with the policy it replaced, and the one now active."""
    order = Window.partitionBy("scope").orderBy("at", "policy_id")
    last = Window.partitionBy("scope").orderBy(F.desc("at"), F.desc("policy_id"))
    return log.select("scope", "policy_id", "at", F.lag("policy_id").over(order).alias("previous"), (F.row_number().over(last) == 1).alias("active"))


def dry_run(decided: DataFrame, samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts by risk and outcome, the first ``samples`` decisions by score); nothing is written."""
    counts = decided.groupBy("risk_level", "status").agg(F.count("*").alias("windows"))
    best = decided.orderBy(F.desc("detection_score"), *KEYS).limit(samples)
    return counts, best.select(*KEYS, "detection_score", "risk_level", "primary_signal")


def run_counters(decided: DataFrame) -> DataFrame:
    """Examined, evaluated, skipped, findings and suppressed per profile."""
    return decided.groupBy("dataset_kind", "user_id", "host_id").agg(
        F.count("*").alias("examined"),
        F.count_if(F.col("status") != "skipped").alias("evaluated"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "finding").alias("findings"),
        F.count_if(F.col("status") == "suppressed").alias("suppressed"),
        F.max("detection_score").alias("max_score"),
    )


def finding_counters(occurrences: DataFrame) -> DataFrame:
    """New findings, occurrences, and occurrences that went to a finding already there, per profile."""
    new = F.count_distinct("fingerprint", "finding_no")
    return occurrences.groupBy("dataset_kind", "user_id", "host_id").agg(new.alias("new_findings"), (F.count("*") - new).alias("updated_findings"), F.count("*").alias("occurrences"))


# Run statuses from best to worst.
STATUS_ORDER = ("completed", "partial", "failed")


def run_rollup(runs: DataFrame) -> DataFrame:
    """Child runs summed per parent; the worst status wins."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("run_status"))
    return runs.groupBy("parent").agg(
        F.sum("examined").alias("examined"), F.sum("findings").alias("findings"), F.count("*").alias("children"),
        F.element_at(F.array(*map(F.lit, STATUS_ORDER)), F.max(rank).cast("int")).alias("run_status"),
    )
