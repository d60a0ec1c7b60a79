"""Findings: suppression, correlation over time, and the lifecycle of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomwatch.operators.folds import in_order
from loomwatch.operators.windows import KEYS

# Allowed moves of a finding, and the states that end it.
MOVES = {
    "open": ("acknowledged", "investigating", "suppressed", "resolved", "false_positive"),
    "acknowledged": ("investigating", "suppressed", "resolved", "false_positive"),
    "investigating": ("acknowledged", "suppressed", "resolved", "false_positive"),
    "suppressed": ("open", "resolved", "false_positive"),
}
ENDED = ("resolved", "false_positive")
SCOPES = ("signal_for_profile", "signal_for_dataset_kind", "finding_fingerprint")
CORRELATION_MINUTES = 60
MAX_TTL_MINUTES = 525_600
#: Up to so many suppressions in force are broadcast, so that a kind with most of the windows is not dealt by its key.
BROADCAST_SUPPRESSIONS = 10_000


def effective(suppressions: DataFrame, now: str) -> DataFrame:
    """Suppressions in force at ``now``."""
    return suppressions.where(F.col("active") & (F.col("expires_at") > F.lit(now).cast("timestamp")))


def revoke(suppressions: DataFrame, revocations: DataFrame) -> DataFrame:
    """``suppressions`` with those in ``revocations`` (suppression_id) no longer active."""
    gone = revocations.select("suppression_id", F.lit(True).alias("_gone")).distinct()
    return suppressions.join(gone, "suppression_id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def check_requests(requests: DataFrame, existing: DataFrame, signals: list[str], now: str) -> DataFrame:
    """Each suppression request with the reason it is refused for, or null.

    A scope needs its fields, lasts 1 to 525600 minutes, names a known signal, and must not equal
    one in force.
    """
    same = F.lit(True)
    fields = ("scope", "dataset_kind", "user_id", "host_id", "signal_id", "fingerprint")
    in_force = effective(existing, now).select(*[F.col(f).alias(f"e_{f}") for f in fields]).distinct()
    for f in fields:
        same = same & requests[f].eqNullSafe(in_force[f"e_{f}"])
    twins = requests.join(in_force, same, "left_semi").select("request_id").withColumn("_twin", F.lit(True))
    has = {f: F.col(f).isNotNull() for f in fields}
    complete = (
        F.when(F.col("scope") == SCOPES[0], has["dataset_kind"] & has["user_id"] & has["host_id"] & has["signal_id"])
        .when(F.col("scope") == SCOPES[1], has["dataset_kind"] & has["signal_id"] & ~has["user_id"] & ~has["host_id"])
        .when(F.col("scope") == SCOPES[2], has["fingerprint"])
        .otherwise(False)
    )
    reason = (
        F.when(~F.col("scope").isin(*SCOPES), "unknown scope")
        .when(~complete, "fields do not fit the scope")
        .when(~F.col("ttl_minutes").between(1, MAX_TTL_MINUTES), "duration out of bounds")
        .when(F.col("signal_id").isNotNull() & ~F.col("signal_id").isin(*signals), "unknown signal")
        .when(F.col("_twin"), "an equal one is in force")
    )
    return requests.join(twins, "request_id", "left").withColumn("refused", reason).drop("_twin")


def suppress(decided: DataFrame, suppressions: DataFrame, now: str) -> DataFrame:
    """``decided`` with suppressed_by, and status suppressed where a suppression in force fits.

    One matched signal that is suppressed suppresses the whole window. The first suppression made
    that fits a signal wins, for its profile or its kind alike; fingerprints (of would-be findings)
    come after those. Each scope is an equi-join. A window without matched signal is never suppressed.
    """
    live = effective(suppressions, now)
    few = live.limit(BROADCAST_SUPPRESSIONS + 1).count() <= BROADCAST_SUPPRESSIONS
    matched = decided.where("n_matched > 0").select(*KEYS, "fingerprint", "status", F.explode("matched_signals.signal_id").alias("signal_id"))

    def scope(rank: int) -> DataFrame:
        rows = live.where(F.col("scope") == SCOPES[rank])
        rows = F.broadcast(rows) if few else rows
        return rows.withColumn("o", F.struct(F.lit(rank // 2).alias("r"), F.col("created_at").alias("c"), F.col("suppression_id").alias("id")))

    p = scope(0).select("dataset_kind", "user_id", "host_id", "signal_id", "o")
    k = scope(1).select("dataset_kind", "signal_id", "o")
    f = scope(2).select("fingerprint", "o")
    hits = (
        matched.join(p, ["dataset_kind", "user_id", "host_id", "signal_id"]).select(*KEYS, "o")
        .unionByName(matched.join(k, ["dataset_kind", "signal_id"]).select(*KEYS, "o"))
        .unionByName(decided.where("status = 'finding'").join(f, "fingerprint").select(*KEYS, "o"))
    )
    first = hits.groupBy(*KEYS).agg(F.min("o").alias("o")).select(*KEYS, F.col("o.id").alias("suppressed_by"))
    joined = decided.join(first, KEYS, "left")
    status = F.when(F.col("status") == "skipped", "skipped").when(F.col("suppressed_by").isNotNull(), "suppressed").otherwise(F.col("status"))
    return joined.withColumn("status", status)


def correlate(decided: DataFrame, minutes: int = CORRELATION_MINUTES) -> DataFrame:
    """Finding windows with the number of their finding within the fingerprint.

    Occurrences of one fingerprint up to ``minutes`` apart are one finding; a longer gap starts another.
    """
    per = Window.partitionBy("fingerprint").orderBy("window_start")
    rows = decided.where("status = 'finding'")
    gap = F.unix_micros("window_start") - F.unix_micros(F.lag("window_start").over(per))
    rows = rows.withColumn("_new", F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0))
    return rows.withColumn("finding_no", F.sum("_new").over(per.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def roll_up(occurrences: DataFrame) -> DataFrame:
    """One row per finding: its span, size, highest score, the risk then, and what it began with."""
    first = F.struct("window_start")
    highest = F.struct("detection_score", -F.unix_micros("window_start"))
    return occurrences.groupBy("dataset_kind", "user_id", "host_id", "fingerprint", "finding_no").agg(
        F.min("window_start").alias("first_seen"), F.max("window_start").alias("last_seen"), F.count("*").alias("occurrences"),
        F.max("detection_score").alias("max_score"), F.max_by("risk_level", highest).alias("risk_level"), F.min_by("primary_signal", first).alias("primary_signal"),
    )


def occurrence_rows(occurrences: DataFrame) -> DataFrame:
    """One row per finding and window."""
    return occurrences.select("fingerprint", "finding_no", *KEYS, "detection_score").distinct()


def attach(occurrences: DataFrame, stored: DataFrame, minutes: int = CORRELATION_MINUTES) -> DataFrame:
    """D15 against stored findings: ``occurrences`` with finding_id and is_new, as if taken one by one in the order of time.

    An occurrence goes to the open finding whose span, grown by the occurrences before, comes within
    ``minutes`` of it, to the one seen last of several; without one it starts a finding. Those before
    it have grown a span to the previous occurrence at most. So it goes to the stored finding seen
    last (of those that begin by ``minutes`` after it, if that was seen since ``minutes`` before it)
    where that was seen after the previous occurrence, or the previous is out of reach; else to where
    the previous occurrence went. That is two windows over occurrences and stored findings together.
    """
    span = minutes * 60_000_000
    t = F.unix_micros("window_start")
    own = [c for c in occurrences.columns if c not in ("finding_id", "is_new")]
    o = occurrences.select(*own, t.alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<l:bigint,id:string>").alias("_s"))
    live = stored.where(~F.col("status").isin(*ENDED))
    s = live.select("fingerprint", (F.unix_micros("first_seen") - span).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.unix_micros("last_seen").alias("l"), F.col("finding_id").cast("string").alias("id")).alias("_s"))
    by_time = Window.partitionBy("fingerprint").orderBy("_t", "_kind", *[c for c in KEYS if c in own])
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    both = o.unionByName(s, allowMissingColumns=True).withColumn("_best", F.max("_s").over(upto)).where("_kind = 1")
    both = both.withColumn("_before", F.lag("_t").over(by_time))
    near = F.when(F.col("_best.l") >= F.col("_t") - span, F.col("_best"))
    apart = F.col("_before").isNull() | (F.col("_t") - F.col("_before") > span)
    fresh = F.concat_ws("-", F.lit("f"), "fingerprint", F.col("_t").cast("string"))
    starts = F.when(near.isNotNull() & (apart | (near["l"] > F.col("_before"))), F.struct(near["id"].alias("id"), F.lit(False).alias("is_new"))).when(apart, F.struct(fresh.alias("id"), F.lit(True).alias("is_new")))
    placed = both.withColumn("_to", F.last(starts, ignorenulls=True).over(upto))
    return placed.select(*own, F.col("_to.id").alias("finding_id"), F.col("_to.is_new").alias("is_new"))


def related_previous(findings: DataFrame, closed: DataFrame) -> DataFrame:
    """(finding_id, related_previous): the closed finding of the same fingerprint seen last, whatever its time."""
    last = closed.groupBy("fingerprint").agg(F.max_by("finding_id", F.struct("last_seen", "finding_id")).alias("related_previous"))
    return findings.select("finding_id", "fingerprint").join(last, "fingerprint", "left")


def merge_findings(stored: DataFrame, attached: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """The stored findings after the occurrences that ``attach`` has placed, and the new ones, open.

    Spans grow, occurrences are counted, and a score above the stored one brings its risk along.
    ``stored`` has finding_id, fingerprint, the profile, status, first_seen, last_seen, occurrences,
    max_score, risk_level, primary_signal and related_previous; ``closed`` has the ended ones if
    ``stored`` does not.
    """
    closed = stored.where(F.col("status").isin(*ENDED)) if closed is None else closed
    first = F.struct(-F.col("detection_score"), "window_start")
    news = attached.groupBy("finding_id", "fingerprint", "dataset_kind", "user_id", "host_id").agg(
        F.max("is_new").alias("_new"), F.min("window_start").alias("_f"), F.max("window_start").alias("_l"), F.count("*").alias("_n"), F.max("detection_score").alias("_s"),
        F.min_by("risk_level", first).alias("_r"), F.min_by("primary_signal", "window_start").alias("_p"),
    )
    grown = stored.join(news.select("finding_id", *[c for c in news.columns if c.startswith("_")]), "finding_id", "left")
    higher = F.coalesce(F.col("_s") > F.col("max_score"), F.lit(False))
    changed = {
        "first_seen": F.least("first_seen", "_f"), "last_seen": F.greatest("last_seen", "_l"), "occurrences": F.col("occurrences") + F.coalesce("_n", F.lit(0)),
        "max_score": F.greatest("max_score", "_s"), "risk_level": F.when(higher, F.col("_r")).otherwise(F.col("risk_level")),
    }
    old = grown.select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns])
    fresh = news.where("_new").join(related_previous(news.where("_new"), closed).drop("fingerprint"), "finding_id")
    named = {"first_seen": "_f", "last_seen": "_l", "occurrences": "_n", "max_score": "_s", "risk_level": "_r", "primary_signal": "_p"}
    begun = fresh.select(*[F.lit("open").alias(c) if c == "status" else F.col(named.get(c, c)).alias(c) for c in stored.columns])
    return old.unionByName(begun)


def moves_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in MOVES.items() for b in to], "from_status string, to_status string")


def transitions(requests: DataFrame, moves: DataFrame) -> DataFrame:
    """Requests (finding_id, from_status, to_status, confirm, reason) accepted or refused with a reason."""
    allowed = F.broadcast(moves.withColumn("_ok", F.lit(True)))  # a row a pair of states
    joined = requests.join(allowed, ["from_status", "to_status"], "left")
    refused = F.when(F.col("to_status").isin(*ENDED) & ~F.col("confirm"), "needs confirmation").when(F.col("_ok").isNull(), "no such move")
    return joined.withColumn("refused", refused).drop("_ok")


def latest_state(history: DataFrame) -> DataFrame:
    """The state of each finding after its history (finding_id, to_status, at)."""
    return history.groupBy("finding_id").agg(F.max_by("to_status", F.struct("at", "to_status")).alias("status"), F.count("*").alias("moves"))


def finding_moves(requests: DataFrame, start: str = "open") -> DataFrame:
    """Requests (finding_id, request_id, at, to_status, confirm) with from_status, the state that the accepted ones before left, and refused.

    A state that ends a finding wants a confirmation, and is never left again.
    """
    def step(state: dict, row: dict) -> tuple:
        now, to = state.get("status", start), row["to_status"]
        if to in ENDED and not row["confirm"]:
            return now, "needs confirmation"
        if to not in MOVES.get(now, ()):
            return now, "no such move"
        state["status"] = to
        return now, None

    return in_order(requests, ["finding_id"], ["at", "request_id"], step, {"from_status": "string", "refused": "string"})


def admit_requests(requests: DataFrame, existing: DataFrame, signals: list[str]) -> DataFrame:
    """Requests (``check_requests``' columns and at) in order, each with refused or null.

    The first of equal requests is in force until its time is over; equal ones are refused till then,
    as they are while an equal one of ``existing`` is in force.
    """
    fields = ["scope", "dataset_kind", "user_id", "host_id", "signal_id", "fingerprint"]
    key = F.concat_ws("|", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    held = existing.where("active").groupBy(key.alias("_key")).agg(F.max(F.unix_micros("expires_at")).alias("_held"))
    checked = check_requests(requests, existing.where("false"), signals, "1970-01-01").withColumnRenamed("refused", "_wrong")
    keyed = checked.withColumn("_key", key).join(held, "_key", "left").withColumn("_at", F.unix_micros("at"))

    def step(state: dict, row: dict) -> tuple:
        if row["_wrong"]:
            return (row["_wrong"],)
        if max(state.get("until", -(2**63)), -(2**63) if row["_held"] is None else int(row["_held"])) > row["_at"]:
            return ("an equal one is in force",)
        state["until"] = row["_at"] + int(row["ttl_minutes"]) * 60_000_000
        return (None,)

    return in_order(keyed, ["_key"], ["_at", "request_id"], step, {"refused": "string"}).select(*requests.columns, "refused")


def detail(findings: DataFrame, occurrences: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Findings with their occurrences, and the steps of their history (to_status, at), in order."""
    if history is not None:
        h = history.groupBy("fingerprint", "finding_no").agg(F.array_sort(F.collect_list(F.struct("at", "to_status"))).alias("history_list"))
        findings = findings.join(h, ["fingerprint", "finding_no"], "left")
    o = occurrences.groupBy("fingerprint", "finding_no").agg(F.array_sort(F.collect_list(F.struct("window_start", "detection_score"))).alias("occurrence_list"))
    return findings.join(o, ["fingerprint", "finding_no"], "left")
