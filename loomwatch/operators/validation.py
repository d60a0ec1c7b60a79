"""Ingest: payload contracts, quarantine, deduplication and the audit rows around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Check:
    """One payload key: its kind, whether it must be there, and its bounds or choices."""

    name: str
    kind: str  # text, int, number or choice
    required: bool = False
    lo: float | None = None
    hi: float | None = None
    choices: tuple[str, ...] = ()


# The payload contracts, by event type.
MAX_TEXT, MAX_PID, MAX_PORT, MAX_BYTES = 512, 4_294_967_295, 65_535, 8_192
CONTRACTS = {
    "process": (
        Check("action", "choice", choices=("started", "stopped", "snapshot")),
        Check("process_name", "text", True, 1, MAX_TEXT),
        Check("pid", "int", lo=0, hi=MAX_PID),
        Check("executable_path", "text", lo=0, hi=MAX_TEXT),
        Check("parent_pid", "int", lo=0, hi=MAX_PID),
        Check("parent_process", "text", lo=0, hi=MAX_TEXT),
        Check("command_family", "text", lo=0, hi=128),
    ),
    "network": (
        Check("action", "choice", choices=("opened", "closed", "snapshot")),
        Check("remote_address", "text", True, 1, 128),
        Check("remote_port", "int", True, 0, MAX_PORT),
        Check("local_port", "int", lo=0, hi=MAX_PORT),
        Check("protocol", "choice", choices=("tcp", "udp", "icmp", "other")),
        Check("state", "text", lo=0, hi=64),
        Check("pid", "int", lo=0, hi=MAX_PID),
        Check("process_name", "text", lo=0, hi=MAX_TEXT),
        Check("connection_count", "int", lo=0, hi=1_000_000),
    ),
    "system_metrics": (
        Check("cpu_percent", "number", True, 0, 100),
        Check("ram_percent", "number", True, 0, 100),
        Check("disk_percent", "number", lo=0, hi=100),
        Check("network_bytes_sent_delta", "int", lo=0),
        Check("network_bytes_recv_delta", "int", lo=0),
        Check("boot_time", "number", lo=0),
        Check("uptime_seconds", "number", lo=0),
    ),
    "authentication": (
        Check("action", "choice", choices=("login", "logout", "authentication")),
        Check("result", "choice", True, choices=("success", "failure")),
        Check("method", "text", lo=0, hi=128),
        Check("failure_reason", "text", lo=0, hi=MAX_TEXT),
        Check("event_id", "int", lo=0),
        Check("record_id", "int", lo=0),
        Check("logon_type", "int", lo=0, hi=99),
        Check("target_domain_name", "text", lo=0, hi=MAX_TEXT),
        Check("status", "text", lo=0, hi=128),
        Check("sub_status", "text", lo=0, hi=128),
    ),
}


# The class of each check's error.
ERROR_CLASSES = {
    "payload": "ValidationError", "identifier": "ValidationError", "unknown_keys": "ValueError", "timestamp": "ValueError",
    "size": "ValueError", "not_finite": "ValidationError", "contract": "ValidationError",
}


def payload_map(payload: Column) -> Column:
    """The payload's keys and values as text; quotes that the parser leaves around bare NaN go."""
    return F.transform_values(F.from_json(payload, "map<string,string>"), lambda _, v: F.regexp_replace(v, r'^"(NaN|-?Infinity)"$', "$1"))


def allowed_keys() -> Column:
    """The keys of the row's event type."""
    chain = None
    for kind, checks in CONTRACTS.items():
        keys = F.array(*[F.lit(c.name) for c in checks])
        chain = F.when(F.col("event_type") == kind, keys) if chain is None else chain.when(F.col("event_type") == kind, keys)
    return chain.otherwise(F.array().cast("array<string>"))


def whitelist(payload: Column) -> Column:
    """V1: the payload without unknown keys."""
    return F.map_filter(payload, lambda k, _: F.array_contains(allowed_keys(), k))


def unknown_keys(payload: Column) -> Column:
    """V2: the keys that the event type doesn't have, sorted."""
    return F.array_sort(F.array_except(F.map_keys(payload), allowed_keys()))


def _broken(check: Check, payload: Column) -> Column:
    value = F.try_element_at(payload, F.lit(check.name))
    if check.kind == "choice":
        wrong = ~value.isin(*check.choices)
    elif check.kind == "text":
        wrong = ~F.char_length(value).between(check.lo, check.hi)
    else:
        number = value.try_cast("bigint") if check.kind == "int" else value.try_cast("double")
        whole = value.rlike(r"^-?[0-9]+$") if check.kind == "int" else F.lit(True)
        inside = (number >= check.lo) & (number <= (check.hi if check.hi is not None else float("inf")))
        wrong = ~F.coalesce(whole & inside & ~F.isnan(number.cast("double")), F.lit(False))
    wrong = F.when(value.isNull(), F.lit(check.required)).otherwise(wrong)
    return F.when(wrong, F.lit(check.name))


def broken_fields(payload: Column) -> Column:
    """V3-V6: the names of the fields that break the event type's contract, in contract order."""
    chain = None
    for kind, checks in CONTRACTS.items():
        names = F.array_compact(F.array(*[_broken(c, payload) for c in checks]))
        chain = F.when(F.col("event_type") == kind, names) if chain is None else chain.when(F.col("event_type") == kind, names)
    return chain.otherwise(F.array(F.lit("event_type")))


def not_finite(payload: Column) -> Column:
    """V7: keys whose value is NaN, infinite or longer than a text may be, sorted."""
    def odd(v: Column) -> Column:
        number = v.try_cast("double")
        named = v.isin("NaN", "Infinity", "-Infinity") | F.coalesce(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(False))
        return named | (F.char_length(v) > MAX_TEXT)

    return F.array_sort(F.map_keys(F.map_filter(payload, lambda _, v: odd(v))))


def validate(raw: DataFrame) -> DataFrame:
    """``raw`` with the payload map, trimmed identifiers, and errors (check, error_class, text).

    Every check is an expression of the row; an event is accepted if no check fails. The order is
    that in which the checks are made; the first one gives a quarantined row its class.
    """
    ids = ("user_id", "host_id", "source")
    df = raw.withColumns({c: F.trim(c) for c in ids}).withColumn("fields", payload_map(F.col("payload")))

    def error(check: str, text: Column) -> Column:
        return F.when(text != "", F.struct(F.lit(check).alias("check"), F.lit(ERROR_CLASSES[check]).alias("error_class"), text.alias("text")))

    fields = F.col("fields")
    blank = F.concat_ws(",", *[F.when(~F.char_length(c).between(1, 128), F.lit(c)) for c in ids])
    late = F.when(~F.year("ts").between(2000, 2100), F.lit("timestamp is outside supported range")).otherwise("")
    size = F.when(F.octet_length(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))) > MAX_BYTES, F.lit("payload is too large")).otherwise("")
    unknown = F.array_join(unknown_keys(fields), ", ")
    checks = [
        error("payload", F.when(fields.isNull(), F.lit("payload is no object")).otherwise("")),
        error("identifier", blank),
        error("unknown_keys", F.when(unknown != "", F.concat(F.lit("unknown or forbidden payload field(s): "), unknown)).otherwise("")),
        error("timestamp", late),
        error("size", size),
        error("not_finite", F.array_join(not_finite(fields), ",")),
        error("contract", F.array_join(broken_fields(fields), ",")),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def accepted(validated: DataFrame) -> DataFrame:
    """The events without errors."""
    return validated.where(F.size("errors") == 0)


def quarantined(validated: DataFrame) -> DataFrame:
    """The rest, with the first error's class and check, all errors as the reason (1000 characters) and a safe payload."""
    first, failed = F.col("errors")[0]["error_class"], F.col("errors")[0]["check"]
    reason = F.array_join(F.transform("errors", lambda e: F.concat_ws(": ", e["check"], e["text"])), "; ")
    return validated.where(F.size("errors") > 0).select(
        "event_id", "dataset_kind", "event_type", "source", first.alias("error_class"), failed.alias("failed_check"), F.substring(reason, 1, 1000).alias("reason"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(whitelist(F.col("fields")))))).alias("safe_payload"), "ingested_at",
    )


def deduplicate(arrived: DataFrame, stored_ids: DataFrame | None = None) -> DataFrame:
    """The first arrival of each event_id, and none that is stored already."""
    first = Window.partitionBy("event_id").orderBy("arrival")
    once = arrived.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once if stored_ids is None else once.join(stored_ids.select("event_id"), "event_id", "left_anti")


def duplicates(arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """Later arrivals and arrivals of stored events, with when the event was first seen.

    ``stored`` has (event_id, first_seen_at).
    """
    first = Window.partitionBy("event_id").orderBy("arrival")
    ranked = arrived.withColumn("_n", F.row_number().over(first)).withColumn("_t", F.first("ts").over(first))
    joined = ranked.join(stored, "event_id", "left")
    again = joined.where((F.col("_n") > 1) | F.col("first_seen_at").isNotNull())
    return again.select("event_id", "dataset_kind", "event_type", "arrival", F.coalesce("first_seen_at", "_t").alias("first_seen_at"))
