"""Collector data: security logs, snapshot differences and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Log event ids with the action and result they stand for, and interactive logon types.
LOG_EVENTS = {4624: ("login", "success"), 4625: ("login", "failure"), 4634: ("logout", "success"), 4647: ("logout", "success")}
INTERACTIVE = (2, 7, 10, 11)
SYSTEM_ACCOUNTS = ("system", "local service", "network service")


def auth_events(log: DataFrame) -> DataFrame:
    """Known log events of people: interactive or without logon type, no empty, machine or system account."""
    chain = None
    for event, (action, result) in LOG_EVENTS.items():
        value = F.struct(F.lit(action).alias("action"), F.lit(result).alias("result"))
        fits = F.col("log_event_id") == event
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    person = (F.trim("account") != "") & ~F.endswith(F.trim("account"), F.lit("$")) & ~F.lower(F.trim("account")).isin(*SYSTEM_ACCOUNTS)
    fine = person & (F.col("logon_type").isNull() | F.col("logon_type").isin(*INTERACTIVE))
    kept = log.where(fine).withColumn("_e", chain).where("_e is not null")
    return kept.select("source", "record_id", "ts", "account", "logon_type", F.col("_e.action").alias("action"), F.col("_e.result").alias("result"))


# Names of a log record's fields, in event XML and in the two spellings of JSON.
LOG_FIELDS = {
    "event_id": ("EventID", "event_id"), "record_id": ("EventRecordID", "RecordID", "record_id"), "time_created": ("TimeCreated", "time_created"),
    "target_user_name": ("TargetUserName", "target_user_name"), "target_domain_name": ("TargetDomainName", "target_domain_name"),
    "logon_type": ("LogonType", "logon_type"), "failure_reason": ("FailureReason", "failure_reason"), "status": ("Status", "status"), "sub_status": ("SubStatus", "sub_status"),
}
EVENT_XML = "System STRUCT<EventID STRING, EventRecordID STRING, TimeCreated STRUCT<_SystemTime STRING, _VALUE STRING>>, EventData STRUCT<Data ARRAY<STRUCT<_Name STRING, _VALUE STRING>>>"


def log_fields(records: DataFrame, body: str = "body") -> DataFrame:
    """The fields of log records as text columns beside the input's others; ``body`` is JSON or event XML.

    In JSON the first name with a value counts, in XML the first Data element of that name. A field
    that is absent or empty is null; so are all of a broken, empty or null body.
    """
    text = F.col(body)
    root = F.from_xml(F.when(F.startswith(F.ltrim(text), F.lit("<")), text), EVENT_XML, {"rowTag": "Event", "mode": "PERMISSIVE"})
    rows = records.withColumn("_x", root)
    in_system = {"event_id": F.col("_x.System.EventID"), "record_id": F.col("_x.System.EventRecordID"), "time_created": F.col("_x.System.TimeCreated._SystemTime")}

    def field(name: str) -> Column:
        keys = LOG_FIELDS[name]
        data = F.get(F.filter(F.col("_x.EventData.Data"), lambda d: d["_Name"] == keys[0]), F.lit(0))["_VALUE"]
        json = [F.get_json_object(text, f"$.{k}") for k in keys]
        return F.nullif(F.coalesce(in_system.get(name, data), *json), F.lit("")).alias(name)

    others = [c for c in records.columns if c not in LOG_FIELDS and c != body]
    return rows.select(*others, *[field(n) for n in LOG_FIELDS])


def after_record(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows past the last record seen of their source; ``cursors`` has a row a source."""
    seen = cursors.select("source", F.col("record_id").alias("_last"))
    return log.join(seen, "source", "left").where(F.col("_last").isNull() | (F.col("record_id") > F.col("_last"))).drop("_last")


def last_records(log: DataFrame) -> DataFrame:
    """The new cursors."""
    return log.groupBy("source").agg(F.max("record_id").alias("record_id"))


def snapshot_changes(rows: DataFrame, keys: list[str], appeared: str, gone: str) -> DataFrame:
    """What appeared and went between consecutive snapshots of a host (null-safe keys).

    A row's run is followed by number of snapshot, so one shuffle by host and key finds both ends;
    a host's first snapshot brings nothing and its last loses nothing.
    """
    numbers = rows.select("host_id", "snapshot").distinct()
    numbers = numbers.withColumn("no", F.row_number().over(Window.partitionBy("host_id").orderBy("snapshot")))
    order = Window.partitionBy("host_id", *keys).orderBy("no")
    ends = rows.distinct().join(numbers, ["host_id", "snapshot"]).withColumn("before", F.lag("no").over(order)).withColumn("after", F.lead("no").over(order))
    following = numbers.select("host_id", (F.col("no") - 1).alias("no"), F.col("snapshot").alias("next"))
    ends = ends.join(following, ["host_id", "no"], "left")
    came = (F.col("no") > 1) & ~F.coalesce(F.col("before") == F.col("no") - 1, F.lit(False))
    went = F.col("next").isNotNull() & ~F.coalesce(F.col("after") == F.col("no") + 1, F.lit(False))
    changes = F.array_compact(F.array(
        F.when(came, F.struct(F.col("snapshot").alias("snapshot"), F.lit(appeared).alias("action"))),
        F.when(went, F.struct(F.col("next").alias("snapshot"), F.lit(gone).alias("action"))),
    ))
    return ends.select("host_id", *keys, F.explode(changes).alias("c")).select("host_id", "c.snapshot", "c.action", *keys)


def counter_deltas(rows: DataFrame) -> DataFrame:
    """Growth of a counter since the row before, 0 at first and after a reset."""
    before = F.lag("counter").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("delta", F.greatest(F.lit(0), F.col("counter") - F.coalesce(before, "counter")))
