"""Inputs: the driver's `events` table read as telemetry, and the inputs derived from it.

Events read as TIMESTAMP_NTZ and become UTC timestamps here. Every derived table is an expression
over `events`, so it grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Event types of the table and the telemetry types they stand for.
TYPES = {"click": "process", "view": "network", "purchase": "system_metrics", "signup": "authentication", "error": "authentication"}
COLLECTORS = ("system", "process", "network")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def telemetry(events: DataFrame) -> DataFrame:
    """One telemetry event per row, its payload in nullable columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.pmod("user_id", F.lit(10)).cast("int")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]

    def when(source: str, value: Column) -> Column:
        return F.when(F.col("event_type").isin(*[t for t, n in TYPES.items() if n == source]), value)

    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(user < 5, "real").otherwise("synthetic").alias("dataset_kind"),
        F.concat(F.lit("user-"), user).alias("user_id"),
        F.concat(F.lit("host-"), user % 2).alias("host_id"),
        F.get(F.array(*map(F.lit, COLLECTORS)), F.pmod("event_id", F.lit(3)).cast("int")).alias("source"),
        kind.alias("event_type"),
        k.alias("k"),
        when("process", F.concat(F.lit("proc-"), k)).alias("process_name"),
        when("network", F.concat(F.lit("198.51.100."), k)).alias("remote_address"),
        when("network", (1000 + F.col("event_id") % 50).cast("int")).alias("remote_port"),
        when("system_metrics", F.least(F.lit(100.0), "value")).alias("cpu_percent"),
        when("system_metrics", F.least(F.lit(100.0), F.col("value") * 0.9 + 5)).alias("ram_percent"),
        F.when(F.col("event_type") == "signup", "success").when(F.col("event_type") == "error", "failure").alias("result"),
    )


def _two(x: Column) -> Column:
    """Two decimals, cut off: whole hundredths, which engines agree on."""
    cents = F.floor(x * 100).cast("long")
    return F.concat((F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def raw_telemetry(events: DataFrame) -> DataFrame:
    """Events as they arrive: payload as JSON text, some of them broken, with an ingestion time."""
    t = telemetry(events).withColumn("dirt", (F.col("event_id") % 50).cast("int"))
    port = F.when(F.col("dirt") == 2, F.lit(70000)).otherwise(F.col("remote_port"))
    cpu = F.when(F.col("dirt") == 1, "140.00").when(F.col("dirt") == 6, "NaN").otherwise(_two(F.col("cpu_percent")))
    name = F.when(F.col("dirt") == 4, "").otherwise(F.col("process_name"))
    result = F.when(F.col("dirt") == 3, "maybe").otherwise(F.col("result"))
    body = (
        F.when(F.col("event_type") == "process", F.concat(F.lit('"process_name":"'), name, F.lit('","pid":'), "k"))
        .when(F.col("event_type") == "network", F.concat(F.lit('"remote_address":"'), "remote_address", F.lit('","remote_port":'), port))
        .when(F.col("event_type") == "system_metrics", F.concat(F.lit('"cpu_percent":'), cpu, F.lit(',"ram_percent":'), _two(F.col("ram_percent"))))
        .otherwise(F.concat(F.lit('"result":"'), result, F.lit('","method":"local"')))
    )
    extra = F.when(F.col("dirt") == 0, ',"unexpected":1').otherwise("")
    return t.select(
        "event_id",
        F.when(F.col("dirt") == 5, F.lit("1999-06-01 00:00:00").cast("timestamp")).otherwise(F.col("ts")).alias("ts"),
        "dataset_kind",
        F.when(F.col("dirt") == 7, "  ").otherwise(F.concat(F.lit(" "), "user_id")).alias("user_id"),
        "host_id",
        "source",
        "event_type",
        F.concat(F.lit("{"), body, extra, F.lit("}")).alias("payload"),
        ingestion_time().alias("ingested_at"),
    )


def ingestion_time() -> Column:
    """Arrival: 45 minutes late for every seventh event, 3 hours for every eleventh."""
    late = F.when(F.col("event_id") % 11 == 0, F.lit(180)).when(F.col("event_id") % 7 == 0, F.lit(45)).otherwise(F.lit(0))
    return F.timestamp_micros(F.unix_micros("ts") + late.cast("long") * 60_000_000)


def arrivals(events: DataFrame) -> DataFrame:
    """Every event once, every twentieth a second time: (telemetry columns, arrival)."""
    once = telemetry(events).withColumn("arrival", F.lit(1))
    again = telemetry(events).where(F.col("event_id") % 20 == 0).withColumn("arrival", F.lit(2))
    return once.unionByName(again)


def observations(events: DataFrame) -> DataFrame:
    """Collector polls: one per event, with the interval each vouches for."""
    return telemetry(events).select(
        F.col("event_id").alias("observation_id"),
        "dataset_kind",
        "user_id",
        "host_id",
        F.col("source").alias("collector"),
        F.col("ts").alias("observed_at"),
        (1800 + 900 * (F.col("event_id") % 4)).cast("int").alias("interval_seconds"),
        (F.col("event_id") % 9 != 0).alias("successful"),
    )


def sessions(events: DataFrame) -> DataFrame:
    """Collection sessions: a user's day; the last day still runs."""
    t = telemetry(events).groupBy("dataset_kind", "user_id", "host_id", F.date_trunc("day", "ts").alias("day"))
    s = t.agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"))
    last = s.agg(F.max("day").alias("last_day"))
    return s.crossJoin(F.broadcast(last)).select(  # the right side is one row
        F.concat_ws("|", "user_id", F.date_format("day", "yyyy-MM-dd")).alias("session_id"),
        "dataset_kind", "user_id", "host_id", "started_at",
        F.when(F.col("day") < F.col("last_day"), F.col("last_seen")).alias("stopped_at"),
        F.col("last_seen").alias("last_heartbeat_at"),
        F.when(F.col("day") < F.col("last_day"), "stopped").otherwise("running").alias("status"),
    )


def auth_log(events: DataFrame) -> DataFrame:
    """A security log: ids, logon types and accounts by remainders of event_id."""
    def pick(values: list, modulus: int) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.pmod("event_id", F.lit(modulus)).cast("int"))

    user = F.concat(F.lit("user-"), F.col("user_id") % 10)
    account = F.when(F.col("event_id") % 4 == 0, user).when(F.col("event_id") % 4 == 1, "SYSTEM").when(F.col("event_id") % 4 == 2, "HOST$").otherwise("")
    return events.select(
        F.concat(F.lit("host-"), F.col("user_id") % 10 % 2).alias("source"),
        F.col("event_id").alias("record_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        pick([4624, 4625, 4634, 4647, 4688], 5).alias("log_event_id"),
        pick([2, 3, 7, 10, 11, None], 6).cast("int").alias("logon_type"),
        account.alias("account"),
    )


def raw_auth_log(events: DataFrame) -> DataFrame:
    """The security log as it is collected: (source, body), in two spellings of JSON and as event XML."""
    log = auth_log(events)
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    camel = F.to_json(F.struct(F.col("log_event_id").alias("EventID"), F.col("record_id").alias("RecordID"), at.alias("TimeCreated"), F.col("account").alias("TargetUserName"), F.col("logon_type").alias("LogonType")))
    snake = F.to_json(F.struct(F.col("log_event_id").alias("event_id"), "record_id", at.alias("time_created"), F.col("account").alias("target_user_name"), "logon_type"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>'), "log_event_id", F.lit("</EventID><TimeCreated SystemTime=\""), at,
        F.lit('"/><EventRecordID>'), "record_id", F.lit('</EventRecordID></System><EventData><Data Name="TargetUserName">'), "account",
        F.lit('</Data><Data Name="LogonType">'), F.coalesce(F.col("logon_type").cast("string"), F.lit("")), F.lit("</Data></EventData></Event>"),
    )
    form = F.col("record_id") % 3
    return log.select("source", F.when(form == 0, camel).when(form == 1, snake).otherwise(xml).alias("body"))


def process_snapshots(events: DataFrame) -> DataFrame:
    """(host_id, snapshot day, pid, create_time) of the processes seen that day."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    seen = telemetry(events).where("event_type = 'process'").select("host_id", day.alias("snapshot"), F.col("k").alias("pid"))
    return seen.distinct().withColumn("create_time", F.floor(F.col("snapshot") / 3).cast("int"))


def connection_snapshots(events: DataFrame) -> DataFrame:
    """(host_id, snapshot day, protocol, remote_address, remote_port, pid) open that day; pid may be null."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    pid = F.when(F.col("k") % 5 != 0, F.col("k"))
    rows = telemetry(events).where("event_type = 'network'")
    return rows.select("host_id", day.alias("snapshot"), F.lit("tcp").alias("protocol"), "remote_address", "remote_port", pid.alias("pid")).distinct()


def counters(events: DataFrame) -> DataFrame:
    """(user_id, ts, event_id, counter): a growing counter that starts anew every seven days."""
    from pyspark.sql import Window

    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    t = events.select(F.concat(F.lit("user-"), F.col("user_id") % 10).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round(F.col("value") * 1000).cast("long").alias("n"))
    growing = Window.partitionBy("user_id", week).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("user_id", "ts", "event_id", F.sum("n").over(growing).alias("counter"))
