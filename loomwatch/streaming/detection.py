"""Novelty across the windows of a stream, and continuous detection of the windows it closes.

Which entities are known is keyed state of the stream (RocksDB, a key an entity), so a batch reads
what it brings and nothing that earlier ones stored. Windows, evaluations, occurrences and findings
are versioned tables, bounded by time: a cycle reads the parts that may hold open windows, and
commits under a name that follows from what it read, so one that runs again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwatch.functions import ids
from loomwatch.operators import coverage as C, detection as D, findings as G
from loomwatch.operators.windows import KEYS, PROFILE, input_hash, windows_of_flagged
from loomwatch.session import materialize, shared_folder
from loomwatch.sources.versioned import Table
from loomwatch.streaming.features import closed_parts, read_events_stream

EVALUATION = ["window_id", "feature_input_hash", "policy_hash", "model_id"]
DECIDED = ["n_matched", "primary_signal", "detection_score", "risk_level", "status", "fingerprint", "suppressed_by", "skip_reason"]
FINDING = "finding_id STRING, fingerprint STRING, dataset_kind STRING, user_id STRING, host_id STRING, status STRING, first_seen TIMESTAMP, last_seen TIMESTAMP, occurrences LONG, max_score INT, risk_level STRING, primary_signal STRING, related_previous STRING"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Collectors poll at least once in so many minutes; older polls cover no open window.
LONGEST_POLL_MINUTES = 24 * 60


@dataclass
class Store:
    """The tables of one detection stream."""

    spark: SparkSession
    base: str

    @cached_property
    def windows(self) -> Table:
        return Table(self.spark, f"{self.base}/windows", "window_start")

    @cached_property
    def evaluations(self) -> Table:
        return Table(self.spark, f"{self.base}/evaluations", "window_start")

    @cached_property
    def occurrences(self) -> Table:
        return Table(self.spark, f"{self.base}/occurrences", "window_start")

    @cached_property
    def findings(self) -> Table:
        return Table(self.spark, f"{self.base}/findings", "last_seen")


@dataclass(frozen=True)
class Watch:
    """What windows are judged by: a policy and its hash, the quality gate's observations, suppressions and the time they are judged at."""

    policy: dict
    policy_hash: str
    minutes: int
    observations: DataFrame | None = None
    suppressions: DataFrame | None = None
    now: str | None = None
    gate: tuple[str, ...] = D.QUALITY_GATE


class FirstSeen(StatefulProcessor):
    """Keyed by entity: whether any window has had it. Windows close in the order of time, so the first of a batch is the first of all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, some = self.seen.exists(), pd.concat(list(rows))  # an entity's windows of one batch
        first = some.window_start.min()
        if not known:
            self.seen.update((first,))
        yield some.assign(is_new=(some.window_start == first) & (not known and key[-1] != ""))

    def close(self) -> None:
        pass


def flagged_parts(parts: DataFrame) -> DataFrame:
    """``parts`` with is_new, from state that is kept across batches; parts without an entity are never new."""
    keyed = parts.withColumn("entity", F.coalesce("entity", F.lit("")))
    shape = T.StructType([*keyed.schema, T.StructField("is_new", T.BooleanType())])
    out = keyed.groupBy(*PROFILE, "event_type", "entity").transformWithStateInPandas(FirstSeen(), shape, "append", "None")
    return out.withColumn("entity", F.nullif("entity", F.lit("")))


def take_windows(store: Store, parts: DataFrame, batch: int, minutes: int) -> None:
    """The windows that a batch closes; a batch that comes again adds nothing."""
    windows = windows_of_flagged(parts, minutes)
    placed = windows.withColumn("source_event_hash", F.lit(None).cast("string"))
    placed = placed.select(ids.window_id(minutes).alias("window_id"), input_hash(placed).alias("feature_input_hash"), *windows.columns, F.lit(batch).alias("batch"))
    store.windows.append(placed, f"batch-{batch}")


def _open_windows(store: Store, watch: Watch, max_windows: int | None) -> DataFrame | None:
    """Windows without an evaluation under the same input and policy, the oldest first.

    What is older than the newest evaluated window of the policy has been evaluated: cycles take the
    oldest first, and a stream closes no window before one that it has closed. So parts of windows
    and evaluations that end before it are not read.
    """
    done = [p.hi for p in store.evaluations.version().parts if p.tag == watch.policy_hash and p.hi is not None]
    mark = max(done, default=None)
    windows = store.windows.read(lo=mark)
    if windows is None:
        return None
    open_ = windows.drop("batch").withColumn("policy_hash", F.lit(watch.policy_hash)).withColumn("model_id", F.lit(None).cast("string"))
    if mark is not None:
        open_ = open_.where(F.unix_micros("window_start") >= mark)
        open_ = D.pending(open_, store.evaluations.read(lo=mark, tag=watch.policy_hash).where(F.unix_micros("window_start") >= mark).select(*EVALUATION))
    return open_ if max_windows is None else open_.orderBy("window_start", "window_id").limit(max_windows)


def _judged(open_: DataFrame, watch: Watch) -> DataFrame:
    """Decisions on ``open_``: gate, rules, suppression."""
    if watch.observations is not None:
        lo, hi = open_.agg(F.min("window_start"), F.max("window_end")).first()
        at = F.col("observed_at")
        near = watch.observations.where((at >= F.lit(lo) - F.make_interval(mins=F.lit(LONGEST_POLL_MINUTES))) & (at < F.lit(hi)))
        open_ = C.window_quality(open_, C.coverage(near, watch.minutes), watch.minutes)
    out = D.with_fingerprint(D.fuse(D.with_signals(open_, watch.policy), watch.gate), watch.policy_hash)
    return out.withColumn("suppressed_by", F.lit(None).cast("string")) if watch.suppressions is None else G.suppress(out, watch.suppressions, watch.now)


def _correlate(store: Store, found: DataFrame, cycle: str) -> None:
    """The cycle's finding windows into the findings that they go on with, or new ones."""
    least = found.agg(F.unix_micros(F.min("window_start"))).first()[0]
    if least is None:
        return
    since = least - G.CORRELATION_MINUTES * 60_000_000
    recent = F.unix_micros("last_seen") >= since
    none = store.spark.createDataFrame([], FINDING)
    table, every = store.findings.read(lo=since), store.findings.read()
    stored = none if table is None else table.where(recent)
    closed = none if every is None else every.where(F.col("status").isin(*G.ENDED))
    placed = materialize(G.attach(found, stored), "attached")
    store.findings.replace_where(recent, cycle, G.merge_findings(stored, placed, closed), lo=since)
    store.occurrences.append(placed.select("finding_id", *KEYS, "window_id", "detection_score", "risk_level"), cycle)


def run_cycle(store: Store, watch: Watch, max_windows: int | None = None) -> int:
    """Evaluates open windows, correlates their findings, and returns how many windows it took.

    ``max_windows`` bounds one cycle; what it leaves is open in the next. With nothing open nothing is
    written. Evaluations are committed last, so a cycle that fails before runs again under its name.
    """
    cycle = f"{watch.policy_hash}-{store.windows.version().number}-{store.evaluations.version().number}"
    open_ = _open_windows(store, watch, max_windows)
    if open_ is None:
        return 0
    open_ = materialize(open_, "open-windows")
    n = open_.count()
    if n:
        decided = materialize(_judged(open_, watch), "cycle")
        _correlate(store, decided.where("status = 'finding'").select("fingerprint", *KEYS, "window_id", "detection_score", "risk_level", "primary_signal"), cycle)
        store.evaluations.append(decided.select(*KEYS, *EVALUATION, "new_process_count", "new_remote_count", *DECIDED, F.lit(cycle).alias("cycle")), cycle, tag=watch.policy_hash)
    return n


def detect_available(store: Store, events: DataFrame, watch: Watch, max_windows: int | None = None) -> None:
    """Takes in all that the source has, evaluates what closes, batch by batch, and stops; a rerun goes on from there."""

    def take(parts: DataFrame, batch: int) -> None:
        parts = parts.persist()  # the state is asked once a batch, not once a job
        if not parts.isEmpty():
            take_windows(store, parts, batch, watch.minutes)
        parts.unpersist()
        while run_cycle(store, watch, max_windows):
            pass

    before = store.spark.conf.get(STATE_STORE)
    store.spark.conf.set(STATE_STORE, ROCKS)
    try:
        sink = flagged_parts(closed_parts(events, watch.minutes).withColumn("window_start", F.col("w.start")).drop("w")).writeStream.foreachBatch(take).option("checkpointLocation", f"{store.base}/state")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        store.spark.conf.set(STATE_STORE, before)


def detected(spark: SparkSession, folder: str, watch: Watch, max_windows: int | None = None) -> Store:
    """The store after one run over the events in ``folder``."""
    store = Store(spark, f"{shared_folder(spark)}/detection-stream-{uuid.uuid4().hex}")
    detect_available(store, read_events_stream(spark, folder), watch, max_windows)
    return store
