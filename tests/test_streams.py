"""Streams in several batches against one batch computation, and log records of odd shapes."""

import datetime
import time
from pathlib import Path

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwatch.operators import collectors as X, detection as D, findings as G, windows as W
from loomwatch.sources import telemetry as S
from loomwatch.streaming import detection as T
from loomwatch.streaming.features import read_events_stream

EVENTS = Path("/root/testdata/sf0.001/events.parquet")


@pytest.fixture()
def folder(tmp_path):
    """The events in four files, in the order of time."""
    if not EVENTS.exists():
        pytest.skip("no test tables here")
    table = pq.read_table(EVENTS).sort_by("ts")
    step = table.num_rows // 4 + 1
    for i in range(4):
        pq.write_table(table.slice(i * step, step), tmp_path / f"events-{i}.parquet")
        time.sleep(0.02)
    return str(tmp_path), pc.max(table["ts"]).as_py()


def watch(**more):
    return T.Watch(D.scaled_policy(), "p", 60, **more)


def test_batches_give_what_one_computation_gives_and_a_second_run_nothing(spark, folder, tmp_path_factory):
    path, newest = folder
    store = T.Store(spark, str(tmp_path_factory.mktemp("store")))
    T.detect_available(store, read_events_stream(spark, path, 1), watch(), 200)
    names = [*W.KEYS, *W.FEATURES, "event_count"]
    all_windows = W.feature_windows(S.telemetry(S.read_table(spark, path, "events-*")), 60)
    newest -= datetime.timedelta(microseconds=newest.microsecond % 1000)  # watermarks are of milliseconds
    closed = all_windows.where(F.col("window_end") <= F.lit(newest - datetime.timedelta(hours=1)))
    rounded = [F.round(c, 6).alias(c) if c in W.FEATURES else F.col(c) for c in names]
    want = sorted(map(tuple, closed.select(*rounded).collect()))
    assert sorted(map(tuple, store.windows.read().select(*rounded).collect())) == want
    assert len({r.batch for r in store.windows.read().select("batch").distinct().collect()}) > 1
    done = store.evaluations.read()
    assert done.count() == done.select("window_id").distinct().count() == len(want)
    found = G.roll_up(G.correlate(D.with_fingerprint(D.fuse(D.with_signals(closed, D.scaled_policy())), "p")))
    span = ["fingerprint", "first_seen", "last_seen", "occurrences", "max_score", "risk_level"]
    assert sorted(map(tuple, store.findings.read().select(*span).collect())) == sorted(map(tuple, found.select(*span).collect()))
    assert store.occurrences.read().count() == found.agg(F.sum("occurrences")).first()[0]
    before = [t.version().number for t in (store.windows, store.evaluations, store.findings, store.occurrences)]
    T.detect_available(store, read_events_stream(spark, path, 1), watch())
    assert T.run_cycle(store, watch()) == 0
    assert [t.version().number for t in (store.windows, store.evaluations, store.findings, store.occurrences)] == before


PARTS = "dataset_kind STRING, user_id STRING, host_id STRING, window_start TIMESTAMP, event_type STRING, entity STRING, n LONG, cpu_sum DOUBLE, cpu_n LONG, cpu_max DOUBLE, ram_sum DOUBLE, ram_n LONG, ram_max DOUBLE, ok LONG, failed LONG, is_new BOOLEAN"


def parts(spark, hours, is_new=True):
    rows = [("real", "u", "h", datetime.datetime(2024, 1, 1, i), "process", f"p{i}", 1, None, 0, None, None, 0, None, 0, 0, is_new) for i in hours]
    return spark.createDataFrame(rows, PARTS)


def test_cycles_of_bounded_size_take_the_oldest_windows_first(spark, tmp_path):
    store = T.Store(spark, str(tmp_path))
    assert T.run_cycle(store, watch()) == 0
    T.take_windows(store, parts(spark, range(5)), 0, 60)
    T.take_windows(store, parts(spark, range(5)), 0, 60)  # the batch comes again
    for expected in (2, 4, 5, 5):
        T.run_cycle(store, watch(), max_windows=2)
        hours = sorted(r.h for r in store.evaluations.read().select(F.hour("window_start").alias("h")).collect())
        assert hours == list(range(expected))
    T.take_windows(store, parts(spark, [9], False), 1, 60)
    assert store.windows.read().where("batch = 1").first().new_process_count == 0
    assert T.run_cycle(store, watch()) == 1


def test_a_cycle_that_fails_between_its_commits_runs_again_as_if_it_had_not(spark, tmp_path, monkeypatch):
    store = T.Store(spark, str(tmp_path))
    T.take_windows(store, parts(spark, [0, 1, 5]), 0, 60)
    monkeypatch.setattr(store.evaluations, "append", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        T.run_cycle(store, watch())
    assert store.evaluations.read() is None and store.findings.read().count() == 2
    monkeypatch.undo()
    assert T.run_cycle(store, watch()) == 3
    rows = {r.first_seen.hour: (r.last_seen.hour, r.occurrences) for r in store.findings.read().collect()}
    assert rows == {0: (1, 2), 5: (5, 1)} and store.occurrences.read().count() == 3


def test_gate_and_suppression_keep_windows_out_of_findings_but_not_of_evaluations(spark, tmp_path):
    store = T.Store(spark, str(tmp_path))
    T.take_windows(store, parts(spark, [0, 1]), 0, 60)
    polls = spark.createDataFrame([("real", "u", "h", c, datetime.datetime(2024, 1, 1, 1), 3600, True) for c in ("system", "process", "network")], "dataset_kind string, user_id string, host_id string, collector string, observed_at timestamp, interval_seconds int, successful boolean")
    held = spark.createDataFrame([("s", "signal_for_dataset_kind", "real", None, None, "rare-process-v1", None, True, datetime.datetime(2025, 1, 1), datetime.datetime(2024, 1, 1))], "suppression_id string, scope string, dataset_kind string, user_id string, host_id string, signal_id string, fingerprint string, active boolean, expires_at timestamp, created_at timestamp")
    assert T.run_cycle(store, watch(observations=polls, suppressions=held, now="2024-06-01")) == 2
    rows = {r.window_start.hour: (r.status, r.suppressed_by, r.skip_reason) for r in store.evaluations.read().collect()}
    assert rows == {0: ("skipped", "s", "quality is insufficient"), 1: ("suppressed", "s", None)} and store.findings.read() is None


def test_log_records_of_odd_shapes_have_null_fields(spark):
    xml = '<Event><System><EventID>4625</EventID></System><EventData><Data Name="Status">0x1</Data><Data Name="Status">0x2</Data><Data/></EventData></Event>'
    bodies = [None, "", "{", "<Event><System>", "[]", xml, '{"EventID": 4624, "event_id": 1, "RecordID": 7, "Status": null, "status": "0x5"}']
    found = X.log_fields(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "no INT, body STRING")).orderBy("no").collect()
    assert [r.event_id for r in found] == [None] * 5 + ["4625", "4624"]
    assert [r.status for r in found] == [None] * 5 + ["0x1", "0x5"]
    assert [r.record_id for r in found] == [None] * 6 + ["7"]
