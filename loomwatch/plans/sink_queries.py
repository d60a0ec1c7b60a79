"""Queries over what sinks leave: versions that are swapped at once, and runs that come twice."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from loomwatch.functions import ids
from loomwatch.operators import detection as D, reports as R, scoring as M, validation as V, windows as W
from loomwatch.plans.detection_queries import INPUTS, WINDOW_ID
from loomwatch.plans.ingest_queries import RAW, VERSIONS, _checked, _versions
from loomwatch.plans.registry import KEY, QUALITY_SQL, TEL, observations_sql, query, tidy, windows_sql
from loomwatch.plans.report_queries import SCORED, _scored
from loomwatch.plans.windows_queries import quality, tel, whole_windows
from loomwatch.session import materialize, shared_folder
from loomwatch.sources.versioned import Table


def _table(spark: SparkSession, name: str, bounded: str | None = None) -> Table:
    return Table(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", bounded)


@query(f"{VERSIONS} SELECT {KEY}, process_count, created_at, 2 AS parts_kept FROM o WHERE window_start < TIMESTAMP '2024-01-10' UNION ALL SELECT {KEY}, process_count, created_at, 2 FROM n")
def s9_range_replace(spark, sf_dir):
    """Windows written day range by day range, then a range replaced in one step, twice; parts before the range are kept as they are."""
    old, new = _versions(spark, sf_dir)
    table, t = _table(spark, "windows", "window_start"), F.col("window_start")
    cuts = [F.lit(d).cast("timestamp") for d in ("2000-01-01", "2024-01-05", "2024-01-09", "2030-01-01")]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        table.append(old.where((t >= a) & (t < b)), f"load-{i}")
    before = {p.path for p in table.version().parts}
    for _ in range(2):
        table.replace_range(new, "range-1", "2024-01-10", "2030-01-01")
    kept = len(before & {p.path for p in table.version().parts})
    return tidy(table.read().withColumn("parts_kept", F.lit(kept)))


@query(f"{SCORED} SELECT 'run-' || dataset_kind AS scoring_run_id, {KEY}, split, score, risk_level FROM rs")
def s10_scored_windows(spark, sf_dir):
    """A scoring run a kind, one of them twice."""
    rows = materialize(_scored(spark, sf_dir).select(*W.KEYS, "split", "score", "risk_level"), "scored")
    table = _table(spark, "scored")
    for kind in ("real", "synthetic", "real"):
        table.append(rows.where(F.col("dataset_kind") == kind).select(F.lit(f"run-{kind}").alias("scoring_run_id"), "*"), f"run-{kind}")
    return tidy(table.read())


@query(f"{SCORED} SELECT * FROM an")
def s12_anomalies(spark, sf_dir):
    """The list of anomalies after two runs: the later one stands in place of the first; the highest score first."""
    found = materialize(M.anomalies(_scored(spark, sf_dir)).select(*W.KEYS, "split", "score", "risk_level", "explanation"), "found")
    table = _table(spark, "anomalies")
    table.replace_all(found.where("risk_level <> 'low'"), "run-1")
    table.replace_all(found, "run-2")
    return tidy(table.read().orderBy(F.desc("score"), *W.KEYS))


@query(f"""WITH {TEL}, {windows_sql()}, {observations_sql()}, {QUALITY_SQL}, r(run_id, until) AS (VALUES ('run-1', TIMESTAMP '2024-01-15'), ('run-2', TIMESTAMP '2100-01-01')),
a AS (SELECT run_id, dataset_kind, count(*)::DOUBLE AS windows, round(avg(heartbeat_coverage), 6) AS coverage FROM qual, r WHERE window_start < until GROUP BY ALL)
SELECT run_id, dataset_kind, 'windows' AS metric, windows AS value FROM a UNION ALL SELECT run_id, dataset_kind, 'avg_heartbeat_coverage', coverage FROM a""")
def s14_quality_history(spark, sf_dir):
    """Summaries of two runs, one below the other; the second comes twice."""
    rows = materialize(quality(spark, sf_dir).select(*W.KEYS, "heartbeat_coverage"), "quality")
    table = _table(spark, "quality-history")
    for run, until in (("run-1", "2024-01-15"), ("run-2", "2100-01-01"), ("run-2", "2100-01-01")):
        found = R.average_coverage(rows.where(F.col("window_start") < F.lit(until).cast("timestamp")))
        metrics = F.create_map(F.lit("windows"), F.col("windows").cast("double"), F.lit("avg_heartbeat_coverage"), F.round("avg_heartbeat_coverage", 6))
        table.append(found.select(F.lit(run).alias("run_id"), "dataset_kind", F.explode(metrics).alias("metric", "value")), run)
    return tidy(table.read())


@query(f"""{RAW}, kept AS (SELECT 'events' AS "table", dataset_kind, event_type FROM tel WHERE dataset_kind <> 'real' OR ts >= TIMESTAMP '2024-01-15' UNION ALL SELECT 'quarantine', NULL, NULL FROM bad JOIN (SELECT event_id, ts FROM tel) USING (event_id) WHERE ts >= TIMESTAMP '2024-01-15')
SELECT "table", dataset_kind, event_type, count(*) AS n FROM kept GROUP BY ALL""")
def a13_retention_apply(spark, sf_dir):
    """What stays when real events and quarantined ones from before a day are deleted, each table in one step; synthetic events stay."""
    events, held = _table(spark, "events", "ts"), _table(spark, "quarantine", "ts")
    rows, bad = tel(spark, sf_dir), V.quarantined(_checked(spark, sf_dir)).select("event_id")
    events.append(rows, "load")
    held.append(bad.join(rows, "event_id").select("event_id", "ts"), "load")
    R.apply_retention(events, held, "2024-01-15", "retention-1")
    left = events.read().groupBy("dataset_kind", "event_type").agg(F.count("*").alias("n")).select(F.lit("events").alias("table"), "*")
    none = F.lit(None).cast("string")
    quarantined = held.read().agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("table"), none.alias("dataset_kind"), none.alias("event_type"), "n")
    return left.unionByName(quarantined.where("n > 0"))


@query(INPUTS.replace("WINDOW_ID", WINDOW_ID) + " SELECT 'first' AS run, count(*) AS evaluated FROM inp UNION ALL SELECT 'again', 0 UNION ALL SELECT 'changed input', count(*) FROM inp WHERE hour(window_start) % 2 = 1 UNION ALL SELECT 'other policy', count(*) FROM inp")
def d24_idempotent_runs(spark, sf_dir):
    """How many windows runs evaluate: the first, one after it, one after the input of some windows changed, one under another policy."""
    w = whole_windows(spark, sf_dir)
    w = materialize(w.withColumn("window_id", ids.window_id(60)).withColumn("model_id", F.lit(None).cast("string")), "inputs")
    odd = F.hour("window_start") % 2 == 1
    later = w.withColumn("process_count", F.when(odd, F.col("process_count") + 1).otherwise(F.col("process_count")))
    later = later.withColumn("feature_input_hash", W.input_hash(later))
    keys, done, counts = ["window_id", "feature_input_hash", "policy_hash", "model_id"], _table(spark, "evaluations"), []
    for run, rows, policy in (("first", w, "p1"), ("again", w, "p1"), ("changed input", later, "p1"), ("other policy", later, "p2")):
        rows = rows.withColumn("policy_hash", F.lit(policy))
        seen = done.read()
        open_ = materialize(rows if seen is None else D.pending(rows, seen.select(*keys)), "open")
        done.append(open_.select(*keys), run)
        counts.append((run, open_.count()))
    return spark.createDataFrame(counts, "run string, evaluated long")
