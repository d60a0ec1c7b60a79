"""Checks of snapshots, splits and models, and comparisons with what is stored now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.windows import FEATURES, PROFILE

TOLERANCE = 1e-9


def snapshot_violations(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(profile, check, n) of what is wrong in a snapshot; no row for a sound one.

    ``rows`` has window_id, window_start, window_end, row_index and the features; ``manifest`` has a
    row a profile with window_count, first_start and last_end.
    """
    order = Window.partitionBy(*PROFILE).orderBy("row_index", "window_id")
    odd = reduce(lambda a, b: a | b, [F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf")) for f in FEATURES])
    placed = rows.withColumn("_n", F.row_number().over(order) - 1).withColumn("_before", F.lag("window_start").over(order)).withColumn("_odd", odd)
    found = placed.groupBy(*PROFILE).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_n") != F.col("row_index")).alias("row_index"),
        (F.count("*") - F.count_distinct("window_id")).alias("window_id"), F.count_if(F.col("_before") > F.col("window_start")).alias("order"),
        F.count_if("_odd").alias("features"), F.min_by("window_start", "_n").alias("_first"), F.max_by("window_end", "_n").alias("_last"),
    )
    joined = found.join(manifest.select(*PROFILE, "window_count", "first_start", "last_end"), PROFILE, "full_outer")
    one = F.lit(1).cast("long")
    checks = {
        "manifest": F.when(F.col("window_count").isNull() | F.col("rows").isNull(), one),
        "window_count": F.when(F.col("rows") != F.col("window_count"), F.abs(F.col("rows") - F.col("window_count"))),
        "row_index": F.col("row_index"), "window_id": F.col("window_id"), "order": F.col("order"), "features": F.col("features"),
        "range_start": F.when(F.col("_first") != F.col("first_start"), one), "range_end": F.when(F.col("_last") != F.col("last_end"), one),
    }
    rows_of = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for name, n in checks.items()])
    return joined.select(*PROFILE, F.explode(rows_of).alias("c")).where("c.n > 0").select(*PROFILE, "c.check", "c.n")


def row_digest(columns: list[Column]) -> Column:
    """A row's digest over the texts given, in order."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def content_fingerprint(rows: DataFrame, digest: Column) -> DataFrame:
    """M2: (profile, rows, fingerprint): the sum of four parts of each row's digest, so that order plays no part and nothing is gathered."""
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")).cast("string") for i in range(4)]
    return rows.groupBy(*PROFILE).agg(F.count("*").alias("rows"), F.concat_ws("-", *parts).alias("fingerprint"))


def split_violations(rows: DataFrame) -> DataFrame:
    """M4: (profile, check) where splits overlap in time, come in the wrong order or share a window."""
    def edge(of: Column, name: str) -> Column:
        return of.alias(name)

    def at(split: str) -> Column:
        return F.when(F.col("split") == split, F.col("window_start"))

    found = rows.groupBy(*PROFILE).agg(
        edge(F.max(at("train")), "t"), edge(F.min(at("calibration")), "c0"), edge(F.max(at("calibration")), "c1"), edge(F.min(at("test")), "s"),
        (F.count("*") - F.count_distinct("window_id")).alias("twice"),
    )
    checks = F.array_compact(F.array(
        F.when(F.col("t") >= F.col("c0"), "train and calibration"), F.when(F.col("c1") >= F.col("s"), "calibration and test"),
        F.when(F.col("t") >= F.col("s"), "train and test"), F.when(F.col("twice") > 0, "window in two splits"),
    ))
    return found.select(*PROFILE, F.explode(checks).alias("check"))


def compatibility(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """M5: models with the first reason why they don't go with their dataset; null where they do."""
    d = datasets.select("dataset_id", *[F.col(c).alias(f"_{c}") for c in ("dataset_kind", "profile_key", "schema_version", "feature_names")])
    joined = models.join(d, "dataset_id", "left")
    reason = F.when(F.col("_dataset_kind").isNull(), "no such dataset")
    for c, text in (("dataset_kind", "dataset kind differs"), ("profile_key", "profile differs"), ("schema_version", "feature schema differs"), ("feature_names", "feature names differ")):
        reason = reason.when(F.col(c) != F.col(f"_{c}"), text)
    return joined.select(*models.columns, reason.alias("mismatch"))


def snapshot_drift(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """Each snapshot window with the first difference from its current form; null where there is none.

    Both have window_id, the profile, feature_schema, window_start, window_end, quality_status and the features.
    """
    kept = ["feature_schema", "window_start", "window_end", "quality_status", *FEATURES]
    now = current.select("window_id", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in (*PROFILE, *kept)])
    joined = snapshot.join(now, "window_id", "left")

    def differs(*columns: str) -> Column:
        return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])

    drifted = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) > TOLERANCE, F.lit(True)) for f in FEATURES])
    reason = (
        F.when(F.col("_there").isNull(), "missing")
        .when(differs(*PROFILE), "profile mismatch")
        .when(differs("feature_schema"), "feature schema mismatch")
        .when(differs("window_start", "window_end"), "range mismatch")
        .when(differs("quality_status"), "quality revision mismatch")
        .when(drifted, "feature revision mismatch")
    )
    return joined.select("window_id", *PROFILE, "window_start", reason.alias("mismatch"))


def in_snapshot(windows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The windows whose ids a snapshot has."""
    return windows.join(snapshot.select("window_id"), "window_id", "left_semi")


def backfill(
    windows: DataFrame, dataset_kind: str | None = None, start: str | None = None, end: str | None = None, snapshot: DataFrame | None = None, drift: DataFrame | None = None
) -> DataFrame:
    """The windows to evaluate again: a kind's in [start, end), or exactly those of the profiles' snapshots.

    A profile's snapshot is refused whole if ``drift`` (``snapshot_drift``) has a mismatch in it.
    """
    if snapshot is not None:
        if drift is None:
            raise ValueError("a snapshot is taken only as verified against the windows now")
        refused = drift.where("mismatch is not null").select(*PROFILE).distinct()
        return in_snapshot(windows, snapshot.join(refused, PROFILE, "left_anti"))
    if start is None or end is None:
        raise ValueError("a backfill has an explicit range or a snapshot")
    t = F.col("window_start")
    kind = F.lit(True) if dataset_kind is None else F.col("dataset_kind") == dataset_kind
    return windows.where(kind & (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))
