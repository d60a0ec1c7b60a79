"""Scores of windows under a fitted preprocessor, their risk, records, and what follows from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.snapshots import LEAST, TRAIN, long_features
from loomwatch.operators.windows import KEYS, PROFILE

# Score over threshold below which an anomaly has each level, and the order of levels.
RATIOS = ((1.25, "low"), (1.75, "medium"), (2.5, "high"))
LEVELS = ("normal", "low", "medium", "high", "critical")
FALLBACK_CUT, FALLBACK_LEAST = 0.62, 8


def deviation_scores(rows: DataFrame, fitted: DataFrame, *also: str, k: int = 3) -> DataFrame:
    """(keys, also, score, top): the mean squared standardised feature, and the ``k`` features that bring the most.

    Shares are compared at nine decimals, so that engines agree on ties (which go to the first name).
    """
    joined = long_features(rows, *also).join(fitted, [*PROFILE, "feature"])
    z = (F.col("x") - F.col("mean")) / F.col("std")
    entry = F.struct((-F.round(z * z, 9)).alias("o"), "feature")
    found = joined.groupBy(*KEYS, *also).agg(F.avg(z * z).alias("score"), F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("t"))  # twelve a window
    return found.select(*KEYS, *also, F.round("score", 6).alias("score"), F.transform("t", lambda e: e["feature"]).alias("top"))


def classify_risk(score: Column, threshold: Column) -> Column:
    """Normal under the threshold; beyond, the level by the ratio."""
    ratio = F.try_divide(score, threshold)
    chain = F.when(score < threshold, "normal")
    for most, level in RATIOS:
        chain = chain.when(ratio < most, level)
    return chain.otherwise("critical")


def with_risk(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores of the profiles that have a threshold, with risk_level."""
    joined = scores.join(thresholds.select(*PROFILE, "threshold"), PROFILE)
    return joined.withColumn("risk_level", classify_risk(F.col("score"), F.col("threshold")))


def anomalies(scored: DataFrame) -> DataFrame:
    """Windows at or over their threshold, with the features behind them in words."""
    text = F.concat(F.lit("score "), F.col("score").cast("decimal(20,6)").cast("string"), F.lit(" driven by "), F.array_join("top", ", "))
    return scored.where("score >= threshold").withColumn("explanation", text)


def anomaly_summary(found: DataFrame) -> DataFrame:
    """Anomalies by risk, the highest score and the latest."""
    return found.groupBy("risk_level").agg(F.count("*").alias("n"), F.max("score").alias("max_score"), F.max("window_start").alias("latest"))


def old_threshold(train_scores: DataFrame) -> DataFrame:
    """The linear 98 % quantile and one population deviation more."""
    return train_scores.groupBy(*PROFILE).agg((F.percentile("score", F.lit(0.98)) + F.stddev_pop("score")).alias("threshold"))


def unlabelled_evaluation(scored: DataFrame) -> DataFrame:
    """Flagged rates of calibration and test, their difference, and percentiles of the test scores."""
    def rate(split: str) -> Column:
        return F.avg(F.when(F.col("split") == split, (F.col("score") >= F.col("threshold")).cast("double")))

    test = F.when(F.col("split") == "test", F.col("score"))
    at = F.percentile(test, F.array(*map(F.lit, (0.05, 0.5, 0.95, 0.99))))
    found = scored.groupBy(*PROFILE).agg(rate("calibration").alias("calibration_rate"), rate("test").alias("flagged_rate"), at.alias("q"))
    names = ("p05", "p50", "p95", "p99")
    return found.select(*PROFILE, "calibration_rate", "flagged_rate", F.abs(F.col("flagged_rate") - F.col("calibration_rate")).alias("stability"), *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def match_scenarios(scenarios: DataFrame, found: DataFrame) -> DataFrame:
    """Scenarios (name, profile, window_start) with the anomalies of their window: count, best score, highest risk."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk_level"))
    joined = scenarios.join(found.select(*KEYS, "score", rank.cast("int").alias("_r")), KEYS, "left")
    out = joined.groupBy("name", *KEYS).agg(F.count("score").alias("match_count"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"), F.max("_r").alias("_r"))
    level = F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), F.col("_r") - 1), F.lit("none"))
    return out.select("name", *KEYS, "match_count", "best_score", level.alias("max_risk_level"), (F.col("match_count") > 0).alias("detected"))


def scenario_recall(matched: DataFrame) -> DataFrame:
    """The share of each kind's scenarios that were detected, and whether all were."""
    return matched.groupBy("dataset_kind").agg(F.avg(F.col("detected").cast("double")).alias("recall"), F.count_if(~F.col("detected")).alias("missed"), F.every("detected").alias("all_detected"))


def boundary_split(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Windows before a profile's first labelled one are train (70 %) and calibration, the rest test; with enough.

    Profiles without a labelled window have no such split.
    """
    first = labelled.groupBy(*PROFILE).agg(F.min("window_start").alias("_first"))
    per = Window.partitionBy(*PROFILE)
    before = F.col("window_start") < F.col("_first")
    placed = rows.join(first, PROFILE).withColumn("_n", F.count_if(before).over(per)).withColumn("_all", F.count("*").over(per))
    placed = placed.withColumn("_i", F.row_number().over(per.orderBy("window_start")) - 1)
    cut = F.floor(F.lit(TRAIN) * F.col("_n"))
    part = F.when(F.col("_i") < cut, "train").when(before, "calibration").otherwise("test")
    enough = (cut >= LEAST[0]) & (F.col("_n") - cut >= LEAST[1]) & (F.col("_all") - F.col("_n") >= LEAST[2])
    return placed.withColumn("split", part).withColumn("enough", enough).drop("_first", "_n", "_all", "_i")


def fallback_range(rows: DataFrame) -> DataFrame:
    """The last part of each profile's windows, from max(8, 62 %) on."""
    per = Window.partitionBy(*PROFILE)
    cut = F.greatest(F.lit(FALLBACK_LEAST), F.floor(F.lit(FALLBACK_CUT) * F.count("*").over(per)))
    return rows.withColumn("_i", F.row_number().over(per.orderBy("window_start")) - 1).withColumn("_cut", cut).where("_i >= _cut").drop("_i", "_cut")


def rank_candidates(evaluations: DataFrame, by: list[str]) -> DataFrame:
    """Candidates by recall, then false-positive rate, average precision and inference time."""
    order = Window.partitionBy(*by).orderBy(F.desc("recall"), "fpr", F.desc("pr_auc"), "inference_seconds", "model_id")
    return evaluations.withColumn("place", F.row_number().over(order))


def latest_per(rows: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """Each group's newest row."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")


def listed(rows: DataFrame, newest: str, tie: str, limit: int | None = None, **equal: str | None) -> DataFrame:
    """Rows that equal what is asked for (None: anything), the newest first, ``limit`` of them if one is asked for."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    ordered = rows.orderBy(F.desc(newest), F.desc(tie))
    return ordered if limit is None else ordered.limit(limit)
