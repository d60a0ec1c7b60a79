"""Snapshots of windows, their splits, and statistics of features and scores, for all profiles at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.windows import FEATURES, KEYS, PROFILE

TRAIN, CALIBRATION = 0.7, 0.15
#: The least rows of train, calibration and test.
LEAST = (32, 12, 12)
SMALL = 1e-6


def snapshot(windows: DataFrame) -> DataFrame:
    """Windows fit for learning (real: good; synthetic: degraded too) with row_index from 0."""
    fit = (F.col("quality_status") == "good") | ((F.col("dataset_kind") == "synthetic") & (F.col("quality_status") == "degraded"))
    order = Window.partitionBy(*PROFILE).orderBy("window_start")
    return windows.where(fit).withColumn("row_index", (F.row_number().over(order) - 1).cast("long"))


def split(rows: DataFrame) -> DataFrame:
    """``rows`` of a snapshot with split (train, calibration, test by time) and enough."""
    n = F.count("*").over(Window.partitionBy(*PROFILE))
    cut, second = F.floor(F.lit(TRAIN) * n), F.floor(F.lit(CALIBRATION) * n)
    part = F.when(F.col("row_index") < cut, "train").when(F.col("row_index") < cut + second, "calibration").otherwise("test")
    enough = (cut >= LEAST[0]) & (second >= LEAST[1]) & (n - cut - second >= LEAST[2])
    return rows.withColumn("split", part).withColumn("enough", enough)


def long_features(rows: DataFrame, *also: str) -> DataFrame:
    """(keys, also, feature, x): a row a feature."""
    return rows.unpivot([*KEYS, *also], FEATURES, "feature", "x")


def fit_preprocessor(train: DataFrame) -> DataFrame:
    """M6: mean, std, median and iqr of each profile's features; spreads under 1e-6 are 1."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = long_features(train).groupBy(*PROFILE, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"), q.alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    return found.select(
        *PROFILE, "feature", "mean", F.when(F.col("s") < SMALL, 1.0).otherwise(F.col("s")).alias("std"),
        F.col("q")[1].alias("median"), F.when(iqr < SMALL, 1.0).otherwise(iqr).alias("iqr"),
    )


def deviations(rows: DataFrame, fitted: DataFrame, k: int = 5) -> DataFrame:
    """M7, M8: standardised values, and each window's ``k`` largest deviations from the median."""
    joined = long_features(rows).join(fitted, [*PROFILE, "feature"])
    z, d = (F.col("x") - F.col("mean")) / F.col("std"), F.round((F.col("x") - F.col("median")) / F.col("iqr"), 6)
    entry = F.struct((-F.abs(d)).alias("o"), "feature", d.alias("deviation"), z.alias("z"))
    top = joined.groupBy(*KEYS).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))  # twelve a window
    return top.select(*KEYS, F.posexplode("top").alias("pos", "t")).select(
        *KEYS, F.col("pos").alias("rank"), "t.feature", "t.deviation", "t.z", F.when(F.col("t.deviation") < 0, "below").otherwise("above").alias("direction")
    )


def calibrate(scores: DataFrame, by: list[str], rate: float, least: int = 12) -> DataFrame:
    """The (1 - rate) quantile that is a score, the higher one, and the share that reaches it."""
    per = Window.partitionBy(*by)
    ranked = scores.withColumn("n", F.count("*").over(per)).withColumn("r", F.row_number().over(per.orderBy("score")))
    ranked = ranked.where(F.col("n") >= least).withColumn("at", 1 + F.ceil((F.col("n") - 1) * F.lit(1 - rate)))
    threshold = ranked.where("r = at").select(*by, F.col("score").alias("threshold"))
    joined = ranked.join(threshold, by)
    return joined.groupBy(*by).agg(
        F.first("threshold").alias("threshold"), F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.median("score").alias("median"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("flagged_rate"),
    )


def drift(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Mean shift in reference deviations and population stability of each feature.

    Edges are the distinct deciles of the reference, the outer ones a little wider; target rows
    outside drop out of the shares, which are at least 1e-6.
    """
    x = F.round("x", 9)
    deciles = F.percentile(x, F.array(*[F.lit(i / 10) for i in range(11)]))
    base = long_features(reference).groupBy(*PROFILE, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"), deciles.alias("d"))
    edges = F.array_distinct(F.transform("d", lambda e: F.round(e, 9)))
    c = F.col("e")[0]
    gap = F.greatest(F.abs(c) * SMALL, F.lit(SMALL))
    wide = F.transform("e", lambda e, i: F.when(i == 0, e - 1e-9).when(i == F.size("e") - 1, e + 1e-9).otherwise(e))
    base = base.withColumn("e", edges).withColumn("e", F.when(F.size("e") == 1, F.array(c - gap, c + gap)).otherwise(wide))

    def binned(rows: DataFrame, name: str) -> DataFrame:
        met = long_features(rows).withColumn("x", x).join(base.select(*PROFILE, "feature", "e"), [*PROFILE, "feature"])
        last = F.size("e") - 1
        inside = met.where((F.col("x") >= F.col("e")[0]) & (F.col("x") <= F.element_at("e", -1)))
        bins = F.least(F.size(F.filter("e", lambda e: e <= F.col("x"))), last)
        return inside.groupBy(*PROFILE, "feature", bins.alias("bin")).agg(F.count("*").alias(name))

    keys = [*PROFILE, "feature", "bin"]
    every = base.select(*PROFILE, "feature", F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("bin"))
    counts = every.join(binned(reference, "a"), keys, "left").join(binned(target, "b"), keys, "left").fillna(0, ["a", "b"])
    per = Window.partitionBy(*PROFILE, "feature")

    def share(name: str) -> Column:
        return F.greatest(F.col(name) / F.greatest(F.sum(name).over(per), F.lit(1)), F.lit(SMALL))

    psi = counts.withColumn("p", share("a")).withColumn("q", share("b"))
    psi = psi.groupBy(*PROFILE, "feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))
    now = long_features(target).groupBy(*PROFILE, "feature").agg(F.avg("x").alias("now"))
    spread = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return base.join(now, [*PROFILE, "feature"]).join(psi, [*PROFILE, "feature"]).select(
        *PROFILE, "feature", (F.abs(F.col("now") - F.col("mean")) / spread).alias("shift"), "psi"
    )


QUANTILES = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def quantiles(x: Column) -> Column:
    """The four linear percentiles as an array."""
    return F.percentile(x, F.array(*map(F.lit, QUANTILES.values())))


def feature_distribution(rows: DataFrame, k: int = 5) -> DataFrame:
    """Mean, std and percentiles of each profile's ``k`` features that spread most (compared at six decimals, then by name)."""
    found = long_features(rows).groupBy(*PROFILE, "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), quantiles(F.col("x")).alias("q"))
    place = F.row_number().over(Window.partitionBy(*PROFILE).orderBy(F.round("std", 6).desc(), "feature"))  # twelve a profile
    named = [F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)]
    return found.withColumn("place", place).where(F.col("place") <= k).select(*PROFILE, "place", "feature", "mean", "std", *named)


def drift_report(reference: DataFrame, target: DataFrame, k: int = 5, least: int = 12) -> DataFrame:
    """The ``k`` features of each profile that moved most, with shift, stability and the percentiles of both sides.

    Profiles with under ``least`` rows on a side have no row; ``drift_summary`` tells them.
    """
    enough = [rows.groupBy(*PROFILE).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*PROFILE) for rows in (reference, target)]
    both = enough[0].join(enough[1], PROFILE)
    sides = [long_features(rows).groupBy(*PROFILE, "feature").agg(quantiles(F.col("x")).alias(name)) for rows, name in ((reference, "r"), (target, "t"))]
    joined = drift(reference, target).join(both, PROFILE).join(sides[0], [*PROFILE, "feature"]).join(sides[1], [*PROFILE, "feature"])
    place = F.row_number().over(Window.partitionBy(*PROFILE).orderBy(F.round("shift", 6).desc(), "feature"))  # twelve a profile
    named = [F.col(side)[i].alias(f"{prefix}_{n}") for side, prefix in (("r", "train"), ("t", "target")) for i, n in enumerate(QUANTILES)]
    return joined.withColumn("place", place).where(F.col("place") <= k).select(*PROFILE, "place", "feature", "shift", "psi", *named)


def drift_summary(reference: DataFrame, target: DataFrame, thresholds: DataFrame, least: int = 12) -> DataFrame:
    """Status, flagged rates of both sides, their difference and score percentiles; the sides have the profile and score."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        flagged = F.avg((F.col("score") >= F.col("threshold")).cast("double"))
        met = rows.join(thresholds.select(*PROFILE, "threshold"), PROFILE)
        return met.groupBy(*PROFILE).agg(F.count("*").alias(f"{name}_count"), flagged.alias(f"{name}_flagged_rate"), quantiles(F.col("score")).alias(f"{name}_q"))

    joined = side(reference, "reference").join(side(target, "target"), PROFILE, "full_outer").fillna(0, ["reference_count", "target_count"])
    few = (F.col("reference_count") < least) | (F.col("target_count") < least)

    def told(c: Column) -> Column:
        return F.when(~few, c)

    named = [told(F.col(f"{side}_q")[i]).alias(f"{side}_{n}") for side in ("reference", "target") for i, n in enumerate(QUANTILES)]
    return joined.select(
        *PROFILE, F.when(few, "insufficient_data").otherwise("ok").alias("status"), "reference_count", "target_count", *[told(F.col(c)).alias(c) for c in ("reference_flagged_rate", "target_flagged_rate")],
        told(F.col("target_flagged_rate") - F.col("reference_flagged_rate")).alias("flagged_rate_difference"), *named,
    )


def ranking_quality(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision, recall, f1, false-positive rate, ROC-AUC and average precision.

    ``scored`` has score, flagged and positive. Rows are counted by score before any ordering.
    """
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    one = F.col("positive").cast("long")
    hit = (F.col("positive") & F.col("flagged")).cast("long")
    false = (~F.col("positive") & F.col("flagged")).cast("long")
    per = scored.groupBy(*by, "score").agg(F.sum(one).alias("p"), F.sum(1 - one).alias("n"), F.sum(hit).alias("tp"), F.sum(false).alias("fp"))
    group = Window.partitionBy(*by)
    up = group.orderBy(F.desc("score"))
    per = per.select(
        *by, "p", "n", "tp", "fp", F.sum("p").over(up).alias("cp"), F.sum("n").over(up).alias("cn"), F.sum("n").over(group).alias("all_n"),
    )
    out = per.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("p").alias("pos"), F.sum("n").alias("neg"),
        F.sum(F.col("p") * (F.col("all_n") - F.col("cn") + F.col("n") / 2)).alias("u"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("ap"),
    )
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    return out.select(
        *by, "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"),
        precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(F.col("fp"), F.col("neg")).alias("fpr"),
        F.try_divide("u", F.col("pos") * F.col("neg")).alias("roc_auc"), F.try_divide("ap", F.col("pos")).alias("pr_auc"),
    )
