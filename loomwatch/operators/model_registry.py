"""The models of each profile, from training run to champion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.folds import in_order
from loomwatch.operators.windows import FEATURES, PROFILE

# Why a request is refused.
UNCONFIRMED = {"promote": "promotion requires confirmation", "recommend": "recommendation requires confirmation", "retire": "retirement requires confirmation", "rollback": "rollback requires confirmation"}
UNKNOWN, UNVERIFIED, UNEVALUATED = "model is not registered", "model is not verified", "model evaluation is required before promotion"
MOST_FALSE = 0.15
RUN_FIELDS = {
    "dataset_id": "candidate dataset id does not match training run", "dataset_hash": "candidate dataset hash does not match training run", "dataset_kind": "candidate dataset kind does not match training run",
    "profile_key": "candidate profile does not match training run", "split_id": "candidate split does not match training run",
}


def _refusal(action: str, status: str, row: dict) -> str | None:
    """Why a request is refused in this status of its model; None where it is accepted."""
    if action not in UNCONFIRMED:
        return "unknown action"
    if not row["confirm"]:
        return UNCONFIRMED[action]
    if not row["registered"]:
        return UNKNOWN
    wrong = {
        "promote": "model is already champion" if status == "champion" else None if status in ("candidate", "recommended") else f"{status} model cannot be promoted",
        "rollback": None if status == "retired" else "rollback is allowed only for retired models",
        "retire": None if status == "champion" else "only champion models can be retired",
        "recommend": None if status == "candidate" else "only candidate models can be recommended",
    }[action]
    unverified = None if row["verified"] else UNVERIFIED
    unevaluated = None if row["evaluated"] or action == "retire" else UNEVALUATED
    return (unverified or wrong if action == "recommend" else wrong or unverified) or unevaluated


def _step(state: dict, row: dict) -> tuple:
    """(refused, previous, champion): ``state`` has the champion and the status of each model that a move has changed."""
    action, model, before = row["action"], row["model_id"], state.get("champion")
    moved = state.setdefault("moved", {})
    refused = _refusal(action, moved.get(model, row["lifecycle_status"] or "candidate"), row)
    if refused:
        return refused, None, before
    if action == "recommend":
        moved[model] = "recommended"
        return None, None, before
    if before is not None:
        moved[before] = "retired"
    state["champion"] = None if action == "retire" else model
    moved[model] = "retired" if action == "retire" else "champion"
    return None, before, state["champion"]


def registry_moves(log: DataFrame, models: DataFrame) -> DataFrame:
    """``log`` with refused (why, or null), previous (the champion an accepted move replaced) and champion (after it).

    ``log`` has a request a row: the profile, request_id, at, model_id, action (recommend, promote,
    retire, rollback) and confirm. ``models`` has the registered ones of each profile with verified,
    evaluated and, if it is not candidate, lifecycle_status. A request is judged by what the accepted
    ones before it in its profile left; a promotion retires the champion, and a rollback brings a
    retired model back.
    """
    if "lifecycle_status" not in models.columns:
        models = models.withColumn("lifecycle_status", F.lit("candidate"))
    known = models.select(*PROFILE, "model_id", "verified", "evaluated", "lifecycle_status", F.lit(True).alias("registered"))
    joined = log.join(known, [*PROFILE, "model_id"], "left").select(*log.columns, "verified", "evaluated", "lifecycle_status", "registered")
    out = {"refused": "string", "previous": "string", "champion": "string"}
    return in_order(joined, PROFILE, ["at", "request_id"], _step, out).select(*log.columns, *out)


def champions(moves: DataFrame) -> DataFrame:
    """(profile, model_id, since): the champion that the moves left, with the last accepted move that made it one."""
    made = moves.where(F.col("refused").isNull() & F.col("action").isin("promote", "rollback", "retire"))
    last = F.max_by(F.struct("champion", F.col("at").alias("since")), F.struct("at", "request_id")).alias("c")
    return made.groupBy(*PROFILE).agg(last).select(*PROFILE, F.col("c.champion").alias("model_id"), "c.since").where("model_id is not null")


def lifecycle(models: DataFrame, moves: DataFrame) -> DataFrame:
    """The registered models with the status that the accepted moves left."""
    ok = moves.where("refused is null")
    to = F.when(F.col("action") == "retire", "retired").when(F.col("action") == "recommend", "recommended").otherwise("champion")
    other = F.when(F.col("action").isin("promote", "rollback") & F.col("previous").isNotNull(), F.struct(F.col("previous").alias("model_id"), F.lit("retired").alias("status")))
    changes = F.array_compact(F.array(F.struct("model_id", to.alias("status")), other))
    rows = ok.select(*PROFILE, "at", "request_id", F.explode(changes).alias("c"))
    last = rows.groupBy(*PROFILE, F.col("c.model_id").alias("model_id")).agg(F.max_by("c.status", F.struct("at", "request_id")).alias("_s"))
    start = F.col("lifecycle_status") if "lifecycle_status" in models.columns else F.lit("candidate")
    joined = models.join(last, [*PROFILE, "model_id"], "left")
    return joined.withColumn("lifecycle_status", F.coalesce("_s", start)).drop("_s")


def auto_promoted(evaluations: DataFrame) -> DataFrame:
    """The recommended model of a synthetic profile where its recall of scenarios is whole and at most 15 % of the rest is flagged."""
    gate = (F.col("dataset_kind") == "synthetic") & (F.col("scenario_recall") == 1.0) & (F.coalesce("fpr", F.lit(1.0)) <= MOST_FALSE)
    return evaluations.where(F.col("recommended") & gate)


def comparison(models: DataFrame, by: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs of a group that cannot be compared, the order of each group whose members all can be).

    Two models compare if all of ``key`` (dataset, split, profile, schema, feature order) are equal,
    nulls equal. A group is ordered only if it is synthetic, every member is verified and no pair
    fails: by recall of scenarios, then fewest false alarms, average precision, time.
    """
    same = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key])
    keyed = models.withColumn("_key", same)
    a = keyed.select(*by, F.col("model_id").alias("left_model_id"), F.col("_key").alias("_a"))
    b = keyed.select(*by, F.col("model_id").alias("right_model_id"), F.col("_key").alias("_b"))
    failed = a.join(b, by).where("left_model_id < right_model_id and _a <> _b").drop("_a", "_b")  # models asked to be compared: few a group
    group = Window.partitionBy(*by)
    whole = (F.min("_key").over(group) == F.max("_key").over(group)) & F.every(F.col("verified") & (F.col("dataset_kind") == "synthetic")).over(group)
    order = group.orderBy(F.coalesce("scenario_recall", F.lit(0.0)).desc(), F.coalesce("fpr", F.lit(1.0)), F.coalesce("pr_auc", F.lit(0.0)).desc(), F.coalesce("inference_seconds", F.lit(float("inf"))), "model_id")
    ranked = keyed.withColumn("_whole", whole).where("_whole").withColumn("place", F.row_number().over(order))
    return failed, ranked.drop("_key", "_whole")


def parameter_violations(preprocessors: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, check) of what is wrong in a model's parameters; no row for a sound one.

    ``preprocessors`` has model_id, position, feature, mean, std, median and iqr; ``models`` has
    model_id, input_width, threshold and, for train, calibration and test, start, end and count of
    the split and the count of its rows (train_start, ..., test_rows).
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda e: e["feature"])  # twelve a model
    odd = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in ("mean", "std", "median", "iqr")])
    found = preprocessors.groupBy("model_id").agg(
        names.alias("names"), F.count_if(odd).alias("odd"), F.count_if((F.col("std") <= 0) | (F.col("iqr") <= 0)).alias("flat"), F.count("*").alias("values")
    )
    j = models.join(found, "model_id", "left")
    parts = ("train", "calibration", "test")

    def bad(a: Column) -> Column:
        return F.coalesce(a, F.lit(True))

    disordered = reduce(lambda a, b: a | b, [bad(F.col(f"{p}_start") > F.col(f"{p}_end")) for p in parts] + [bad(F.col(f"{a}_end") > F.col(f"{b}_start")) for a, b in zip(parts, parts[1:], strict=False)])
    miscounted = reduce(lambda a, b: a | b, [bad(F.col(f"{p}_count") != F.col(f"{p}_rows")) for p in parts])
    checks = {
        "feature names or order": bad(F.col("names") != F.array(*map(F.lit, FEATURES))), "twelve values": bad(F.col("values") != len(FEATURES)), "finite values": bad(F.col("odd") > 0),
        "spread above zero": bad(F.col("flat") > 0), "input width": bad(F.col("input_width") != len(FEATURES)), "finite threshold": bad(F.isnan("threshold") | (F.abs("threshold") == float("inf"))),
        "split ranges in order": disordered, "split counts": miscounted,
    }
    said = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]))
    return j.select("model_id", F.explode(said).alias("check"))


def finalise_runs(runs: DataFrame, claims: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with their outcome, models after it).

    ``claims`` has (training_run_id, model_id): the candidates that a run says it has. A running run
    succeeds if it claims any, all exist in it, none is finalised, and all agree with it on dataset,
    hash, kind, profile and split: one that fails fails the run, and with a run fall all its models,
    claimed or not. Models of a run that succeeds and that it claims are finalised.
    """
    m = models.select(
        F.col("training_run_id").alias("_run"), "model_id", *[F.col(f).alias(f"m_{f}") for f in RUN_FIELDS], F.col("verified_at").alias("_verified"), F.lit(True).alias("_there")
    )
    r = runs.select("training_run_id", "status", *[F.col(f).alias(f"r_{f}") for f in RUN_FIELDS])
    mine = claims.distinct().withColumnRenamed("training_run_id", "_run")
    c = r.join(mine.withColumn("_claimed", F.lit(True)).withColumnRenamed("model_id", "_model"), F.col("training_run_id") == F.col("_run"), "left").drop("_run")
    c = c.join(m, (F.col("_run") == F.col("training_run_id")) & (F.col("model_id") == F.col("_model")), "left")
    fails = [(F.col("_claimed").isNull(), "training run finalization requires at least one model"), (F.col("status") != "running", "training run is not running"), (F.col("_there").isNull(), "not all candidate model rows exist"), (F.col("_verified").isNotNull(), "candidate model is already finalized")]
    fails += [(~F.col(f"m_{f}").eqNullSafe(F.col(f"r_{f}")), text) for f, text in RUN_FIELDS.items()]
    nth = reduce(lambda chain, x: chain.when(x[1][0], F.lit(x[0])), list(enumerate(fails))[1:], F.when(fails[0][0], F.lit(0)))
    verdict = c.withColumn("_nth", nth).groupBy("training_run_id").agg(F.min("_nth").alias("_nth"))
    texts = F.array(*[F.lit(text) for _, text in fails])
    judged = runs.join(verdict, "training_run_id").withColumn("reason", F.get(texts, F.col("_nth"))).drop("_nth")
    was = F.col("status") == "running"
    judged = judged.withColumn("status", F.when(~was, F.col("status")).when(F.col("reason").isNull(), "success").otherwise("failed"))
    fate = judged.select("training_run_id", F.col("status").alias("_status"), F.col("reason").isNull().alias("_whole"))
    claimed = claims.distinct().withColumn("_claimed", F.lit(True))
    kept = models.join(fate, "training_run_id", "left").where(F.coalesce(F.col("_status") != "failed", F.lit(True))).join(claimed, ["training_run_id", "model_id"], "left")
    kept = kept.withColumn("finalised", F.col("verified_at").isNotNull() | F.coalesce(F.col("_whole") & F.col("_claimed"), F.lit(False)))
    return judged, kept.select(*models.columns, "finalised")
