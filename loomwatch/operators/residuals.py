"""What a profile's main directions leave of a window.

The model of a profile reproduces standardised features from their projection on ``LATENT``
directions: the linear form of a bottleneck of that width. Second moments are one aggregate of 78
sums; directions are found inside the profile's row by squaring the matrix, which doubles the number
of power steps each time, and taking what was found out of it. No task solves for more than the
twelve by twelve numbers of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.operators.windows import FEATURES, KEYS, PROFILE
from loomwatch.session import materialize

# Fixed value: the width of the bottleneck.
LATENT = 4
#: So many squarings are 2^24 power steps: directions whose spreads differ by a millionth come apart.
SQUARINGS = 24
TOP = 5
#: Spread that is left below this is rounding, and has no direction.
NOTHING = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda row, i: F.get(row, i)), F.lit(0.0), lambda s, x: s + x)


def _square(m: Column) -> Column:
    """The square of a symmetric matrix, over its trace squared; zeros stay zeros."""
    by = _trace(m)
    return F.transform(m, lambda a: F.transform(m, lambda b: F.when(by > 0, dot(a, b) / (by * by)).otherwise(0.0)))


def direction(m: Column, squarings: int = SQUARINGS) -> Column:
    """The direction of the greatest spread, of length 1; zeros where nothing is left."""
    power = F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), m, lambda a, _: _square(a))
    # The row of the greatest diagonal entry is the direction, up to its length.
    longest = F.array_max(F.transform(power, lambda row, i: F.struct(F.get(row, i).alias("d"), row.alias("row"))))["row"]
    length = F.sqrt(dot(longest, longest))
    return F.transform(longest, lambda x: F.when((_trace(m) > NOTHING) & (length > 0), x / length).otherwise(0.0))


def without(m: Column, v: Column) -> Column:
    """A symmetric matrix less what lies along ``v``."""
    spread = dot(v, F.transform(m, lambda row: dot(row, v)))
    return F.zip_with(m, v, lambda row, a: F.zip_with(row, v, lambda x, b: x - spread * a * b))


def parameters(fitted: DataFrame) -> DataFrame:
    """(profile, mean, std): ``fit_preprocessor``'s rows as arrays in the features' order."""
    found = fitted.groupBy(*PROFILE).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("m"))  # twelve a profile
    return found.select(*PROFILE, *[F.array(*[F.col("m")[f][c] for f in FEATURES]).alias(c) for c in ("mean", "std")])


def standardised(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` of fitted profiles with x and z, the features and their standardised form as arrays."""
    x = F.array(*[F.col(f).cast("double") for f in FEATURES])
    joined = rows.withColumn("x", x).join(params, PROFILE)
    return joined.withColumn("z", F.zip_with(F.zip_with("x", "mean", lambda a, b: a - b), "std", lambda a, b: a / b))


def fit_residuals(train: DataFrame, fitted: DataFrame, latent: int = LATENT) -> DataFrame:
    """(profile, mean, std, directions) of each profile's train rows."""
    params = materialize(parameters(fitted), "residual-parameters")  # a row a profile
    n = len(FEATURES)
    z = [F.col("z")[i] for i in range(n)]
    sums = [F.avg(z[i] * z[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]
    wide = standardised(train, params).groupBy(*PROFILE).agg(*sums)
    found = wide.select(*PROFILE, F.array(*[F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for j in range(n)]) for i in range(n)]).alias("left"))
    names = []
    for k in range(latent):
        found = materialize(found.withColumn(f"v{k}", direction(F.col("left"))), "residual-directions")
        found = found.withColumn("left", without(F.col("left"), F.col(f"v{k}")))
        names.append(f"v{k}")
    return params.join(found.select(*PROFILE, F.array(*names).alias("directions")), PROFILE)


def score_residuals(rows: DataFrame, model: DataFrame, *also: str) -> DataFrame:
    """(keys, also, score, residuals): the mean squared residual, and of each feature (feature, observed, expected, contribution, direction)."""
    z = standardised(rows.select(*KEYS, *also, *FEATURES), model)
    parts = F.transform("directions", lambda v: F.transform(v, lambda x: x * dot(F.col("z"), v)))
    zero = F.transform("z", lambda _: F.lit(0.0))
    made = z.withColumn("made", F.aggregate(parts, zero, lambda s, p: F.zip_with(s, p, lambda a, b: a + b)))

    def of(i: Column) -> Column:
        expected = F.get("made", i) * F.get("std", i) + F.get("mean", i)
        gap = F.get("made", i) - F.get("z", i)
        names = F.array(*map(F.lit, FEATURES))
        return F.struct(F.get(names, i).alias("feature"), F.get("x", i).alias("observed"), expected.alias("expected"), (gap * gap).alias("contribution"), F.when(F.get("x", i) > expected, "above").otherwise("below").alias("direction"))

    each = F.transform(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), of)
    out = made.withColumn("residuals", each)
    score = F.aggregate("residuals", F.lit(0.0), lambda s, r: s + r["contribution"]) / len(FEATURES)
    return out.select(*KEYS, *also, score.alias("score"), "residuals")


def top_residuals(scored: DataFrame, *also: str, k: int = TOP) -> DataFrame:
    """A row for each of a window's ``k`` largest residuals (compared at six decimals, ties in the features' order)."""
    entry = F.transform("residuals", lambda r, i: F.struct((-F.round(r["contribution"], 6)).alias("o"), i.alias("i"), r.alias("r")))
    rows = scored.select(*KEYS, *also, F.posexplode(F.slice(F.array_sort(entry), 1, k)).alias("rank", "e"))
    return rows.select(*KEYS, *also, "rank", "e.r.feature", "e.r.observed", "e.r.expected", "e.r.contribution", "e.r.direction")
