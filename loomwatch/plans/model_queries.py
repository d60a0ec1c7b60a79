"""Queries over the forests and residual models of the profiles' split snapshots, with SQL that unrolls levels and squarings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwatch.operators import forest, residuals as N, snapshots as P, windows as W
from loomwatch.plans.registry import KEY, query, tidy
from loomwatch.plans.snapshot_queries import PROFILE, SPLIT, _split

_X = "[" + ", ".join(f"round({f}::DOUBLE, 9)" for f in W.FEATURES) + "]"
N_FEATURES, DEPTH = len(W.FEATURES), 8


def _chance(at: int, names: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {names})), {8 * at + 1}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _forest_sql() -> str:
    """CTEs of the samples, each level of the trees and the way of every window down them."""
    low, high = (", ".join(f"{f}(x[{i + 1}]) OVER nd" for i in range(N_FEATURES)) for f in ("min", "max"))
    node = f"concat_ws('|', 'node-0', {PROFILE}, tree, node)"
    steps = [f"""rw AS MATERIALIZED (SELECT {KEY}, split, epoch_us(window_start) AS tm, {_X} AS x FROM sp),
tn AS (SELECT *, count(*) OVER (PARTITION BY {PROFILE}) AS n FROM rw WHERE split = 'train'),
ch AS (SELECT {PROFILE}, tm, x, tree, n, {_chance(0, f"'0', {PROFILE}, tree, tm")} AS u FROM tn, range({forest.TREES}) t(tree)),
sa AS (SELECT *, row_number() OVER (PARTITION BY {PROFILE}, tree ORDER BY u, tm) AS place FROM ch WHERE u * n < {2 * forest.SAMPLE}),
g0 AS MATERIALIZED (SELECT {PROFILE}, tree, x, 1::BIGINT AS node, count(*) OVER (PARTITION BY {PROFILE}, tree) AS size FROM sa WHERE place <= {forest.SAMPLE})"""]
    for k in range(DEPTH + 1):
        some = "[]" if k == DEPTH else f"list_filter(range(1, {N_FEATURES + 1}), lambda i: hi[i] > lo[i])"
        steps.append(f"""h{k} AS (SELECT *, [{low}] AS lo, [{high}] AS hi, count(*) OVER nd AS n FROM g{k} WINDOW nd AS (PARTITION BY {PROFILE}, tree, node)),
v{k} AS (SELECT *, {some}::BIGINT[] AS vary FROM h{k}),
c{k} AS (SELECT *, CASE WHEN n > 1 THEN vary[floor({_chance(0, node)} * len(vary))::BIGINT + 1] END AS f FROM v{k}),
k{k} AS MATERIALIZED (SELECT *, lo[f] + (hi[f] - lo[f]) * {_chance(1, node)} AS cut FROM c{k}),
g{k + 1} AS MATERIALIZED (SELECT {PROFILE}, tree, x, size, CASE WHEN f IS NULL THEN node ELSE 2 * node + (x[f] > cut)::INT END AS node FROM k{k})""")
    every = " UNION ".join(f"SELECT {PROFILE}, tree, node, f, cut, n, size FROM k{k}" for k in range(DEPTH + 1))
    steps.append(f"nd AS MATERIALIZED ({every})")
    steps.append(f"d0 AS (SELECT rw.*, tree, size, 1::BIGINT AS node FROM rw JOIN (SELECT {PROFILE}, tree, size FROM nd WHERE node = 1) USING ({PROFILE}))")
    for k in range(DEPTH):
        steps.append(f"d{k + 1} AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN f IS NULL THEN d.node ELSE 2 * d.node + (x[f] > cut)::INT END AS node) FROM d{k} d LEFT JOIN (SELECT {PROFILE}, tree, node, f, cut FROM nd WHERE f IS NOT NULL) USING ({PROFILE}, tree, node))")
    mean = lambda n: f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1) + {forest.EULER}::DOUBLE) - 2 * ({n} - 1) / {n} END"
    steps.append(f"""fo AS (SELECT {KEY}, split, avg(length(bin(node)) - 1 + {mean('n')}) AS d, any_value(size) AS size FROM d{DEPTH} JOIN (SELECT {PROFILE}, tree, node, n FROM nd WHERE f IS NULL) USING ({PROFILE}, tree, node) GROUP BY {KEY}, split),
fr AS (SELECT {KEY}, split, round(CASE WHEN size > 1 THEN pow(2.0::DOUBLE, -d / ({mean('size')})) ELSE 1 END, 6) AS score FROM fo)""")
    return f"{SPLIT}, " + ", ".join(steps)


FOREST = _forest_sql()


@query(f"{FOREST} SELECT * FROM fr")
def m13_forest_scores(spark, sf_dir):
    """How soon the trees of its profile's train part set each window apart."""
    rows = _split(spark, sf_dir)
    nodes = forest.grow_forest(rows.where("split = 'train'"))
    return tidy(forest.score_forest(rows, nodes, "split"))


@query(f"{FOREST} SELECT {PROFILE}, tree::INT AS tree, node, (f - 1)::INT AS feature, round(cut, 6) AS cut, n, size FROM nd")
def m13_forest_nodes(spark, sf_dir):
    rows = _split(spark, sf_dir)
    return tidy(forest.grow_forest(rows.where("split = 'train'")))


def _residual_sql() -> str:
    """CTEs from the second moments to each window's residuals."""
    z = "list_transform(range(1, 13), lambda i: (x[i] - mean[i]) / std[i])"
    moments = ", ".join("[" + ", ".join(f"avg(z[{min(i, j)}] * z[{max(i, j)}])" for j in range(1, 13)) + "]" for i in range(1, 13))
    names = "[" + ", ".join(f"'{f}'" for f in W.FEATURES) + "]"
    params = ", ".join(f"[{', '.join(f'''max({c}) FILTER (WHERE feature = '{f}')''' for f in W.FEATURES)}] AS {c}" for c in ("mean", "std"))
    raw = "[" + ", ".join(f"{f}::DOUBLE" for f in W.FEATURES) + "]"
    steps = [f"""pp AS (SELECT {PROFILE}, {params} FROM pre GROUP BY {PROFILE}),
zs AS MATERIALIZED (SELECT {KEY}, split, x, mean, std, {z} AS z FROM (SELECT {KEY}, split, {raw} AS x FROM sp) JOIN pp USING ({PROFILE})),
l0 AS (SELECT {PROFILE}, [{moments}] AS m FROM zs WHERE split = 'train' GROUP BY {PROFILE})"""]
    trace = "list_sum(list_transform(range(1, 13), lambda i: m[i][i]))"
    for k in range(N.LATENT):
        steps.append(f"q{k}_0 AS (SELECT {PROFILE}, m FROM l{k})")
        for s in range(N.SQUARINGS):
            steps.append(f"q{k}_{s + 1} AS MATERIALIZED (SELECT {PROFILE}, list_transform(m, lambda a: list_transform(m, lambda b: CASE WHEN t > 0 THEN list_dot_product(a, b) / (t * t) ELSE 0 END)) AS m FROM (SELECT *, {trace} AS t FROM q{k}_{s}))")
        steps.append(f"""e{k} AS (SELECT {PROFILE}, list_transform(r, lambda y: CASE WHEN len2 > 0 AND left_ > 1e-9 THEN y / sqrt(len2) ELSE 0 END) AS v FROM (SELECT *, list_dot_product(r, r) AS len2 FROM (
  SELECT {PROFILE}, left_, m[list_position(list_transform(range(1, 13), lambda i: m[i][i]), list_max(list_transform(range(1, 13), lambda i: m[i][i])))] AS r FROM q{k}_{N.SQUARINGS} JOIN (SELECT {PROFILE}, {trace} AS left_ FROM l{k}) USING ({PROFILE})))),
w{k} AS (SELECT {PROFILE}, m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS s FROM l{k} JOIN e{k} USING ({PROFILE})),
l{k + 1} AS MATERIALIZED (SELECT {PROFILE}, list_transform(range(1, 13), lambda i: list_transform(range(1, 13), lambda j: m[i][j] - s * v[i] * v[j])) AS m FROM w{k})""")
    parts = " + ".join(f"list_dot_product(z, e{k}.v) * e{k}.v[i]" for k in range(N.LATENT))
    joins = " ".join(f"JOIN e{k} ON e{k}.dataset_kind = zs.dataset_kind AND e{k}.user_id = zs.user_id AND e{k}.host_id = zs.host_id" for k in range(N.LATENT))
    steps.append(f"""mk AS (SELECT zs.*, list_transform(range(1, 13), lambda i: {parts}) AS made FROM zs {joins}),
rl AS (SELECT {KEY}, split, list_sum(list_transform(range(1, 13), lambda i: (made[i] - z[i]) * (made[i] - z[i]))) / 12 AS score,
  list_transform(range(1, 13), lambda i: {{'feature': ({names})[i], 'observed': x[i], 'expected': made[i] * std[i] + mean[i], 'contribution': (made[i] - z[i]) * (made[i] - z[i]), 'i': i}}) AS residuals FROM mk)""")
    return f"{SPLIT}, " + ", ".join(steps)


RESIDUALS = _residual_sql()


def _residuals(spark, sf_dir):
    rows = _split(spark, sf_dir)
    train = rows.where("split = 'train'")
    return N.score_residuals(rows, N.fit_residuals(train, P.fit_preprocessor(train)), "split")


@query(f"{RESIDUALS} SELECT {KEY}, split, round(score, 5) AS score FROM rl")
def m11_residual_scores(spark, sf_dir):
    """What the four main directions of its profile's train part leave of each window."""
    return tidy(_residuals(spark, sf_dir).select(*W.KEYS, "split", F.round("score", 5).alias("score")))


@query(f"""{RESIDUALS}, ex AS (SELECT {KEY}, split, unnest(residuals) AS r FROM rl), rk2 AS (SELECT {KEY}, split, r, row_number() OVER (PARTITION BY {KEY} ORDER BY round(r.contribution, 6) DESC, r.i) - 1 AS rank FROM ex)
SELECT {KEY}, rank::INT AS rank, round(r.contribution, 4) + 0 AS contribution FROM rk2 WHERE rank < 5 AND split = 'test'""")
def m12_top_residuals(spark, sf_dir):
    """The largest residuals of the windows of the test part."""
    top = N.top_residuals(_residuals(spark, sf_dir).where("split = 'test'"))
    return tidy(top.select(*W.KEYS, "rank", (F.round("contribution", 4) + 0).alias("contribution")))
