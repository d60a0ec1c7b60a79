"""Forests and residual models of profiles against plain Python and numpy."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwatch.operators import forest, residuals, snapshots as P, windows as W

PROFILES = [("real", "u1", "h"), ("synthetic", "u2", "h")]
SHAPE = "dataset_kind string, user_id string, host_id string, window_start timestamp, " + ", ".join(f"{f} double" for f in W.FEATURES)


def table(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows, mix = [], rng.normal(size=(len(W.FEATURES), len(W.FEATURES))) * np.linspace(3, 0.2, len(W.FEATURES))
    for p, n in zip(PROFILES, sizes, strict=True):
        x = np.round(rng.normal(size=(n, len(W.FEATURES))) @ mix.T, 6)
        x[:, 3] = 7  # does not vary
        x[:, 8] = np.round(np.abs(x[:, 8]))
        rows += [(*p, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SHAPE), rows


def chance(at, *names):
    return int(hashlib.md5("|".join(names).encode()).hexdigest()[8 * at : 8 * at + 8], 16) / 2**32


def micros(t):
    return str(int(t.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000))


def brute_forest(rows, profile, trees, sample):
    """node to (feature, cut, n) of each tree."""
    mine = [(micros(r[3]), r[4:]) for r in rows if r[:3] == profile]
    out = []
    for tree in range(trees):
        order = sorted(mine, key=lambda r: (chance(0, "0", *profile, str(tree), r[0]), int(r[0])))
        nodes = {}

        def grow(node, some, depth, tree=tree, nodes=nodes):
            vary = [i for i in range(len(W.FEATURES)) if len({x[i] for _, x in some}) > 1]
            if len(some) < 2 or not vary or depth == math.ceil(math.log2(sample)):
                nodes[node] = (None, None, len(some))
                return
            names = ("node-0", *profile, str(tree), str(node))
            f = vary[math.floor(chance(0, *names) * len(vary))]
            lo, hi = min(x[f] for _, x in some), max(x[f] for _, x in some)
            cut = lo + (hi - lo) * chance(1, *names)
            nodes[node] = (f, cut, len(some))
            grow(2 * node, [r for r in some if r[1][f] <= cut], depth + 1)
            grow(2 * node + 1, [r for r in some if r[1][f] > cut], depth + 1)

        grow(1, order[:sample], 0)
        out.append(nodes)
    return out


def mean_depth(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + forest.EULER) - 2 * (n - 1) / n


@pytest.mark.parametrize(("sizes", "sample", "few"), [((60, 25), 16, True), ((60, 1), 64, False)])
def test_a_forest_and_its_scores_equal_plain_recursion(spark, monkeypatch, sizes, sample, few):
    if not few:
        monkeypatch.setattr(forest, "BROADCAST_NODES", 0)
    df, rows = table(spark, sizes)
    nodes = forest.grow_forest(df.repartition(3), trees=5, sample=sample)
    got = {}
    for r in nodes.collect():
        got.setdefault((r.dataset_kind, r.user_id, r.host_id), {}).setdefault(r.tree, {})[r.node] = (r.feature, r.cut, r.n)
    scores = {(r.dataset_kind, r.user_id, r.host_id, r.window_start): r.score for r in forest.score_forest(df, nodes, sample=sample).collect()}
    assert len(scores) == len(rows)
    for p in PROFILES:
        trees = brute_forest(rows, p, 5, sample)
        assert [got[p][t] for t in range(5)] == trees
        for r in (r for r in rows if r[:3] == p):
            depths = []
            for nodes_of in trees:
                node = 1
                while nodes_of[node][0] is not None:
                    node = 2 * node + (r[4 + nodes_of[node][0]] > nodes_of[node][1])
                depths.append(node.bit_length() - 1 + mean_depth(nodes_of[node][2]))
            size = trees[0][1][2]
            want = 2 ** (-sum(depths) / 5 / mean_depth(size)) if size > 1 else 1.0
            assert scores[r[:4]] == pytest.approx(want, abs=1e-9)


def test_odd_windows_score_higher_than_the_rest(spark):
    df, rows = table(spark, (300, 30))
    odd = (*PROFILES[0], datetime.datetime(2025, 1, 1), *[60.0] * 12)
    scored = forest.score_forest(df.unionByName(spark.createDataFrame([odd], SHAPE)), forest.grow_forest(df, trees=30, sample=64), sample=64)
    best = scored.where("user_id = 'u1'").orderBy(F.desc("score")).first()
    assert best.window_start.year == 2025 and 0 < best.score <= 1


def test_residuals_equal_numpy(spark):
    df, rows = table(spark, (200, 80))
    model = residuals.fit_residuals(df, P.fit_preprocessor(df))
    scored = residuals.score_residuals(df, model)
    got = {(r.dataset_kind, r.user_id, r.host_id, r.window_start): r for r in scored.collect()}
    top = {}
    for r in residuals.top_residuals(scored).collect():
        top.setdefault((r.dataset_kind, r.user_id, r.host_id, r.window_start), []).append(r)
    for p in PROFILES:
        mine = [r for r in rows if r[:3] == p]
        x = np.array([r[4:] for r in mine])
        mean, std = x.mean(axis=0), x.std(axis=0)
        std[std < 1e-6] = 1
        z = (x - mean) / std
        v = np.linalg.eigh(z.T @ z / len(z))[1][:, -4:]
        made = z @ v @ v.T
        for r, row_z, row_made in zip(mine, z, made, strict=True):
            gap = (row_made - row_z) ** 2
            found = got[r[:4]]
            assert found.score == pytest.approx(gap.mean(), abs=1e-6)
            assert [e.contribution for e in found.residuals] == pytest.approx(list(gap), abs=1e-6)
            assert [e.expected for e in found.residuals] == pytest.approx(list(row_made * std + mean), abs=1e-5)
            best = sorted(top[r[:4]], key=lambda e: e["rank"])
            assert [e.contribution for e in best] == pytest.approx(sorted(gap, reverse=True)[:5], abs=2e-6)
            assert all((e.direction == "above") == (e.observed > e.expected) for e in best)


def test_fewer_rows_than_directions_leave_nothing_of_themselves(spark):
    df, rows = table(spark, (3, 2))
    scored = residuals.score_residuals(df, residuals.fit_residuals(df, P.fit_preprocessor(df)))
    assert all(r.score < 1e-9 for r in scored.collect())


def test_a_profile_in_which_nothing_varies_has_no_residual(spark):
    rows = [(*PROFILES[0], datetime.datetime(2024, 1, 1, i), *[5.0] * 12) for i in range(5)]
    df = spark.createDataFrame(rows, SHAPE)
    model = residuals.fit_residuals(df, P.fit_preprocessor(df))
    assert [r.score for r in residuals.score_residuals(df, model).collect()] == [0.0] * 5
    assert {r.score for r in forest.score_forest(df, forest.grow_forest(df, trees=3)).collect()} == {0.5}
