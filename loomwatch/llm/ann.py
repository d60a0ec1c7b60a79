"""Approximate nearest neighbours with a robust-pruned directed graph per shard.

Equal vectors become one node that carries the smallest ids of its copies. Nodes are dealt to
shards by a hash of the vector; each shard's graph is built in one task over a bounded number of
nodes: points are inserted in batches, a greedy beam search over the graph so far proposes
neighbours, relaxed distance pruning (``alpha``) keeps few and diverse edges, and reverse edges
are pruned the same way. Searches begin at the nearest of some entry points that lie far from one
another, so that they reach every cluster. A far vector's neighbours lie far apart and out of the
reach of short edges, so a shard has a graph for each band of distances from its middle, lengths in
a band being within ``RATIO`` of one another where the band is not filled up to ``BAND_NODES``. The
index (band, node, ids, vector, edges) is a table. Each query visits every shard with beam searches, in
blocks of queries so that a task's memory is bounded, and the best are merged by exact distance in
double precision. Bands that cannot hold a nearer vector than those found, by the triangle
inequality, are left out.

Within a graph, vectors are moved to their shard's mean and scaled, and distances are sums of
squared differences in single precision: no large norms that cancel, no overflow.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are
neither queries nor candidates; only vectors of equal length are compared; a query's own id is no
candidate; ties go to the smaller id; repeated candidate rows count once, and an id with several
vectors is found by its nearest; a query id that comes more than once is asked once, with
the vector of the smallest hash; an empty table gives no rows; other input columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomwatch.session import materialize

SHARD_NODES, DEGREE, BEAM, BUILD_BEAM, ALPHA, QUERY_BLOCK = 4096, 32, 192, 64, 1.2, 8192
#: Lengths within a band, and the nodes that a band takes in from the next ones before it ends.
RATIO, BAND_NODES = 1.3, 128
#: Entry points of a graph, the queries that run together, and the most partitions asked for.
ENTRIES, TOGETHER, MOST_PARTITIONS = 64, 128, 20_000


def conditioned(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(points, middle, scale): points = (exact - middle) / scale in single precision.

    Medians, so that a few far vectors don't press all others together. Quarters of the largest
    doubles can be added without overflow.
    """
    middle = np.median(exact / 4, axis=0) * 4
    apart = np.abs(exact / 4 - middle / 4)
    apart = apart[apart > 0]
    scale = float(min(np.median(apart), 4e307)) * 4 if len(apart) else 1.0
    return moved(exact, middle, scale), middle, scale


def moved(exact: np.ndarray, middle: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in a shard's own measure, held where their squares can be added in single precision."""
    with np.errstate(over="ignore"):
        return ((exact / 4 - middle / 4) / (scale / 4)).clip(-1e15, 1e15).astype(np.float32)


def bands(exact: np.ndarray) -> np.ndarray:
    """The band of each vector of a shard, from 0, by its distance from their middle."""
    middle = np.median(exact / 4, axis=0) * 4
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        steps = np.floor(np.log(_lengths(exact / 4 - middle / 4)) / np.log(RATIO))
    steps = np.nan_to_num(steps, nan=0.0, posinf=1e9, neginf=-1e9)
    _, step, count = np.unique(steps, return_inverse=True, return_counts=True)
    number, filled, out = 0, 0, np.zeros(len(count), dtype=np.int32)
    for i, n in enumerate(count):
        if filled >= BAND_NODES:
            number, filled = number + 1, 0
        out[i] = number
        filled += n
    return out[step]


def entry_points(points: np.ndarray, count: int = ENTRIES) -> np.ndarray:
    """The node nearest to the middle, then again and again the one farthest from those chosen."""
    chosen = [int((points * points).sum(axis=1).argmin())]
    least = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen, dtype=np.int32)


def _distances(points: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each row of x to points[ids]; infinite where ids is -1."""
    apart = points[ids] - x[:, None, :]
    return np.where(ids < 0, np.float32(np.inf), np.einsum("qkd,qkd->qk", apart, apart))


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the best ``beam`` nodes met from ``entries``, for all rows of x at once."""
    q = len(x)
    width = max(beam, len(entries))
    ids = np.full((q, width), -1, dtype=np.int32)
    ids[:, : len(entries)] = entries
    dist = np.full((q, width), np.inf, dtype=np.float32)
    dist[:, : len(entries)] = _distances(points, x, ids[:, : len(entries)])
    best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
    done = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, len(points)), dtype=bool)
    seen[:, entries] = True
    rows = np.arange(q)
    while len(rows):
        open_ = np.where(done[rows] | (ids[rows] < 0), np.inf, dist[rows])
        best = open_.argmin(axis=1)
        live = np.isfinite(open_[np.arange(len(rows)), best])
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        done[rows, best] = True
        near = edges[ids[rows, best]]
        fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        at, _ = np.nonzero(fresh)
        seen[rows[at], near[fresh]] = True
        d = _distances(points, x[rows], near)
        all_ids = np.concatenate([ids[rows], near], axis=1)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], axis=1)
        top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        here = np.arange(len(rows))[:, None]
        ids[rows], dist[rows], done[rows] = all_ids[here, top], all_d[here, top], all_done[here, top]
    order = np.argsort(dist, axis=1, kind="stable")
    here = np.arange(q)[:, None]
    return ids[here, order], dist[here, order]


def robust_prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` neighbours for each node of ``own`` from its candidates ``ids`` (-1: none).

    The nearest candidate is kept, and those that it is ``alpha`` times nearer to than the node
    is are dropped; again until none is left.
    """
    ids = np.where(ids == own[:, None], -1, ids)
    dist = _distances(points, points[own], ids)
    near = points[np.maximum(ids, 0)]
    left = np.isfinite(dist)
    out = np.full((len(own), degree), -1, dtype=np.int32)
    here = np.arange(len(own))
    for k in range(degree):
        best = np.where(left, dist, np.inf).argmin(axis=1)
        some = left[here, best]
        if not some.any():
            break
        out[some, k] = ids[here, best][some]
        apart = near - near[here, best][:, None, :]
        covered = alpha * alpha * np.einsum("qkd,qkd->qk", apart, apart) <= dist
        left &= ~covered & (ids != ids[here, best][:, None])
        left[~some] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): the graph over ``points`` and the nodes where searches begin."""
    n = len(points)
    entries = entry_points(points)
    edges = np.full((n, degree), -1, dtype=np.int32)
    order = np.random.RandomState(seed).permutation(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]]).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(TOGETHER, at // 2))]
        found, _ = beam_search(points, edges, entries[:at], points[batch], beam)
        if at < 2 * beam:  # the graph is small: all that is in it may propose itself
            found = np.broadcast_to(order[:at], (len(batch), at))
        edges[batch] = robust_prune(points, batch, found, degree, alpha)
        # Reverse edges: to each neighbour, all of the batch that chose it.
        src = np.repeat(batch, degree)
        dst = edges[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(targets), int(count.max(initial=0))), -1, dtype=np.int32)
        place = np.arange(len(dst)) - np.repeat(first, count)
        extra[np.repeat(np.arange(len(targets)), count), place] = src
        for i in range(0, len(targets), TOGETHER):
            some = targets[i : i + TOGETHER]
            width = int(count[i : i + TOGETHER].max())
            both = np.concatenate([edges[some], extra[i : i + TOGETHER, :width]], axis=1)
            edges[some] = robust_prune(points, some.astype(np.int32), both, degree, alpha)
        at += len(batch)
    return edges, entries


def _lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths in double precision; scaled only where squares would overflow."""
    with np.errstate(over="ignore"):
        d = np.sqrt((rows**2).sum(axis=1))
    if np.isinf(d).any():
        top = np.abs(rows).max()
        d = np.where(np.isinf(d), np.sqrt(((rows / top) ** 2).sum(axis=1)) * top, d)
    return d


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, h, g, dim) of the vectors that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    cast = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return cast.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), "v").alias("g"), F.size("v").alias("dim"))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(dim, shard, shards, band, node, entry, ids, v, edges): every vector, with the k + 1 smallest ids of equal ones.

    No query of k neighbours can need more copies, its own among them.
    """
    good = usable(vectors, id_col, vector_col)
    smallest = Window.partitionBy("h", "g").orderBy("vec_id")
    few = good.withColumn("rn", F.dense_rank().over(smallest)).where(F.col("rn") <= k + 1)
    nodes = few.groupBy("h", "g").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    nodes = materialize(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.select("dim", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "ids", "v")
    # Given here, a number of partitions holds: few bytes a shard, but seconds of work.
    dealt = dealt.repartition(min(shards, MOST_PARTITIONS), "dim", "shard")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0])).reset_index(drop=True)
        exact, out = np.stack(pdf.v.to_numpy()), []
        band = bands(exact)
        for b in range(band.max() + 1):
            own = np.flatnonzero(band == b)
            edges, entries = build_graph(conditioned(exact[own])[0])
            numbers = {"band": np.int32(b), "node": np.arange(len(own), dtype=np.int32), "entry": -np.ones(len(own), dtype=np.int32), "shards": np.int32(shards)}
            numbers["entry"][entries] = np.arange(len(entries))
            out.append(pdf.iloc[own].assign(**numbers, edges=list(edges)))
        return pd.concat(out)[["dim", "shard", "shards", "band", "node", "entry", "ids", "v", "edges"]]

    index = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, shards int, band int, node int, entry int, ids array<long>, v array<double>, edges array<int>")
    return materialize(index, "ann-index")


class Shard:
    """The graphs of a shard, ready for searches: ``nodes`` in the order of band and node."""

    def __init__(self, nodes: pd.DataFrame) -> None:
        self.exact = np.stack(nodes.v.to_numpy())
        self.middle = np.median(self.exact / 4, axis=0) * 4
        with np.errstate(over="ignore", invalid="ignore"):
            length = _lengths(self.exact - self.middle)
        edge = np.flatnonzero(np.diff(nodes.band.to_numpy(), prepend=-1, append=nodes.band.iloc[-1] + 1))
        self.graphs = []
        for a, b in zip(edge, edge[1:], strict=False):
            part = nodes.iloc[a:b]
            edges = np.stack(part.edges.to_numpy()).astype(np.int32)
            entries = part[part.entry >= 0].sort_values("entry").node.to_numpy()
            self.graphs.append((a, b, length[a:b].min(), length[a:b].max(), *conditioned(self.exact[a:b]), edges, entries))

    def search(self, asked: np.ndarray, k: int, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of ``asked``, the nodes that its beam searches found and their exact distances.

        The nearest bands come first, and a band is searched only for those queries to which one of
        its vectors may be nearer than the ``k`` + 1 nearest nodes so far (one may be the query's own).
        """
        with np.errstate(over="ignore", invalid="ignore"):
            mine = _lengths(asked - self.middle)
            apart = np.array([np.maximum(np.maximum(lo - mine, mine - hi), 0) for _, _, lo, hi, *_ in self.graphs])  # band x query
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in asked]
        for g in np.argsort(np.nan_to_num(apart).min(axis=1), kind="stable"):
            a, b, _, _, points, center, scale, edges, entries = self.graphs[g]
            reach = np.array([np.partition(d, k)[k] if len(d) > k else np.inf for _, d in found])
            rows = np.flatnonzero(~(apart[g] * (1 - 1e-9) > reach))
            if len(rows):
                near = beam_search(points, edges, entries, moved(asked[rows], center, scale), beam)[0]
                for row, some in zip(rows, near, strict=True):
                    some = some[some >= 0] + a
                    found[row] = np.concatenate([found[row][0], some]), np.concatenate([found[row][1], _lengths(self.exact[some] - asked[row])])
        return found


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance."""
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min_by(F.struct("v", "dim"), "h").alias("q"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "q.v", "q.dim")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = index.agg(F.max("shards")).first()[0] or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("to_block")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to_shard")  # a row a shard
    sent = asked.select("query_id", "v", F.col("dim").alias("to_dim"), block, every)
    tiles = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = min(shards * blocks, MOST_PARTITIONS)
    sent, tiles = sent.repartition(parts, "to_dim", "to_shard", "to_block"), tiles.repartition(parts, "dim", "shard", "block")

    def look(key, nodes: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(nodes) and len(qs):
            nodes = nodes.sort_values(["band", "node"]).reset_index(drop=True)
            shard, ids, asked_v = Shard(nodes), nodes.ids.to_numpy(), np.stack(qs.v.to_numpy())
            for i in range(0, len(qs), TOGETHER):
                found = shard.search(asked_v[i : i + TOGETHER], k, beam)
                for q, (near, d) in zip(qs.query_id.to_numpy()[i : i + TOGETHER], found, strict=True):
                    nearest_of: dict[int, float] = {}
                    for a, v in sorted((float(a), int(v)) for a, n in zip(d, near, strict=True) for v in ids[n] if v != q):
                        nearest_of.setdefault(v, a)
                    rows = [(a, v) for v, a in nearest_of.items()][:k]
                    out["query_id"] += [int(q)] * len(rows)
                    out["vec_id"] += [v for _, v in rows]
                    out["score"] += [a for a, _ in rows]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    local = tiles.groupBy("dim", "shard", "block").cogroup(sent.groupBy("to_dim", "to_shard", "to_block")).applyInPandas(look, "query_id long, vec_id long, score double")
    best = local.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """Index ``vectors`` and search it for ``queries``."""
    return search(build_index(vectors, id_col, vector_col, k), queries, id_col, vector_col, k)
