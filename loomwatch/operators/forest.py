"""Isolation forests of all profiles at once, grown level by level as a table of nodes.

Each profile has ``TREES`` trees over samples of up to ``SAMPLE`` of its rows. What chance decides is
a digest of names, so a forest is the same however it is computed: which rows a tree takes (the
smallest digests), which feature a node cuts (of those that vary in it) and where (between the least
and greatest value in it). A node is cut until it has one row, nothing varies, or the tree is
log2(``SAMPLE``) deep; children of node i are 2i and 2i + 1.

Rows are dealt by (profile, tree) once. All levels are windows over (profile, tree, node), which need
no further exchange, and no task holds more than one sample at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwatch.operators.windows import FEATURES, KEYS, PROFILE
from loomwatch.session import materialize

# Trees, rows of a sample, and Euler's constant in the mean depth of a search.
TREES, SAMPLE = 80, 256
EULER = 0.5772156649015329
#: Up to so many nodes (some 60 bytes each) are broadcast for scoring; more are joined by shuffles.
BROADCAST_NODES = 400_000

NODE = [*PROFILE, "tree", "node"]


def chance(at: int, *names: Column | str) -> Column:
    """A number in [0, 1) from the ``at``-th eight hex digits of the names' digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *names)), 8 * at + 1, 8), 16, 10).cast("long") / 2**32


def vector(rows: DataFrame) -> Column:
    """The features in order, at nine decimals."""
    return F.array(*[F.round(F.col(f).cast("double"), 9) for f in FEATURES])


def samples(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(profile, tree, x, at): for each tree, the ``sample`` rows of the profile with the smallest digests, or all.

    Digests beyond twice the share that is wanted are dropped before rows are dealt; that fewer than
    a sample stays under it has a chance of e^-64 at 256 rows, and all rows stay up to 512.
    """
    n = F.count("*").over(Window.partitionBy(*PROFILE))
    base = rows.select(*PROFILE, F.unix_micros("window_start").alias("at"), vector(rows).alias("x")).withColumn("n", n)
    each = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    each = each.withColumn("u", chance(0, F.lit(str(seed)), *PROFILE, F.col("tree").cast("string"), F.col("at").cast("string"))).where(F.col("u") * F.col("n") < 2 * sample)
    place = F.row_number().over(Window.partitionBy(*PROFILE, "tree").orderBy("u", "at"))
    return each.withColumn("place", place).where(F.col("place") <= sample).select(*PROFILE, "tree", "x", "at")


def grow_forest(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(profile, tree, node, feature, cut, n, size): feature (from 0) and cut are null in leaves; n rows fell there, size is the tree's sample."""
    node = Window.partitionBy(*NODE)
    depth = math.ceil(math.log2(sample))
    grown = samples(rows, trees, sample, seed).withColumn("node", F.lit(1).cast("long"))
    grown = grown.withColumn("size", F.count("*").over(Window.partitionBy(*PROFILE, "tree"))).withColumn("path", F.array().cast("array<struct<node:bigint,feature:int,cut:double,n:bigint>>"))
    for level in range(depth + 1):
        ends = F.array(*[F.struct(F.min(F.col("x")[i]).over(node).alias("lo"), F.max(F.col("x")[i]).over(node).alias("hi"), F.lit(i).alias("i")) for i in range(len(FEATURES))])
        grown = grown.withColumn("n", F.count("*").over(node)).withColumn("vary", F.filter(ends, lambda e: e["hi"] > e["lo"]))
        names = (F.lit(f"node-{seed}"), *PROFILE, F.col("tree").cast("string"), F.col("node").cast("string"))
        chosen = F.get("vary", F.floor(chance(0, *names) * F.size("vary")).cast("int")) if level < depth else F.lit(None).cast("struct<lo:double,hi:double,i:int>")
        grown = grown.withColumn("c", F.when(F.col("n") > 1, chosen)).withColumn("cut", F.col("c.lo") + (F.col("c.hi") - F.col("c.lo")) * chance(1, *names))
        step = F.struct("node", F.col("c.i").alias("feature"), "cut", "n")
        grown = grown.withColumn("path", F.array_append("path", step))
        down = 2 * F.col("node") + (F.get("x", F.col("c.i")) > F.col("cut")).cast("long")
        grown = grown.select(*PROFILE, "tree", "x", "at", "size", "path", F.when(F.col("c").isNotNull(), down).otherwise(F.col("node")).alias("node"))
    steps = grown.select(*PROFILE, "tree", "size", F.explode("path").alias("p")).select(*PROFILE, "tree", "size", "p.*")
    first = [F.first(c).alias(c) for c in ("feature", "cut", "n", "size")]
    return steps.groupBy(*NODE).agg(*first).select(*NODE, "feature", "cut", "n", "size")


def mean_depth(n: Column) -> Column:
    """How deep a search in n rows goes on average."""
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(2 * (F.log(n - 1) + EULER) - 2 * (n - 1) / n)


def score_forest(rows: DataFrame, nodes: DataFrame, *also: str, sample: int = SAMPLE) -> DataFrame:
    """(keys, also, score): 2 to the power of less the mean depth over the depth expected; rows of profiles without a forest drop out.

    Each row goes down each tree of its profile by joins with the nodes, one a level.
    """
    nodes = materialize(nodes, "forest")
    few = nodes.count() <= BROADCAST_NODES
    table = F.broadcast(nodes) if few else nodes
    trees = nodes.where("node = 1").select(*PROFILE, "tree", "size")
    at = rows.select(*KEYS, *also, vector(rows).alias("x")).join(F.broadcast(trees) if few else trees, PROFILE).withColumn("node", F.lit(1).cast("long"))
    cuts = table.where("feature is not null").select(*NODE, "feature", "cut")
    for _ in range(math.ceil(math.log2(sample))):
        met = at.join(F.broadcast(cuts) if few else cuts, NODE, "left")
        down = 2 * F.col("node") + (F.get("x", F.col("feature")) > F.col("cut")).cast("long")
        at = met.select(*KEYS, *also, "x", "tree", "size", F.when(F.col("feature").isNotNull(), down).otherwise(F.col("node")).alias("node"))
    leaves = nodes.where("feature is null").select(*NODE, "n")
    depth = F.length(F.bin("node")) - 1 + mean_depth(F.col("n"))
    out = at.join(F.broadcast(leaves) if few else leaves, NODE).groupBy(*KEYS, *also).agg(F.avg(depth).alias("d"), F.first("size").alias("size"))
    return out.select(*KEYS, *also, F.when(F.col("size") > 1, F.pow(F.lit(2.0), -F.col("d") / mean_depth(F.col("size")))).otherwise(1.0).alias("score"))
