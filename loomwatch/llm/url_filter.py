"""URL filtering by rules and by trust that spreads over host links (DataFrame functions only).

A rule names a host and a path prefix; the longest rule that fits decides. Where none fits, the
host's own standing decides: personalised PageRank walks from trusted hosts along links, and
distrust walks from blocked hosts against them (who links to a blocked host shares its distrust).
Both run at once over one edge table, one join and one aggregate an iteration, until the mass still
under way is at most ``tolerance`` of the seeds' mass; as each step passes on ``damping`` of the one
before at most, that takes the same number of iterations at any size. Mass that comes to hosts
without a way on returns to the seeds, in proportion. Trust and distrust are in pages, and so are
comparable with a host's size: each of its pages without a rule counts ``neutral`` of a seed page
for neither side, and a host is blocked if its distrust is over ``threshold`` times the sum of all
three.

Edges between hosts come from absolute and protocol-relative links in the pages. A host and the
host above it (one label less, of three labels at least) are edges of weight ``kin`` both ways,
as www.a.example.com and a.example.com are one site. Links within one host are no edges.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; null html has no links; a host without links keeps only its seed; seeds are hosts on which
the rules allow or block pages, weighted by their pages; repeated pages are judged alike and count
as pages each; an empty table gives an empty table; input columns named like an added one are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII letters in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of rule and verdict; else null."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def host_edges(pages: DataFrame, kin: float = 0.5) -> DataFrame:
    """(src, dst, w) between different hosts; w is the number of links, or ``kin`` for kinship."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/"'?#>\s]+)"""), F.lit(1))
    out = pages.select("host", F.explode(links).alias("dst")).select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
    linked = out.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = pages.select("host").where("host <> ''").distinct()
    above = F.regexp_extract("host", r"^[^.]+\.([^.]+(?:\.[^.]+){2,})$", 1)
    kindred = hosts.select("host", above.alias("up")).where("up <> ''")
    both = kindred.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e"))
    kindred = both.select("e.src", "e.dst", F.lit(kin).alias("w"))
    return linked.unionByName(kindred).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.02, cut_every: int = 2, look_every: int = 6) -> DataFrame:
    """(host, trust, distrust, unit) after the walks; ``seeds`` has (host, trust, distrust).

    Trust follows edges, its share divided among a host's outgoing weight; distrust goes the
    other way, divided among the incoming weight. Both are in the unit of the seeds, and each sums
    up to their mass; unit is what a blocked seed page counts at its own host. The lineage is cut every
    ``cut_every`` iterations, so that plans stay small on the driver; the mass under way is looked at
    every ``look_every``.
    """
    mass = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    # Each edge is stored for both walks, keyed by the host that gives.
    forward = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("w").alias("wt"), F.lit(0.0).alias("wd"))
    backward = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), F.col("w").alias("wd"))
    both = forward.unionByName(backward)
    weight = both.groupBy("host").agg(F.sum("wt").alias("ot"), F.sum("wd").alias("od"))
    shares = both.join(weight, "host").select(
        "host", "to", F.coalesce(F.try_divide("wt", "ot"), F.lit(0.0)).alias("pt"), F.coalesce(F.try_divide("wd", "od"), F.lit(0.0)).alias("pd")
    )
    shares = materialize(shares, "host-shares")
    trust, distrust = F.col("trust") * (1 - damping), F.col("distrust") * (1 - damping)
    rank = seeds.select("host", trust.alias("trust"), distrust.alias("distrust"), trust.alias("dt"), distrust.alias("dd"))
    rank = materialize(rank, "host-seeds")
    while True:
        for i in range(1, look_every + 1):
            step = shares.join(rank.where("dt > 0 or dd > 0"), "host").select(
                F.col("to").alias("host"), (F.col("dt") * F.col("pt") * damping).alias("dt"), (F.col("dd") * F.col("pd") * damping).alias("dd")
            )
            step = step.select("host", F.col("dt").alias("trust"), F.col("dd").alias("distrust"), "dt", "dd")
            held = rank.select("host", "trust", "distrust", F.lit(0.0).alias("dt"), F.lit(0.0).alias("dd"))
            rank = held.unionByName(step).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "dt", "dd")])
            if i % cut_every == 0 or i == look_every:
                rank = materialize(rank, "host-rank")
        *whole, trust_left, distrust_left = rank.agg(*[F.sum(c) for c in ("trust", "distrust", "dt", "dd")]).first()
        # What is under way comes to damping / (1 - damping) of the last step at most.
        ahead = damping / (1 - damping)
        if all(not m or left * ahead <= tolerance * m for m, left in zip(mass, (trust_left, distrust_left), strict=True)):
            back = [m / w if m and w else 1.0 for m, w in zip(mass, whole, strict=True)]  # from hosts without a way on
            return rank.select("host", (F.col("trust") * back[0]).alias("trust"), (F.col("distrust") * back[1]).alias("distrust"), F.lit((1 - damping) * back[1]).alias("unit"))


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", html_col: str = "html",
    threshold: float = 0.5, damping: float = 0.85, tolerance: float = 0.02, kin: float = 0.5, neutral: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust.

    Rules are few (a list of the program, matched without a join).
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    names = [c for c in pages.columns if c.lower() not in added]
    ruled, neutral_col, own_trust, own_distrust = fresh(pages, "_r", "_neutral", "_trust", "_distrust")
    judged = pages.select(*map(col, names), host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"))
    judged = judged.withColumn(ruled, rule_of(F.col("host"), F.col("path"), rules))
    slim = pages.select(host_of(col(url_col)).alias("host"), path_of(col(url_col)).alias("path"), col(html_col).alias("html"))
    slim = slim.select("host", "html", rule_of(F.col("host"), F.col("path"), rules).alias("_r"))
    edges = host_edges(slim, kin)
    verdict = F.col("_r.verdict")
    hosts = slim.where("host <> ''").groupBy("host").agg(
        F.sum(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.sum(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("distrust"),
        F.sum(F.when(F.col("_r").isNull(), 1.0).otherwise(0.0)).alias("open"),
    )
    hosts = materialize(hosts, "host-pages")
    rank = propagate(edges, hosts.where("trust + distrust > 0").select("host", "trust", "distrust"), damping, tolerance)
    # A page without a rule weighs against the seeds as they count at their own host.
    rank = hosts.select("host", "open").join(rank, "host", "left")
    rank = rank.select("host", (F.col("open") * neutral * F.col("unit")).alias(neutral_col), F.col("trust").alias(own_trust), F.col("distrust").alias(own_distrust))
    standing = judged.join(rank, "host", "left")
    trust, distrust, apart = (F.coalesce(col(c), F.lit(0.0)) for c in (own_trust, own_distrust, neutral_col))
    own = F.when(distrust > threshold * (trust + distrust + apart), "block").otherwise("allow")
    return standing.select(
        *map(col, names), "host", "path", F.col(f"{ruled}.rule").alias("rule"), F.coalesce(F.col(f"{ruled}.verdict"), own).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
