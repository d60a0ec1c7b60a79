"""Line deduplication by a deletion-neighbourhood join (DataFrame functions only).

A line goes if a line that comes earlier, in the order (doc_id, line number), lies within one
character edit of it; equal lines are the case of no edit. Lines are compared after trimming
spaces. Lines shorter than ``min_chars`` characters have no near match, and only equal ones of at
least ``exact_chars`` go; ``exact_chars`` is ``min_chars`` unless given. Shorter lines stay and are
compared with nothing, as do empty ones.

Two lines lie within one edit exactly if they share a deletion variant: with equal lengths, the
same text after removing the character at the same place; with lengths one apart, the shorter
line itself. Lines are long, so variants of whole lines would be many times the corpus. Two
exact filters come first, both by the pigeonhole principle, and both lose no pair:

1. one edit leaves either the head or the tail of a line as it was, so only lines whose head or
   tail occurs in another line go on (two hashes a line);
2. cut into pieces, all pieces but one are as they were, so the variants are taken of that one
   piece, under a key that holds the hash of the others.

Groups are met by aggregates and equi-joins with one witness a group, never by pairs within a
group, so a line with any number of copies costs no more than its rows. Every witness is
confirmed by ``levenshtein``.

Defined cases: a null or empty text has no lines and comes back as it is; rows that share a
doc_id count as one document (lines at the same place in them are not copies of each other, so
repeated rows come back alike); a null doc_id sorts before all others; a text of any length or number
of lines is read whole, in time linear in it; an empty table gives an empty table; input columns
named like the two added ones are replaced, all others are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

#: Broadcast the hashes of candidate lines up to this many (8 bytes each); beyond, shuffle.
BROADCAST_HASHES = 2_000_000
#: A line is split over several tasks from so many rows on, or from this share of all repeated rows;
#: so there are at most HOT_LINES of such lines, whatever the size, and their hashes can be broadcast.
HOT_ROWS, HOT_LINES = 1_000, 100_000


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line of at least ``min_chars``: document key, order, text and two hashes."""
    # The hash of the text is made below the generator: once a text, not once a line.
    hashed = docs.select(col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("_tk"), F.split(col(text_col), "\n").alias("_all"))
    exploded = hashed.select("_id", "_tk", F.posexplode("_all").alias("_no", "_raw"))
    trimmed = exploded.select("_id", "_tk", "_no", F.trim("_raw").alias("_t"))
    return trimmed.where(F.char_length("_t") >= min_chars).select(
        "_id",
        "_tk",
        F.struct(F.col("_id").alias("d"), F.col("_no").alias("n")).alias("_ord"),
        "_t",
        F.char_length("_t").alias("_n"),
        F.xxhash64("_t").alias("_h"),
        F.xxhash64(F.lit(7), "_t").alias("_g"),
    )


def _half_keys(lines: DataFrame) -> DataFrame:
    """(key, hash): heads and tails of p characters, p the power of two with 2p <= length < 4p.

    A line of 2p characters also brings the keys of p / 2, for partners that are shorter by one.
    """
    power = F.floor(F.log2(F.col("_n") / 2) + F.lit(1e-9)).cast("int")
    sized = lines.select("_t", "_h", "_n", F.pow(F.lit(2.0), power).cast("int").alias("_p"))

    def keys(p: Column) -> list[Column]:
        head, tail = F.substring(F.col("_t"), F.lit(1), p), F.substring(F.col("_t"), F.col("_n") - p + 1, p)
        return [F.xxhash64(F.lit(0), p, head), F.xxhash64(F.lit(1), p, tail)]

    p, half = F.col("_p"), (F.col("_p") / 2).cast("int")
    both = F.when(F.col("_n") == 2 * p, F.array(*keys(p), *keys(half))).otherwise(F.array(*keys(p)))
    return sized.select(F.explode(both).alias("_k"), "_h")


def _pieces(lines: DataFrame) -> DataFrame:
    """A row per line, shorter length l of a possible pair (own or own less one) and piece."""
    count = F.greatest(F.lit(2), F.ceil(F.sqrt("_l") / 8)).cast("int")
    lengths = F.array(*[F.struct((F.col("_n") - side).alias("l"), F.lit(side).alias("side")) for side in (0, 1)])
    sided = lines.select("_h", "_ord", "_t", "_n", F.explode(lengths).alias("s")).select("_h", "_ord", "_t", "_n", F.col("s.l").alias("_l"), F.col("s.side").alias("_side"))
    placed = sided.withColumn("_m", count).select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_i"))
    placed = placed.select(
        "_h", "_ord", "_t", "_n", "_l", "_side", "_i",
        F.floor(F.col("_l") * F.col("_i") / F.col("_m")).cast("int").alias("_start"),
        F.floor(F.col("_l") * (F.col("_i") + 1) / F.col("_m")).cast("int").alias("_end"),
    )
    after = F.col("_l") - F.col("_end")
    head = F.substring(F.col("_t"), F.lit(1), F.col("_start"))
    tail = F.substring(F.col("_t"), F.col("_n") - after + 1, after)
    middle = F.substring(F.col("_t"), F.col("_start") + 1, F.col("_n") - F.col("_start") - after)
    return placed.select("_h", "_ord", "_side", F.xxhash64("_l", "_i", head, tail).alias("_k"), middle.alias("_mid"))


def _shared(keys: DataFrame) -> DataFrame:
    """Keys under which at least two different lines stand."""
    return keys.groupBy("_k").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).where("lo <> hi").select("_k")


def _variants(pieces: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each piece, and the undeleted piece, as hashed keys.

    ``_role`` 0: equal lengths, removed at the same place. 1 and 2: the shorter line as it is and
    the longer line less one character, which meet under one key.
    """
    size = F.char_length("_mid")

    def without(i: Column) -> Column:
        return F.concat(F.substring(F.col("_mid"), F.lit(1), i - 1), F.substring(F.col("_mid"), i + 1, F.lit(1 << 30)))

    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    same = F.transform(places, lambda i: F.struct(F.lit(0).alias("role"), F.xxhash64(F.lit(0), "_k", i, without(i)).alias("v")))
    shorter = F.array(F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit(1), "_k", "_mid").alias("v")))
    longer = F.array_distinct(
        F.transform(places, lambda i: F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit(1), "_k", without(i)).alias("v")))
    )
    rows = F.when(F.col("_side") == 0, F.concat(same, shorter)).otherwise(longer)
    return pieces.select("_h", "_ord", F.explode(rows).alias("v")).select(
        "_h", "_ord", F.col("v.role").alias("_role"), F.col("v.v").alias("_v")
    )


def near_lines(lines: DataFrame) -> DataFrame:
    """Hashes (_h, _g) of the lines that have an earlier line one edit away."""
    keys = materialize(_half_keys(lines), "line-half-keys")
    hashes = materialize(keys.join(_shared(keys), "_k", "left_semi").select("_h").distinct(), "line-halves")
    wanted = F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes
    first = F.min(F.struct("_ord", "_t")).alias("first")
    texts = materialize(
        lines.join(wanted, "_h", "left_semi").groupBy("_h", "_g").agg(first).select("_h", "_g", "first._ord", "first._t"),
        "line-texts",
    )
    pieces = materialize(_pieces(texts.withColumn("_n", F.char_length("_t"))), "line-pieces")
    pieces = pieces.join(_shared(pieces.select("_k", "_h")), "_k", "left_semi")
    variants = materialize(_variants(pieces), "line-variants")
    earliest = F.min(F.struct("_ord", "_h"))
    groups = (
        variants.groupBy("_v")
        .agg(
            F.min(F.when(F.col("_role") < 2, F.struct("_ord", "_h"))).alias("here"),
            F.min(F.when(F.col("_role") == 2, F.struct("_ord", "_h"))).alias("longer"),
            earliest.alias("lo"),
            F.max(F.struct("_ord", "_h")).alias("hi"),
        )
        .where("lo <> hi")
        .select("_v", "here", "longer")
    )
    witness = F.when(F.col("_role") == 1, F.col("longer")).otherwise(F.col("here"))
    pairs = (
        variants.join(groups, "_v")
        .select("_h", "_ord", witness.alias("w"))
        .where(F.col("w._ord") < F.col("_ord"))
        .select("_h", F.col("w._h").alias("_wh"))
        .distinct()
    )
    other = texts.select(F.col("_h").alias("_wh"), F.col("_t").alias("_wt"))
    checked = pairs.join(texts.select("_h", "_g", "_t"), "_h").join(other, "_wh")
    return checked.where(F.levenshtein("_t", "_wt", 1).between(0, 1)).select("_h", "_g").distinct()


def _meet(lines: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``lines`` joined with their rules; a line of many rows (``counts``: _h, _g, n) is dealt over several tasks, its rule to each."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(HOT_ROWS, (total or 0) // HOT_LINES)
    if (most or 0) <= least:
        return lines.join(rules, ["_h", "_g"])
    parts = F.ceil(F.col("n") / least)
    hot = F.broadcast(counts.where(F.col("n") > least).select("_h", "_g", parts.alias("_parts")))  # HOT_LINES rows at most
    dealt = lines.join(hot, ["_h", "_g"], "left").withColumn("_s", F.pmod(F.xxhash64("_ord"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    copies = rules.join(hot, ["_h", "_g"], "left").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, ["_h", "_g", "_s"])


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, max_edits: int = 1, exact_chars: int | None = None
) -> DataFrame:
    """(_id, _tk, _lines): for each document that loses lines, the numbers of those lines."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = _occurrences(docs, id_col, text_col, min_chars if exact_chars is None else max(1, min(exact_chars, min_chars)))
    firsts = lines.groupBy("_h", "_g").agg(F.min("_ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "line-firsts")
    rules = firsts.select("_h", "_g", "first", F.lit(False).alias("near"))
    if max_edits:
        near = materialize(near_lines(lines.where(F.col("_n") >= min_chars)), "line-near")
        rules = rules.unionByName(near.select("_h", "_g", F.lit(None).cast(rules.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
    rules = rules.groupBy("_h", "_g").agg(F.min("first").alias("first"), F.max("near").alias("near"))
    met = _meet(lines.select("_id", "_tk", "_ord", "_h", "_g"), rules, firsts)
    gone = met.where(F.col("near") | (F.col("first") < F.col("_ord")))
    return gone.groupBy("_id", "_tk").agg(F.collect_set("_ord.n").alias("_lines"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, max_edits: int = 1, exact_chars: int | None = None
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and lines_total and lines_dropped (long)."""
    gone = dropped_lines(docs, id_col, text_col, min_chars, max_edits, exact_chars)
    names = [c for c in docs.columns if c.lower() not in ("lines_total", "lines_dropped")]
    dk, gid, gtk, dropped = fresh(docs, "_dk", "_id", "_tk", "_lines")
    gone = gone.select(F.col("_id").alias(gid), F.col("_tk").alias(gtk), F.col("_lines").alias(dropped))
    keyed = docs.select(*map(col, names), F.xxhash64(col(text_col)).alias(dk))
    joined = keyed.join(gone, col(id_col).eqNullSafe(col(gid)) & (col(dk) == col(gtk)), "left")
    parts = F.split(col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), col(dropped))  # by hash, in the order of the lines
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    text = F.when(col(dropped).isNull(), col(text_col)).otherwise(kept)
    total = F.when(F.coalesce(F.length(col(text_col)), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(parts))
    return joined.select(
        *[text.alias(c) if c == text_col else col(c) for c in names],
        total.cast("long").alias("lines_total"),
        F.coalesce(F.size(col(dropped)), F.lit(0)).cast("long").alias("lines_dropped"),
    )
