"""Near-duplicate groups: banded MinHash, odd sketches, confirmation on full shingle sets.

Words are what stands between ASCII white space, A-Z lower-cased; a document's set holds its
distinct five-word shingles (all its words as one, if fewer). 128 MinHash samples make 32 bands
of four. The same samples are folded into a 1024-bit odd sketch: each sample flips one bit, so
the population count of two sketches' XOR tells how many samples differ, and estimates a high
similarity far better than the bands. Pairs whose estimate lies ``MARGIN`` (five standard
errors) under the threshold go; all others are confirmed or refuted on the full sets.

Copies: documents with equal sets are one class, met by an aggregate, and never paired.
Hot buckets: a bucket of n classes gives n - 1 pairs, each with its smallest class; confirmed
pairs are joined into components. Only then, and only in buckets that still hold several
components, are the pairs between components compared: in small buckets by an equi-join, in
large ones tile by tile with numpy, first over the sketches and then over the full sets, so that
no pair of a bucket goes unexamined and a tile returns no more links than it has components.

A pair of similarity s shares no band with probability (1 - s^4)^32: 5e-6 at 0.75, 5e-8 at 0.8.

Both bounds are chances, set so low that brute force finds no difference on the test tables: the
bands' and the sketch margin's (five standard errors: under 1e-6 a pair).

Defined cases: a text without words (null, empty) has an empty set, its own component and is
kept; a null doc_id has a null component and is kept; rows with equal doc_id and text come back
alike; rows with one doc_id and different texts are linked through that id; a text of any length is
read whole; an empty table gives an empty table; other input columns, whatever their names, play
no part (``keep_one_each`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.components import connected_components
from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

BANDS, ROWS, BITS, WIDTH, PERCENT = 32, 4, 1024, 5, 75
#: Five standard errors of the estimate from 128 samples at the threshold.
MARGIN = 0.22
#: Buckets up to SMALL rows are joined; larger ones are compared in tiles of about TILE by TILE
#: rows, fewer where their sets hold more than TILE_SHINGLES, so that a tile's memory is bounded.
SMALL, TILE, TILE_SHINGLES = 16, 256, 1 << 19

_RNG = np.random.RandomState(20240229)


def _odd(n: int) -> np.ndarray:
    return _RNG.randint(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE, _SAMPLE, _SHIFT, _ROW, _BAND, _FOLD = _odd(WIDTH), _odd(BANDS * ROWS), _odd(BANDS * ROWS), _odd(ROWS), _odd(BANDS), _odd(BANDS * ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.array([], dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        return _mix(np.array([(each * _PLACE[: len(words)]).sum() + np.uint64(len(words))], dtype=np.uint64))
    n = len(words) - width + 1
    total = each[:n] * _PLACE[0]
    for j in range(1, width):
        total += each[j : j + n] * _PLACE[j]
    return np.unique(_mix(total))


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * _SAMPLE + _SHIFT).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mix((least.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity of how many samples fall on each of ``BITS`` bits, as 64-bit numbers."""
    bits = np.bincount((_mix(least * _FOLD) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits."""
    left = np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9)
    return 1 + BITS / (4 * BANDS * ROWS) * np.log(left)


#: The most differing bits of a pair that is looked at further.
MOST_BITS = int(np.floor(BITS / 2 * (1 - np.exp((PERCENT / 100 - MARGIN - 1) * 4 * BANDS * ROWS / BITS))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, n, s1, s2, bands, sketch): set size, set hash, band keys and odd sketch of each row."""
    import xxhash  # noqa: F401  (fails here rather than in a task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, s1, s2, bands, sketches = [], [], [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py())
                n.append(len(shingles))
                whole = xxhash.xxh3_128_digest(shingles.tobytes())
                first, second = np.frombuffer(whole, dtype=np.int64)
                s1.append(first)
                s2.append(second)
                if len(shingles):
                    least = samples(shingles)
                    bands.append(band_keys(least))
                    sketches.append(odd_sketch(least))
                else:
                    bands.append(None)
                    sketches.append(None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketches)]
            longs = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, *lists], ["id", "tk", "n", "s1", "s2", "bands", "sketch"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, tk long, n long, s1 long, s2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, shingles) of the documents in ``wanted`` (rep, tk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["rep", "shingles"])

    keyed = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    return keyed.join(wanted, ["rep", "tk"], "left_semi").select("rep", "text").mapInArrow(run, "rep long, shingles array<long>").dropDuplicates(["rep"])


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sketches and then whose full sets are similar enough."""
    left = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    sized = pairs.join(right, "b").join(left, "a")
    fits = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (_differing(F.col("sa"), F.col("sb")) <= MOST_BITS)
    likely = materialize(sized.where(fits).select("a", "b"), "likely-pairs")
    nodes = likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct()
    wanted = classes.select("rep", "tk").join(nodes, "rep", "left_semi")
    sets = materialize(full_sets(docs, wanted, id_col, text_col), "full-sets")
    both = likely.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    both = both.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a")
    common = F.size(F.array_intersect("xa", "xb"))
    return both.where(100 * common >= PERCENT * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def common_counts(sets: list[np.ndarray], others: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set with every other set.

    Shingles become columns of two 0/1 matrices, a chunk of columns at a time; their product counts.
    """
    lengths = [len(x) for x in (*sets, *others)]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, column = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(others)), dtype=np.float64)
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, chunk):
        lo, hi = np.searchsorted(column, [first, first + chunk])
        part = np.zeros((len(lengths), min(chunk, last - first)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        total += part[: len(sets)] @ part[len(sets) :].T
    return total.astype(np.int64)


def tile_edges(reps: tuple, components: tuple, sketches: tuple, sets: tuple, same: bool) -> list[tuple[int, int]]:
    """Links between different components of two blocks (each argument holds both blocks' values).

    Sketches choose the pairs, the full sets decide; of links that join the same components only
    enough to join them are kept.
    """
    near = np.stack([np.bitwise_count(row ^ sketches[1]).sum(axis=1) <= MOST_BITS for row in sketches[0]])
    near &= components[0][:, None] != components[1][None, :]
    if same:
        near &= np.triu(np.ones(near.shape, dtype=bool), 1)
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    left, right = [sets[0][i] for i in rows], [sets[1][i] for i in columns]
    common = common_counts(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    linked = near[np.ix_(rows, columns)] & (100 * common >= PERCENT * union)
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    edges = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        i, j = rows[i], columns[j]
        one, two = top(int(components[0][i])), top(int(components[1][j]))
        if one != two:
            above[max(one, two)] = min(one, two)
            edges.append((int(reps[0][i]), int(reps[1][j])))
    return edges


def _tile_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of large buckets, two blocks of a bucket at a time."""
    blocks = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    placed = members.withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("blocks", blocks)
    # Block i takes part in the tiles (i, j), i <= j, and (j, i), j < i.
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("blk", j).alias("i"), F.greatest("blk", j).alias("j")))
    dealt = placed.join(sets, "rep").select("key", "rep", "component", "sketch", "shingles", "blk", F.explode(tiles).alias("t"))
    dealt = dealt.select("key", "t.i", "t.j", "rep", "component", "sketch", "shingles", "blk")

    def compare(key, pdf):
        import pandas as pd

        parts = [pdf[pdf.blk == key[1]], pdf[pdf.blk == key[2]]]
        found = []
        if len(parts[0]) and len(parts[1]):
            found = tile_edges(
                tuple(p.rep.to_numpy() for p in parts), tuple(p.component.to_numpy() for p in parts),
                tuple(np.stack(p.sketch.to_numpy()).view(np.uint64) for p in parts), tuple(list(p.shingles) for p in parts), key[1] == key[2],
            )
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, n_shingles, component_id, kept) of each row; tk is xxhash64 of the text."""
    rows = materialize(features(docs, id_col, text_col), "minhash-rows")
    full = rows.where("n > 0 and id is not null")
    classes = full.groupBy("s1", "s2").agg(F.min(F.struct("id", "tk", "n", "bands", "sketch")).alias("c"))
    classes = materialize(classes.select("s1", "s2", F.col("c.id").alias("rep"), "c.tk", "c.n", "c.bands", "c.sketch"), "minhash-classes")
    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    stars = keys.join(shared, "key").where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = materialize(stars, "star-pairs")
    edges = materialize(_confirmed(stars, classes, docs, id_col, text_col), "star-edges")
    labels = connected_components(edges)

    # Buckets that hold several components: every pair between them that was not tried.
    own = F.coalesce("component", "rep")
    placed = keys.join(shared.select("key"), "key", "left_semi").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", own.alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("total"))
    mixed = materialize(mixed.where("lo < hi and size > 2").select("key", "size", "total"), "mixed-buckets")
    if mixed.isEmpty():
        rest = None
    else:
        members = placed.join(mixed, "key")
        small = members.where(F.col("size") <= SMALL).select("key", F.col("rep").alias("a"), F.col("component").alias("ca"))
        other = small.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"))
        pairs = small.join(other, "key").where("a < b and ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
        large = members.where(F.col("size") > SMALL).select("key", "size", "total", "rep", "component").join(classes.select("rep", "sketch"), "rep")
        wanted = classes.select("rep", "tk").join(large.select("rep").distinct(), "rep", "left_semi")
        sets = materialize(full_sets(docs, wanted, id_col, text_col), "bucket-sets")
        few = _confirmed(pairs, classes, docs, id_col, text_col)
        rest = materialize(few.union(_tile_links(large, sets)), "rest-edges")
    if rest is not None and not rest.isEmpty():
        labels = connected_components(edges.union(rest))
    named = classes.select("s1", "s2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", own.alias("component"))
    grouped = rows.select("id", "tk", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return grouped.select(
        F.col("id").alias("doc_id"), "tk", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select("doc_id", "tk").distinct()
    dk, gid, gtk = fresh(docs, "_dk", "_gid", "_gtk")
    gone = gone.select(F.col("doc_id").alias(gid), F.col("tk").alias(gtk))
    keyed = docs.withColumn(dk, F.xxhash64(col(text_col)))
    return keyed.join(gone, (col(id_col) == col(gid)) & (col(dk) == col(gtk)), "left_anti").select(*map(col, docs.columns))
