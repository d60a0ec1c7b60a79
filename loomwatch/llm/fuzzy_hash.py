"""Context-triggered piecewise hashes of documents, and their likeness.

A hash rolls over the last seven bytes of a text. Where it is one less than a multiple of the block
size 3 * 2^level, a piece ends, so pieces are cut by what stands there and not by position, and an
edit changes only the pieces that it touches. Each piece gives two characters of the signature. The
level is the largest at which a text has ``LEAST`` triggers, of those at which it has ``MOST`` at most;
where there is none, the smallest of the latter. The fingerprint holds the level and the signatures of
that level and the next: ``level:signature:signature``. Texts that repeat few passages may go from very
many triggers to none in one level; such a text is one piece, and like nothing but itself.

Two fingerprints are compatible where they have a block size in common; their likeness is one less
the edit distance of the two signatures, in pieces, over the longer one's pieces: the best of the
block sizes in common, and 0 without any.

Documents stand in the order of descending id. The edited text of a document ends in the beginning
of the document that follows it. The table is dealt by ranges of that order, once, and each task
reads its range as a stream and holds two documents. The last document of a range meets the first
of the next in a join of one row a range.

Defined cases: a null text is an empty one; the empty text has no pieces, and its likeness is 1 to
itself and 0 to all others; equal texts have equal fingerprints; equal ids follow an order by their
texts' hashes, repeated rows follow each other; null ids come last; a text of any length is read
whole, in stretches of ``STRETCH`` bytes; the next document of a single one is itself; an empty table
gives an empty table; other input columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from loomwatch.llm.names import col
from loomwatch.session import materialize

WINDOW, SMALLEST = 7, 3
LEAST, MOST = 32, 1024
STRETCH = 1 << 20
PERIOD = 1 << 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
POWERS = np.cumprod(np.full(PERIOD, 6364136223846793005, dtype=np.uint64))


def triggers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, levels): where pieces may end, and the largest level at which they do."""
    places, levels = [], []
    for start in range(0, len(data), STRETCH):
        own = data[start : start + STRETCH]
        padded = np.zeros(len(own) + WINDOW - 1, dtype=np.uint32)
        padded[WINDOW - 1 :] = own
        if start:
            padded[: WINDOW - 1] = data[start - WINDOW + 1 : start]
        weighted, mixed = np.zeros(len(own), dtype=np.uint32), np.zeros(len(own), dtype=np.uint32)
        for back in range(WINDOW):
            byte = padded[WINDOW - 1 - back : len(padded) - back]
            weighted += byte * np.uint32(WINDOW + 1 - back)  # the sum of the window and the weighted sum
            mixed ^= byte << np.uint32(5 * back)
        rolled = (weighted + mixed).astype(np.int64) + 1
        at = np.flatnonzero(rolled % SMALLEST == 0)
        blocks = rolled[at] // SMALLEST
        places.append(at + start)
        levels.append(np.frexp((blocks & -blocks).astype(np.float64))[1] - 1)
    return (np.concatenate(places), np.concatenate(levels)) if places else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def signature(data: np.ndarray, ends: np.ndarray) -> str:
    """Two characters for each piece; ``ends`` are the positions of the last bytes of all pieces but perhaps the last."""
    if not len(data):
        return ""
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(data)]
    sums = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, len(data), STRETCH):
        own = data[at : at + STRETCH].astype(np.uint64) + np.uint64(1)
        first, last = np.searchsorted(starts, [at, at + len(own)])
        cuts, piece = starts[first:last] - at, np.arange(first, last)
        if not len(cuts) or cuts[0]:  # the stretch begins within a piece
            cuts, piece = np.concatenate([[0], cuts]), np.concatenate([[first - 1], piece])
        lengths = np.diff(np.append(cuts, len(own)))
        within = np.arange(at, at + len(own)) - np.repeat(starts[piece], lengths)
        sums[piece] += np.add.reduceat(own * POWERS[within & (PERIOD - 1)], cuts)
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return "".join([PAIRS[x] for x in (sums >> np.uint64(52)).tolist()])


def of_pieces(data: bytes, places: np.ndarray, levels: np.ndarray) -> str:
    """The fingerprint of a text with these triggers."""
    b = np.frombuffer(data, dtype=np.uint8)
    count = np.cumsum(np.bincount(levels, minlength=1)[::-1])[::-1]  # triggers of each level and beyond
    first = int((count > MOST).sum())
    level = max(first, int((count >= LEAST).sum()) - 1)
    return f"{level}:{signature(b, places[levels >= level])}:{signature(b, places[levels > level])}"


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes."""
    return of_pieces(data, *triggers(np.frombuffer(data, dtype=np.uint8)))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Insertions, deletions and replacements between two lists, a bit for each item of ``a``."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b or not set(a) & set(b):
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top, up, down, distance = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for x in b:
        same = at.get(x, 0)
        zero = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(zero | up) & full, up & zero
        distance += bool(plus & top) - bool(minus & top)
        plus = plus << 1 | 1
        up, down = (minus << 1 | ~(zero | plus)) & full, plus & zero & full
    return distance


def likeness(a: str, b: str) -> float:
    """From 0 to 1, by the signatures at the block sizes that both have."""
    if a == b:
        return 1.0
    (i, *one), (j, *two) = a.split(":"), b.split(":")
    best = 0.0
    for k, x in enumerate(one, int(i)):
        if 0 <= k - int(j) < 2 and (x and two[k - int(j)]):
            p, q = ([s[n : n + 2] for n in range(0, len(s), 2)] for s in (x, two[k - int(j)]))
            best = max(best, 1 - edit_distance(p, q) / max(len(p), len(q)))
    return best


def code_points(data: bytes) -> np.ndarray:
    """Where each code point begins."""
    return np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)


class Doc:
    """A text with its code points, triggers and fingerprint."""

    def __init__(self, data: bytes | None) -> None:
        self.data = data or b""
        self.points = code_points(self.data)
        self.places, self.levels = triggers(np.frombuffer(self.data, dtype=np.uint8))
        self.fingerprint = of_pieces(self.data, self.places, self.levels)

    def cut(self, n: int) -> int:
        """The bytes of the first ``n`` code points, or of all."""
        return int(self.points[n]) if n < len(self.points) else len(self.data)


def edited(doc: Doc, after: Doc) -> tuple[bytes, str]:
    """``doc`` with its last third replaced by as many code points of ``after``, and the fingerprint of that.

    Triggers are those of the two texts, but for the few bytes after the seam.
    """
    n, reach = len(doc.points), WINDOW - 1
    a, b = doc.cut(n - n // 3), after.cut(n // 3)
    data = doc.data[:a] + after.data[:b]
    begin = max(0, a - reach)
    at, level = triggers(np.frombuffer(data[begin : a + reach], dtype=np.uint8))
    at += begin
    left, seam, right = doc.places < a, at >= a, (after.places >= reach) & (after.places < b)
    places = np.concatenate([doc.places[left], at[seam], after.places[right] + a])
    return data, of_pieces(data, places, np.concatenate([doc.levels[left], level[seam], after.levels[right]]))


def finish(doc: Doc, after: Doc) -> tuple:
    """(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of a document and the one that follows."""
    data, other = edited(doc, after)
    return len(doc.points), hashlib.sha256(data).hexdigest(), doc.fingerprint, other, likeness(doc.fingerprint, other), likeness(doc.fingerprint, after.fingerprint)


FOUND = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(ids: pa.Array, rows: list[tuple], shape: dict[str, str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(shape)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, _KINDS[k]) for c, k in zip(columns, shape.values(), strict=True)]], names=["id", *shape])


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Every document with what ``finish`` gives (null for the last of a range), the range's number, and the texts at its two ends."""
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("tie")]
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    shape = FOUND | {"range": "int", "first": "boolean", "open": "boolean", "end": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, kept, first = TaskContext.get().partitionId(), None, None, True
        for batch in batches:
            rows, ids = [], []
            for i, data in enumerate(batch.column(1).cast(pa.binary())):
                doc = Doc(data.as_py())
                if before is not None:
                    rows.append((*finish(before, doc), number, first, False, before.data if first else None))
                    ids.append(kept)
                    first = False
                before, kept = doc, batch.column(0)[i]
            yield _batch(pa.array([x.as_py() for x in ids], batch.schema.field(0).type), rows, shape)
        if before is not None:
            rows = [(*[None] * len(FOUND), number, first, True, before.data)]
            yield _batch(pa.array([kept.as_py()], kept.type), rows, shape)

    kind = docs.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, ", ".join([f"id {kind}", *[f"`{n}` {k}" for n, k in shape.items()]]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to that and to the next document."""
    slim = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = materialize(_in_ranges(slim), "fingerprints")
    heads = found.where("first").select(F.col("range").alias("r"), F.col("end").alias("after"))
    # One number for each range: as many as tasks.
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.first("range").over(every))
    links = found.where("open").select("range", following.alias("r"))
    ends = found.where("open").select("id", "range", "end").join(links, "range").join(heads, "r").select("id", "end", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [finish(Doc(a), Doc(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield _batch(batch.column(0), rows, FOUND)

    kind = slim.schema["id"].dataType.simpleString()
    closed = ends.mapInArrow(run, ", ".join([f"id {kind}", *[f"`{n}` {k}" for n, k in FOUND.items()]]))
    return found.where("not open").select("id", *FOUND).unionByName(closed).withColumnRenamed("id", id_col)
