"""Vector compression by product codes, fitted by member-resident Lloyd rounds.

Components become integers, floor(256 * x). A vector is cut into consecutive parts, and each part
position has a codebook of up to ``entries`` entries, which start as the parts of the smallest ids.

Parts live with the owner of their entry: the table of residents is partitioned by (position,
entry, salt), and holds blocks of distinct parts with how often each occurs. A round is

1. owners sum their resident members, and the sums of an entry's salts give the new entry: a few
   numbers leave each task, no member does;
2. owners measure their residents against the new codebook. Those that stay are written where they
   are; only those that change their entry go through the shuffle, to their new owner.

The salt of a block is a checksum of its content, so an entry that most parts choose is spread over
``salts`` owners. At last each vector is encoded by the final codebooks where it is read.

What reaches the driver are codebooks: ``entries`` times the dimension numbers, whatever the input.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are
dropped, and so are vectors of another length than that of the smallest id. With fewer ids than
entries, codebooks are smaller. A repeated id starts one entry, by its smallest vector; null is the
last id. Repeated rows each count and each get their code. Parts are equal where the
length allows; shorter vectors than ``parts`` have empty parts, code 00. Components whose squared
distances would leave 64 bits (beyond some 500,000 at 64 dimensions) saturate. An empty table
gives an empty table; input columns named like the added ones are replaced, others returned.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

PARTS, ENTRIES, ROUNDS, SALTS = 16, 64, 2, 64
SCALE = 256
#: Totals of labels up to this many are broadcast; more are joined by a salted shuffle.
BROADCAST_LABELS = 50_000
LABEL_SALTS = 16

BLOCKS = "position int, entry int, salt int, members binary, counts binary"
OWNER = ["position", "entry", "salt"]


@dataclass
class Codebooks:
    """One array (entries x width) of integers for each part position, and where the parts are cut."""

    dim: int
    books: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        return [p * self.dim // len(self.books) for p in range(len(self.books) + 1)]

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimals joined by commas."""
        text = ",".join(str(int(x)) for book in self.books for x in book.ravel())
        return hashlib.sha256(text.encode()).hexdigest()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower index of equals, and its squared distance; all exact."""
    if parts.shape[1] == 0 or len(parts) == 0:
        return np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    top = max(int(np.abs(parts).max()), int(np.abs(book).max()))
    if 4 * parts.shape[1] * top * top < 2**52:  # doubles hold every sum exactly
        p, b = parts.astype(np.float64), book.astype(np.float64)
        d = (b * b).sum(axis=1) - 2 * (p @ b.T)
        best = d.argmin(axis=1)
        return best, (d[np.arange(len(p)), best] + (p * p).sum(axis=1)).astype(np.int64)
    best, least = np.zeros(len(parts), dtype=np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    for i, entry in enumerate(book):
        d = ((parts - entry) ** 2).sum(axis=1)
        best, least = np.where(d < least, i, best), np.minimum(d, least)
    return best, least


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), within what squared distances of so many components can be held for."""
    limit = math.floor(2**30 / math.sqrt(vectors.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -limit, limit).astype(np.int64)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _starts(kept: DataFrame, entries: int) -> list:
    """The vectors of the ``entries`` smallest ids, by passes that each give up to ``entries`` rows (one, unless ids repeat)."""
    found: dict[object, list] = {}
    rest = kept
    while len(found) < entries:
        rows = rest.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        for r in rows:
            found.setdefault(r["id"], r["v"])
        if not rows or rows[-1]["id"] is None:
            break
        rest = kept.where((F.col("id") > F.lit(rows[-1]["id"])) | F.col("id").isNull())
    return list(found.values())[:entries]


def _blocks(position: int, parts: np.ndarray, counts: np.ndarray, entry: np.ndarray, salts: int, into: dict[str, list]) -> None:
    """Puts one block for each entry that parts have chosen."""
    order = np.argsort(entry, kind="stable")
    parts, counts, entry = parts[order], counts[order], entry[order]
    edges = np.flatnonzero(np.diff(entry)) + 1
    for a, b in zip([0, *edges], [*edges, len(entry)], strict=True):
        members = parts[a:b].tobytes()
        for name, value in zip(into, (position, int(entry[a]), zlib.crc32(members) % salts, members, counts[a:b].tobytes()), strict=False):
            into[name].append(value)


def _batch(into: dict[str, list], **more: list) -> pa.RecordBatch:
    kinds = {"members": pa.binary(), "counts": pa.binary(), "moved": pa.bool_()}
    columns = into | more
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int32())) for k, v in columns.items()], names=list(columns))


def _empty() -> dict[str, list]:
    return {"position": [], "entry": [], "salt": [], "members": [], "counts": []}


def _settle(kept: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """The first residents: every part, under the entry that is nearest at the start."""
    cuts = books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = integers(_rows(batch.column(0), books.dim)), _empty()
            for p, book in enumerate(books.books if len(x) else []):
                if cuts[p] < cuts[p + 1]:
                    parts, counts = np.unique(x[:, cuts[p] : cuts[p + 1]], axis=0, return_counts=True)
                    _blocks(p, parts, counts, nearest(parts, book)[0], salts, out)
            yield _batch(out)

    return materialize(kept.select("v").mapInArrow(run, BLOCKS).repartition(*OWNER), "codes-residents")


def _members(batch: pa.RecordBatch, cuts: list[int]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    for p, e, s, m, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
        yield p, e, s, np.frombuffer(m, dtype=np.int64).reshape(-1, cuts[p + 1] - cuts[p]), np.frombuffer(c, dtype=np.int64)


def _update(residents: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floor of its members' mean; those without members stay."""
    cuts = books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p, e, _, members, counts in _members(batch, cuts):
                total = np.append(counts @ members, counts.sum())
                sums[p, e] = sums[p, e] + total if (p, e) in sums else total
        rows = [(p, e, i, int(x)) for (p, e), total in sums.items() for i, x in enumerate(total)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["position", "entry", "at", "x"])

    parts = residents.select(*OWNER, "members", "counts").mapInArrow(run, "position int, entry int, at int, x long")
    found = parts.groupBy("position", "entry", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    totals: dict[tuple[int, int], dict[int, int]] = {}
    for r in found.collect():  # at most entries x (dimension + positions) numbers
        totals.setdefault((r["position"], r["entry"]), {})[r["at"]] = int(r["x"])
    new = [book.copy() for book in books.books]
    for (p, e), total in totals.items():
        width = cuts[p + 1] - cuts[p]
        new[p][e] = [total[i] // total[width] for i in range(width)]
    return Codebooks(books.dim, new)


def _migrate(residents: DataFrame, books: Codebooks, salts: int) -> DataFrame:
    """The residents under the new codebooks: those that stay, where they were, and those that moved, with their new owners."""
    cuts = books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay, leaving, gone = _empty(), {}, _empty()
            for p, e, s, members, counts in _members(batch, cuts):
                to = nearest(members, books.books[p])[0]
                same = to == e
                if same.any():
                    for name, value in zip(stay, (p, e, s, members[same].tobytes(), counts[same].tobytes()), strict=True):
                        stay[name].append(value)
                if not same.all():
                    leaving.setdefault(p, []).append((members[~same], counts[~same], to[~same]))
            for p, some in leaving.items():
                _blocks(p, *(np.concatenate(x) for x in zip(*some, strict=True)), salts, gone)
            yield _batch(stay, moved=[False] * len(stay["salt"]))
            yield _batch(gone, moved=[True] * len(gone["salt"]))

    judged = materialize(residents.select(*OWNER, "members", "counts").mapInArrow(run, f"{BLOCKS}, moved boolean"), "codes-judged")
    arrived = materialize(judged.where("moved").drop("moved").repartition(*OWNER), "codes-moved")
    return judged.where("not moved").drop("moved").unionByName(arrived)


def fit_codebooks(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, salts: int = SALTS
) -> Codebooks:
    """Codebooks of all usable vectors after ``rounds`` rounds; of no dimension if there are none."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    kept = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    starts = _starts(kept, entries)
    if not starts:
        return Codebooks(0, [np.zeros((0, 0), dtype=np.int64)] * parts)
    dim = len(starts[0])
    kept = kept.where(F.size("v") == dim)
    if any(len(v) != dim for v in starts):
        starts = _starts(kept, entries)
    first = integers(np.array(starts))
    books = Codebooks(dim, [first[:, p * dim // parts : (p + 1) * dim // parts] for p in range(parts)])
    residents = _settle(kept, books, salts) if rounds else None
    for i in range(rounds):
        books = _update(residents, books)
        if i + 1 < rounds:
            residents = _migrate(residents, books, salts)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", code_col: str = "code", error_col: str = "error") -> DataFrame:
    """The usable rows with code (two hex digits a part) and error (squared distance of all parts), without the vector."""
    (v,) = fresh(vectors, "_v")
    others = [c for c in vectors.columns if c not in (vector_col, code_col, error_col)]
    kept = vectors.select(*[col(c) for c in others], col(vector_col).cast("array<double>").alias(v))
    kept = kept.where(usable(F.col(v)) & (F.size(v) == books.dim))
    cuts = books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_rows(batch.column(len(others)), books.dim)) if batch.num_rows else np.zeros((0, books.dim), dtype=np.int64)
            codes, error = np.zeros((len(x), len(books.books)), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(books.books):
                best, d = nearest(x[:, cuts[p] : cuts[p + 1]], book)
                codes[:, p] = best
                error += d
            text = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], text, pa.array(error)], names=[*others, code_col, error_col])

    shape = kept.drop(v).withColumns({code_col: F.lit(""), error_col: F.lit(0).cast("long")}).schema
    return kept.mapInArrow(run, shape)


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the vector of the entries that its code names, by lookups in the row."""
    found = []
    for p, book in enumerate(books.books):
        entries = F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]).cast("array<double>") for entry in book])
        found.append(F.get(entries, F.conv(F.substring(col(code_col), 2 * p + 1, 2), 16, 10).cast("int")))
    return coded.withColumn(out_col, F.concat(*found))


def with_label_error(coded: DataFrame, label_col: str = "label", error_col: str = "error", out_col: str = "label_error") -> DataFrame:
    """``coded`` with the error summed over rows of an equal label, nulls together; null where the sum leaves 64 bits."""
    label, total, salt, s = fresh(coded, "_label", "_total", "_salt", "_s")
    totals = materialize(coded.groupBy(col(label_col).alias(label)).agg(F.sum(col(error_col).cast("decimal(20,0)")).try_cast("long").alias(total)), "label-errors")
    if totals.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(totals), col(label_col).eqNullSafe(F.col(label)), "left")
    else:
        dealt = coded.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(LABEL_SALTS)))
        every = totals.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
        joined = dealt.join(every, col(label_col).eqNullSafe(F.col(label)) & (F.col(salt) == F.col(s)), "left")
    return joined.select(*[col(c) for c in coded.columns if c != out_col], F.col(total).alias(out_col))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code, error, label_error and codebooks_sha256 of every usable vector."""
    books = fit_codebooks(vectors, id_col, vector_col)
    slim = vectors.select(*[col(c) for c in dict.fromkeys((id_col, label_col, vector_col))])
    coded = materialize(encode(slim, books, vector_col), "codes")
    return with_label_error(coded, label_col).withColumn("codebooks_sha256", F.lit(books.digest()))
