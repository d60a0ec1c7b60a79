"""A Merkle manifest of a table: leaves per row, a tree per group, a tree over the groups.

A node is the SHA-256 of its children's digests as hex text. Each parent keeps the hash state as it
stood before every child slot (``hashlib`` states, copied). To fold a changed leaf, the matching
state is resumed with the replacement and the siblings to its right only: what stands left of it is
never hashed again.

Hash states live in one process, so trees are built in blocks: a block is a full subtree of up to
``arity ** height`` consecutive nodes of one group, built, kept and folded in one task. The roots of
the blocks are the leaves of the next table, so three tables hold a thousand million leaves a group.
On the way down each block gets the path from its root to the root of all (the digests left and
right of it, level by level); the states on that path are made once a block and resumed by every
leaf. No task sees more than a block.

Positions within a group come from a range partitioning by (group, order), counted per partition,
so a group of any share of the rows is dealt over many tasks.

Defined cases: a null value is ``-`` in a leaf, any other its UTF-8 byte count, ``:`` and the value;
a null group is a group of its own, the first; a null id comes before all others in its group and is
never tampered with by the rule on ids; equal ids follow the order of their leaves, and repeated rows
are leaves of their own; texts of any length are hashed in the JVM and sent nowhere; an empty table
gives an empty table; other input columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loomwatch.llm.names import col
from loomwatch.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, HEIGHT = 2, 10
#: Offsets of range partitions up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_OFFSETS = 100_000

PATH = "array<struct<left: binary, right: binary>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest (32 bytes) of a row's values in order."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


# --- one block, in Python


class Block:
    """A subtree with, for each parent, the hash states before its child slots."""

    def __init__(self, digests: list[bytes], arity: int, levels: int | None) -> None:
        """``levels`` above the leaves; None: until one node is left."""
        self.arity, self.nodes, self.states = arity, [digests], []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            below, above, kept = self.nodes[-1], [], []
            for i in range(0, len(below), arity):
                h, before = hashlib.sha256(), []
                for child in below[i : i + arity]:
                    before.append(h.copy())
                    h.update(child)
                kept.append(before)
                above.append(h.hexdigest().encode())
            self.nodes.append(above)
            self.states.append(kept)

    @property
    def root(self) -> bytes:
        return self.nodes[-1][0]

    def others(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        """Digests left and right of leaf ``i``'s path, level by level."""
        for below in self.nodes[:-1]:
            first = i - i % self.arity
            yield b"".join(below[first:i]), b"".join(below[i + 1 : first + self.arity])
            i //= self.arity

    def fold(self, i: int, value: bytes) -> bytes:
        """The root with ``value`` in place of leaf ``i``, from the states before its slots."""
        for below, kept in zip(self.nodes, self.states, strict=False):
            h = kept[i // self.arity][i % self.arity].copy()
            h.update(value)
            for right in below[i + 1 : i - i % self.arity + self.arity]:
                h.update(right)
            value = h.hexdigest().encode()
            i //= self.arity
        return value


def _text(digest: bytes) -> bytes:
    return digest.hex().encode()


def _block(members: list[dict], total: int, arity: int, height: int) -> Block:
    return Block([_text(m["digest"]) for m in members], arity, None if total <= arity**height else height)


# --- tables of blocks


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with i, the place within the group, and total, the group's size; no task holds a group."""
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    rows = materialize(placed.withColumn("_m", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit(2**33 - 1)))
    counts = rows.groupBy(group, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    per = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(per.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(group, "_p", (before - F.col("_first")).alias("_off"), F.sum("_n").over(per).alias("total"))
    offsets = materialize(offsets, "merkle-offsets")  # a row for each partition and group in it
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, [group, "_p"]).select(*df.columns, (F.col("_at") + F.col("_off")).alias("i"), "total")


def _pack(nodes: DataFrame, fields: list[str], size: int) -> DataFrame:
    """(g, b, total, members): a row a block, its members in order; ``size`` of them at most."""
    members = F.array_sort(F.collect_list(F.struct("i", *fields)))
    packed = nodes.groupBy("g", F.floor(F.col("i") / size).alias("b")).agg(F.first("total").alias("total"), members.alias("members"))
    return materialize(packed, "merkle-blocks")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time: only one is held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [[]] * len(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def grow(nodes: DataFrame, fields: list[str], arity: int = ARITY, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves (g, i, total, fields with digest) up, and (g, digest), each group's root."""
    size, tables = arity**height, []
    shape = T.StructType.fromDDL("g string, i long, digest binary, total long")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            root = _block(r["members"], r["total"], arity, height).root
            yield _batch(shape, [(r["g"], r["b"], bytes.fromhex(root.decode()), -(-r["total"] // size))])

    while True:
        tables.append(_pack(nodes, fields, size))
        nodes = materialize(tables[-1].mapInArrow(roots, shape), "merkle-roots")
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return tables, nodes.select("g", "digest")
        fields = ["digest"]


def descend(table: DataFrame, paths: DataFrame, key: str, arity: int, height: int) -> DataFrame:
    """(``key`` as g, i as b, subroot, path) of the members of blocks whose own (g, b, subroot, path) are in ``paths``."""
    shape = T.StructType.fromDDL(f"g string, b long, subroot binary, path {PATH}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            rows, block = [], _block(r["members"], r["total"], arity, height)
            for j, m in enumerate(r["members"]):
                own = [{"left": a, "right": b} for a, b in block.others(j)]
                mine = (r["g"], m["i"], r["subroot"]) if key == "g" else (m[key], 0, m["digest"])
                rows.append((*mine, own + r["path"]))
            yield _batch(shape, rows)

    return materialize(table.join(paths, ["g", "b"]).mapInArrow(run, shape), "merkle-paths")


def prove(table: DataFrame, paths: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """(carried, leaf, subroot, proof_sha256, folded_root) of every leaf; ``tampered`` replaces a leaf where it is not null."""
    members = next(f for f in table.schema if f.name == "members").dataType.elementType
    kept = T.StructType([members[c] for c in carried])
    shape = T.StructType([*kept, *T.StructType.fromDDL("leaf string, subroot string, proof_sha256 string, folded_root string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            block = _block(r["members"], r["total"], arity, height)
            above = [(hashlib.sha256(x["left"]), x["right"]) for x in r["path"]]
            rest = b"".join(x["left"] + x["right"] for x in r["path"])
            rows = []
            for j, m in enumerate(r["members"]):
                proof = hashlib.sha256(b"".join(a + b for a, b in block.others(j)) + rest)
                value = block.fold(j, _text(m["digest"] if m["tampered"] is None else m["tampered"]))
                for state, right in above:
                    h = state.copy()
                    h.update(value)
                    h.update(right)
                    value = h.hexdigest().encode()
                rows.append((*[m[c] for c in carried], m["digest"].hex(), r["subroot"].hex(), proof.hexdigest(), value.decode()))
            yield _batch(shape, rows)

    return table.join(paths, ["g", "b"]).mapInArrow(run, shape)


def manifest(
    docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, height: int = HEIGHT,
    tamper: Column | None = None, changed: dict[str, Column] | None = None,
) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows where ``tamper`` holds are folded with the values of ``changed`` in place of their own; the
    tree and the proofs are those of the untouched table.
    """
    of = {f: col(f) for f in fields}
    g = F.coalesce(F.concat(F.lit("+"), col(group_col).cast("string")), F.lit(""))
    other = F.when(tamper, leaf(*[(changed or {}).get(f, c) for f, c in of.items()])) if tamper is not None else F.lit(None).cast("binary")
    leaves = materialize(docs.select(g.alias("g"), col(id_col).alias("id"), leaf(*of.values()).alias("digest"), other.alias("tampered")), "merkle-leaves")
    tables, subroots = grow(numbered(leaves, "g", ["id", "digest"]), ["id", "digest", "tampered"], arity, height)

    named = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    tops, root = grow(numbered(named, "g", ["name"]), ["name", "digest"], arity, height)
    spark = docs.sparkSession
    paths = spark.createDataFrame([("", 0, None, [])], f"g string, b long, subroot binary, path {PATH}")
    for table in reversed(tops):
        paths = descend(table, paths, "name" if table is tops[0] else "g", arity, height)
    for table in reversed(tables[1:]):
        paths = descend(table, paths, "g", arity, height)
    top = root.first()  # one row, or none of an empty table
    whole = F.lit(top["digest"].hex() if top else "")
    out = prove(tables[0], paths, ["id"], arity, height)
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))
