"""Sharding over fixed virtual slots (DataFrame functions only).

Records hash into a fixed number of virtual slots. The records and bytes of each slot are summed
once, and a stored table (version, vslot, shard) maps slots to shards. Rebalancing reads the newest
version, appends the next and touches nothing else: the hash of a record never changes, so the rows
that move are those of the slots that moved. Records are placed by a join with the newest version.

Version 0 deals the slots round robin. Each later version moves whole slots from the fullest
shards to the emptiest until no move makes the sizes more equal. What reaches the driver is one
row a slot (at most twice ``slots`` rows, 4096 by default), whatever the input.

Equal records share a slot, however many there are. Slots that many records have made large
(``_oversized``) are cut: their rows are written once with a number each, and that number deals
them over as many further slots, ``slots`` to 2 * ``slots`` - 1.

Places inside a shard are gapless without a task that sees a whole shard: a slot's first place is
the sum of the counts of the slots before it, and rows are numbered within their slot.

Defined cases: a null text has no bytes and counts as the fixed record overhead; a null doc_id
hashes like any value; repeated rows are separate records, dealt apart where they are many; an
empty table has no rows and a map of equal shares; input columns other than id and text play no part.
"""

from __future__ import annotations

import heapq

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomwatch.llm.names import col
from loomwatch.session import materialize, shared_folder

SLOTS = 4096
OVERHEAD = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and the fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each record; the hash takes all three."""
    base = docs.select(
        col(id_col).alias("doc_id"),
        record_size(col(text_col)).alias("size"),
        F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return base.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Records and bytes of each slot that has any."""
    return records.groupBy("vslot").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slot s belongs to shard s mod shards."""
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """The next version: ``current`` with slots moved while that makes shard sizes more equal.

    Each step takes the fullest and the emptiest shard and moves the slot whose size is nearest
    to half their difference, or swaps two slots if a swap comes nearer. It ends when the best
    step would not lower the larger of the two. The fullest shard that cannot be improved stays.
    """
    owner = list(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].append((sizes.get(slot, 0), slot))
    load = [sum(x for x, _ in part) for part in held]
    for _ in range(len(owner) * 4):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best, step = gap, None
        for size, slot in held[high]:
            if 0 < size and abs(gap - 2 * size) < best:
                best, step = abs(gap - 2 * size), (size, slot, None)
        if best > gap // 20:
            small = sorted(held[low])
            for size, slot in held[high]:
                at, end = 0, len(small)
                while at < end:  # the partner that leaves the smallest difference
                    mid = (at + end) // 2
                    at, end = (mid + 1, end) if small[mid][0] < size - gap / 2 else (at, mid)
                for other in small[max(0, at - 1) : at + 1]:
                    if size > other[0] and abs(gap - 2 * (size - other[0])) < best:
                        best, step = abs(gap - 2 * (size - other[0])), (size, slot, other)
        if step is None:
            break
        size, slot, other = step
        held[high].remove((size, slot))
        held[low].append((size, slot))
        owner[slot] = low
        moved = size
        if other:
            held[low].remove(other)
            held[high].append(other)
            owner[other[1]] = high
            moved -= other[0]
        load[high] -= moved
        load[low] += moved
    return owner


def grow(current: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """One more shard: slots move from the fullest shards into the new one, and nowhere else."""
    owner, load = list(current), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += sizes.get(slot, 0)
        heapq.heappush(held[shard], (sizes.get(slot, 0), slot))
    target, new = sum(load) / (shards + 1), 0
    fullest = [(-x, shard) for shard, x in enumerate(load)]
    heapq.heapify(fullest)
    while fullest and new < target:
        size, shard = heapq.heappop(fullest)
        if not held[shard]:
            continue
        part, slot = heapq.heappop(held[shard])
        owner[slot] = shards
        new += part
        heapq.heappush(fullest, (size + part, shard))
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Appends one version to the stored map: (version, vslot, shard), a row a slot."""
    rows = [(version, slot, shard) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, "version int, vslot int, shard int").coalesce(1).write.mode("append").parquet(path)


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest version of the stored map and its shard of each slot."""
    table = spark.read.schema("version int, vslot int, shard int").parquet(path)
    newest = table.agg(F.max("version")).first()[0]
    return newest, [r.shard for r in table.where(F.col("version") == newest).orderBy("vslot").collect()]


def place(records: DataFrame, path: str) -> DataFrame:
    """``records`` with shard and slot, the gapless place in the shard, by the newest stored map."""
    spark = records.sparkSession
    newest, _ = newest_map(spark, path)
    table = spark.read.schema("version int, vslot int, shard int").parquet(path).where(F.col("version") == newest)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    filled = table.join(slot_totals(records).select("vslot", "records"), "vslot", "left").select("vslot", "shard", F.coalesce("records", F.lit(0)).alias("records"))
    starts = filled.select("vslot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("_n", F.row_number().over(inside) - 1)
    placed = numbered.join(F.broadcast(starts), "vslot")  # a row a slot, a number fixed beforehand
    return placed.select(*records.columns, "shard", (F.col("_start") + F.col("_n")).cast("long").alias("slot"))


def _oversized(totals: list, shards: int, slots: int) -> list[int]:
    """Slots of several records with over a twentieth of a shard, or twice an equal share, in bytes or records."""
    out = set()
    for field in ("bytes", "records"):
        floor = sum(r[field] for r in totals) * max(1 / (20 * shards), 2 / slots)
        out |= {r["vslot"] for r in totals if r["records"] > 1 and r[field] > floor}
    return sorted(out)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard of the rebalanced map and its place there.

    With ``map_path``, the newest version of the map stored there (for ``shards`` shards and twice
    ``slots`` slots) is edited, so that records stay where they are as far as balance allows;
    without, a new map begins in the shared folder.
    """
    spark = docs.sparkSession
    records = with_slots(docs, id_col, text_col, slots)
    totals = slot_totals(records).collect()  # at most ``slots`` rows
    if large := _oversized(totals, shards, slots):
        is_large = F.array_contains(F.split(F.lit(",".join(map(str, large))), ",").cast("array<int>"), F.col("vslot"))
        cut = materialize(records.where(is_large).withColumn("_no", F.monotonically_increasing_id()), "large-slots")
        again = (F.pmod(F.xxhash64("vslot", "_no"), F.lit(slots)) + slots).cast("int")
        records = records.where(~is_large).unionByName(cut.withColumn("vslot", again).drop("_no"))
        totals = slot_totals(records).collect()  # at most 2 * ``slots`` rows
    sizes = {r["vslot"]: int(r["bytes"]) for r in totals}
    if map_path is None:
        map_path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        save_map(spark, map_path, 0, first_map(shards, 2 * slots))
    version, owner = newest_map(spark, map_path)
    save_map(spark, map_path, version + 1, rebalance(owner, sizes, shards))
    return place(records, map_path)
