"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.runtime import cut

CAPACITY = 2_048
#: Documents a group holds on average; groups are packed independently of each other.
GROUP_DOCUMENTS = 20_000


class Bins:
    """Tournament tree of free room: each inner node knows the most room below it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        bin_number = node - self.leaves
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return bin_number


def first_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each item; equal sizes keep their order. No size may exceed the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins = Bins(len(sizes), capacity)
    out = [0] * len(sizes)
    for i in order:
        out[i] = bins.put(sizes[i])
    return out


PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("piece_start", pa.int64()), ("piece_size", pa.int64()), ("container", pa.int64())]
)
PLACED_DDL = "doc_id bigint, piece int, piece_start bigint, piece_size bigint, container bigint"


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("bin_group")[0].as_py()
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("size").to_pylist(), strict=True), key=lambda r: (r[0] is None, r))
        items: list[tuple[int, int, int, int]] = []
        for doc, size in rows:
            for piece, start in enumerate(range(0, size, capacity)):
                items.append((doc, piece, start, min(capacity, size - start)))
        bins = first_fit_decreasing([i[3] for i in items], capacity)
        out = [(*item, (group << 32) + b) for item, b in zip(items, bins, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PLACED.types, strict=True)], schema=PLACED)

    return pack


def pack_items(sizes: DataFrame, capacity: int = CAPACITY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Container of every item: doc_id, piece, piece_start, piece_size, container.

    ``sizes`` holds doc_id and size. An item above the capacity is divided into full pieces and a rest; no other
    item is divided. Null, zero and negative sizes are left out; repeated rows are items of their own; a null
    doc_id is an item; an empty input gives no row. Groups are made by a hash of doc_id, so their number
    follows the input and each is bounded whatever the documents' sources are.
    """
    counted = cut(sizes.where("size > 0").groupBy("doc_id", F.col("size").cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    groups = max(1, round((counted.agg(F.sum("n")).first()[0] or 0) / group_documents))
    # Repeated rows are numbered, so that they spread too and a task run again spreads them alike.
    items = counted.select("doc_id", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    spread = F.pmod(F.xxhash64("doc_id", "size", "copy"), F.lit(groups)).cast("bigint")
    return items.withColumn("bin_group", spread).groupBy("bin_group").applyInArrow(_pack(capacity), PLACED_DDL)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, what they hold, and the share of room used."""
    one = placed.groupBy("container").agg(F.sum("piece_size").alias("held"))
    return one.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("held").alias("held"),
        F.max("held").alias("fullest"),
        (F.sum("held") / (F.count(F.lit(1)) * capacity)).alias("used"),
    )
