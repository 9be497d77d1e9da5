"""Overlapping, nested and gapped time intervals per entity.

A mergeable aggregate: its state is a list of sorted disjoint intervals, two states combine by a linear merge. Time
is cut into ranges of an hour, and an interval belongs to the range it starts in, so a state never holds more than
half as many intervals as its range has milliseconds. States form a reduction tree: each input task folds its batches,
the states of one entity and range meet in groups of tasks, and those groups' states meet once more. What
an entity's earlier ranges reach is one number a range. No task ever holds all rows or all intervals of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.operators.ordered import null_safe_join
from segloom.runtime import cut

#: Milliseconds of a range.
RANGE_MS = 3_600_000
#: Groups of tasks whose states meet before all of a range's do.
GROUPS = 64
#: States a task gathers before it combines them, and intervals from which it hands them on.
FAN_IN, FLUSH = 16, 1_000_000
KEYS = ["k1", "k2", "range"]
STATE = pa.schema(
    [("k1", pa.string()), ("k2", pa.string()), ("range", pa.int64()), ("tasks", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
)
STATE_DDL = "k1 string, k2 string, range bigint, tasks int, starts array<bigint>, ends array<bigint>"


def running_max(group: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Greatest end so far within each group; ``group`` ascends."""
    if not len(end) or group[0] == group[-1]:
        return np.maximum.accumulate(end)
    low, high = int(end.min()), int(end.max())
    span, first = high - low + 1, int(group[0])
    if span * (int(group[-1]) - first + 1) < 1 << 62:
        shift = (group - first) * span
        return np.maximum.accumulate(end - low + shift) - shift + low
    middle = int(np.searchsorted(group, group[len(group) // 2], side="left")) or int(np.searchsorted(group, group[0], side="right"))
    return np.concatenate((running_max(group[:middle], end[:middle]), running_max(group[middle:], end[middle:])))


def disjoint(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of each group, of rows sorted by group and start; touching ones are joined."""
    if not len(group):
        return group, start, end
    reach = running_max(group, end)
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return group[first], start[first], reach[np.append(first[1:], len(group)) - 1]


Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def merge_lists(a: Lists, b: Lists, span: int = RANGE_MS) -> Lists:
    """Linear merge of sorted disjoint lists, (group, start, end) each, group by group; starts lie in 0..span - 1."""
    x, y = a[0] * span + a[1], b[0] * span + b[1]
    at = np.arange(len(x)) + np.searchsorted(y, x, side="left"), np.arange(len(y)) + np.searchsorted(x, y, side="right")
    merged = []
    for left, right in zip(a, b, strict=True):
        both = np.empty(len(x) + len(y), np.int64)
        both[at[0]], both[at[1]] = left, right
        merged.append(both)
    return disjoint(*merged)


def _codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A dense integer for each row's keys; nulls are a key like any other."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        one = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _states(keys: pa.RecordBatch, lists: Lists) -> pa.RecordBatch:
    """One row for each group, ``keys`` in the order of the groups."""
    ends = np.searchsorted(lists[0], np.arange(keys.num_rows + 1))
    offsets = pa.array(ends.astype(np.int32))
    made = [pa.ListArray.from_arrays(offsets, pa.array(lists[k])) for k in (1, 2)]
    return pa.RecordBatch.from_arrays([*keys.columns, *made], schema=STATE)


def fold(batch: pa.RecordBatch, task: int) -> pa.RecordBatch:
    """States of the rows of one batch (k1, k2, range, start, end)."""
    code = _codes(batch, KEYS)
    start, end = (batch.column(k).to_numpy() for k in ("start", "end"))
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    first = np.unique(code, return_index=True)[1]
    keys = batch.select(KEYS).take(pa.array(order[first])).append_column("tasks", pa.array(np.full(len(first), task, np.int32)))
    return _states(keys, disjoint(code, start, end))


def combine(batch: pa.RecordBatch, keys: Sequence[str]) -> pa.RecordBatch:
    """States of equal keys merged, two and two until one is left of each; rows come out in the order of their keys."""
    code = _codes(batch, keys)
    order = np.argsort(code, kind="stable")
    batch, code = batch.take(pa.array(order)), code[order]
    row_keys = batch.select(STATE.names[:4])
    sizes = batch.column("starts").value_lengths().to_numpy()
    values = [batch.column(c).flatten().to_numpy() for c in ("starts", "ends")]
    while len(code) and (code[1:] == code[:-1]).any():
        head = np.concatenate(([True], code[1:] != code[:-1]))
        begin = np.flatnonzero(head)
        nth = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
        right = nth % 2 == 1
        pair = np.cumsum(~right) - 1
        each, side = np.repeat(pair, sizes), np.repeat(right, sizes)
        halves = [(each[m], values[0][m], values[1][m]) for m in (~side, side)]
        merged = merge_lists(*halves)
        values = list(merged[1:])
        row_keys, code = row_keys.filter(pa.array(~right)), code[~right]
        sizes = np.bincount(merged[0], minlength=len(code))
    return _states(row_keys, (np.repeat(np.arange(len(code)), sizes), *values))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tree: a task's rows, folded batch by batch."""
    task = TaskContext.get().partitionId() % GROUPS
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(fold(batch, task))
        if len(held) == FAN_IN:
            held = [combine(_joined(held), KEYS)]
            if len(held[0].column("starts").flatten()) > FLUSH:
                yield held.pop()
    if held:
        yield combine(_joined(held), KEYS)


def _combine(keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An inner level of the tree, over states sorted by their keys."""
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(STATE)
            done = combine(batch if last is None else _joined([last, batch]), keys)
            # Keys come in order, but codes need not: the open state is that of the batch's last row.
            tail = batch.slice(batch.num_rows - 1)
            same = np.ones(done.num_rows, bool)
            for k in keys:
                value = tail.column(k)[0].as_py()
                same &= np.array([v == value for v in done.column(k).to_pylist()])
            yield done.filter(pa.array(~same))
            last = done.filter(pa.array(same))
        if last is not None:
            yield last

    return run


def merged(df: DataFrame, key: str, kind: str) -> DataFrame:
    """Sorted disjoint intervals of each entity and range: k1, k2, range, starts, ends, counted from the range's start."""
    rows = (
        df.select(F.col(key).cast("string").alias("k1"), F.col(kind).cast("string").alias("k2"), F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint"))
        .where(F.col("end_ms") >= F.col("start_ms"))
        .withColumn("range", F.expr(f"(start_ms - pmod(start_ms, {RANGE_MS})) div {RANGE_MS}"))
        .select(*KEYS, (F.col("start_ms") - F.col("range") * RANGE_MS).alias("start"), (F.col("end_ms") - F.col("range") * RANGE_MS).alias("end"))
    )
    states = rows.mapInArrow(_fold, STATE_DDL)
    for keys in ([*KEYS, "tasks"], KEYS):
        states = states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_combine(keys), STATE_DDL)
    return cut(states.drop("tasks"))


def _reached(lists: DataFrame) -> DataFrame:
    """Each range's first start and greatest end, and ``carry``, the greatest end of the entity's earlier ranges.

    The window is over ranges, of which an entity has at most as many as its time has hours.
    """
    base = F.col("range") * RANGE_MS
    edges = lists.select(*KEYS, (F.get("starts", F.lit(0)) + base).alias("first"), (F.element_at("ends", -1) + base).alias("last"))
    earlier = Window.partitionBy("k1", "k2").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("carry", F.max("last").over(earlier))


def gaps(df: DataFrame, key: str = "job_id", kind: str = "segment_type", min_gap_ms: int = 1) -> DataFrame:
    """Stretches of at least ``min_gap_ms`` between an entity's first start and last end that no row covers.

    Needs ``start_ms`` and ``end_ms``; other columns are ignored. Rows with a null offset or an end before the
    start cover nothing; repeated rows change nothing; intervals of no length cover no stretch but split a
    gap in two at their instant; a null key is a key. An empty input gives no row.
    """
    lists = merged(df, key, kind)
    reached = _reached(lists)
    names = F.col("k1").alias(key), F.col("k2").alias(kind)
    between = reached.where(F.col("first") - F.col("carry") >= min_gap_ms).select(*names, F.col("carry").alias("gap_start_ms"), F.col("first").alias("gap_end_ms"))
    # Only ranges into which earlier intervals reach need what they carry.
    into = reached.where("carry > first").select(*KEYS, "carry")
    n = F.size("starts") - 1
    holes = F.arrays_zip(F.slice("ends", F.lit(1), n).alias("a"), F.slice("starts", F.lit(2), n).alias("b"))
    inside = null_safe_join(lists.where(F.size("starts") > 1), into, KEYS, "left").select("k1", "k2", "range", "carry", F.inline(holes).alias("a", "b"))
    begin = F.greatest(F.col("a") + F.col("range") * RANGE_MS, "carry")
    end = F.col("b") + F.col("range") * RANGE_MS
    return inside.where(end - begin >= min_gap_ms).select(*names, begin.alias("gap_start_ms"), end.alias("gap_end_ms")).unionByName(between)


def periods(df: DataFrame, key: str = "job_id", kind: str = "segment_type") -> DataFrame:
    """Maximal continuous periods of each entity, touching intervals joined.

    The same cases hold as in :func:`gaps`.
    """
    lists = merged(df, key, kind)
    base = F.col("range") * RANGE_MS
    carried = null_safe_join(lists, _reached(lists).where("carry >= first").select(*KEYS, "carry"), KEYS, "left")
    # What a range adds to the period left open before it, and whether it begins another.
    size = F.size("starts")
    absorbed = F.when(F.col("carry").isNull(), 0).otherwise(F.size(F.filter("starts", lambda s: s + base <= F.col("carry"))))
    placed = carried.withColumn("absorbed", absorbed)
    ranges = placed.select(
        *KEYS,
        F.when(F.col("absorbed") > 0, F.get("ends", F.col("absorbed") - 1) + base).alias("adds"),
        (F.col("absorbed") < size).cast("int").alias("begins"),
    )
    numbered = ranges.withColumn("n", F.sum("begins").over(Window.partitionBy("k1", "k2").orderBy("range")))
    added = numbered.where("adds is not null").groupBy("k1", "k2", (F.col("n") - F.col("begins")).alias("n")).agg(F.max("adds").alias("adds"))
    owners = numbered.where("begins = 1").select(*KEYS, "n")
    extended = null_safe_join(owners, added, ["k1", "k2", "n"]).select(*KEYS, "adds")
    left = size - F.col("absorbed")
    items = F.arrays_zip(F.slice("starts", F.col("absorbed") + 1, left).alias("s"), F.slice("ends", F.col("absorbed") + 1, left).alias("e"))
    open_ranges = null_safe_join(placed.where(left > 0), extended, KEYS, "left")
    island = open_ranges.select("k1", "k2", "range", "adds", left.alias("n"), F.posexplode(items).alias("i", "x"))
    last = F.when(F.col("i") == F.col("n") - 1, F.col("adds"))
    return island.select(
        F.col("k1").alias(key),
        F.col("k2").alias(kind),
        (F.col("x.s") + base).alias("period_start_ms"),
        F.greatest(F.col("x.e") + base, last).alias("period_end_ms"),
    )
