"""Order-dependent operators without one task per entity.

A window over ``partitionBy(entity)`` puts a whole entity, however large, into one task. Here an entity with very
many rows is cut into ranges of its order: every task gets whole entities and contiguous ranges of large ones, in
order. A state machine runs over each and emits finished results; only at the edges of ranges it emits
open fragments, whose number is bounded by the number of ranges, and an ordinary window stitches them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one entity that a task takes in order; an entity with more is cut into ranges of about so many.
SLICE_ROWS = 200_000
#: Entities that are cut and ranges that are made of them, at most about twice; with more rows ranges grow instead.
MOST_RANGES = 20_000
#: Sampled keys by which a range's bounds are placed; they decide the balance of tasks, not the result.
SAMPLES = 40
#: Steps of the search for a row's range: 2 ** 17 is above twice MOST_RANGES.
STEPS = 17
RANGE = "__range"


def _below(bounds: Column, key: Column) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``, by bisection."""
    span = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        up = F.get(bounds, middle) <= key
        return F.when(at["low"] >= at["high"], at).when(up, span(middle + 1, at["high"])).otherwise(span(at["low"], middle))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), span(F.lit(0), F.size(bounds)), step)
    return found["low"]


def slices(df: DataFrame, entity: Sequence[str], order: Sequence[str], sizes: DataFrame | None = None, slice_rows: int | None = None) -> DataFrame:
    """``df`` with its entities in order in the tasks, and the column ``__range``: -1, or the number of a range.

    ``entity`` and ``order`` must identify a row up to repeated deliveries; then repeats are neighbours in one range.
    ``order`` holds columns of integers or strings. ``sizes`` holds the entity's columns for counting, where counting ``df``
    itself would cost its evaluation; it need not agree with ``df`` exactly. Entities above ``slice_rows`` (SLICE_ROWS
    if not given) are cut at quantiles of their whole order, so that even rows of one instant spread. ``df`` is
    evaluated once, and once more without its other columns if there are such entities. Their names and bounds,
    at most twice MOST_RANGES, come to the driver; rows look them up in one constant and do not carry them.
    """
    slice_rows = SLICE_ROWS if slice_rows is None else slice_rows
    counted = (df if sizes is None else sizes).groupBy(*entity).agg(F.count(F.lit(1)).alias("__n"))
    # Those left out by the limit are smaller than all of these, so none holds more than a 20,000th of all rows.
    large = counted.where(F.col("__n") > slice_rows).orderBy(F.desc("__n")).limit(MOST_RANGES).collect()
    placed = df.withColumn(RANGE, F.lit(-1)) if not large else _placed(df, entity, order, large, slice_rows)
    return placed.repartition(*entity, RANGE).sortWithinPartitions(*entity, *order)


def _placed(df: DataFrame, entity: Sequence[str], order: Sequence[str], large: list, slice_rows: int) -> DataFrame:
    """``df`` with the range of each row of the entities in ``large``, -1 for all others."""
    step = max(slice_rows, -(-sum(r["__n"] for r in large) // MOST_RANGES))
    kinds = dict(df.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in entity)
    rows = []
    for i, r in enumerate(large):
        ranges = -(-r["__n"] // step)
        rows.append((*(r[c] for c in entity), i, ranges, min(1.0, SAMPLES * ranges / r["__n"])))
    few = F.broadcast(df.sparkSession.createDataFrame(rows, f"{named}, __no int, __ranges int, __rate double"))
    key = F.struct(*order)
    drawn = null_safe_join(df.select(*entity, *order), few, entity).where(F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < F.col("__rate") * (1 << 30))
    keys = drawn.groupBy("__no").agg(F.array_sort(F.collect_set(key)).alias("__keys"), F.first("__ranges").alias("__ranges"))
    at = lambda i: F.get("__keys", F.floor(i * F.size("__keys") / F.col("__ranges")).cast("int"))
    bounds = F.when(F.col("__ranges") > 1, F.transform(F.sequence(F.lit(1), F.col("__ranges") - 1), at))
    found = {r["__no"]: [b.asDict() for b in r["bounds"] or [] if b is not None] for r in keys.select("__no", bounds.alias("bounds")).collect()}
    listed = json.dumps([found.get(i, []) for i in range(len(large))])
    constant = F.from_json(F.lit(listed), f"array<array<struct<{', '.join(f'{c}: {kinds[c]}' for c in order)}>>>")
    joined = null_safe_join(df, few.select(*entity, "__no"), entity, "left")
    place = F.when(F.col("__no").isNull(), F.lit(-1)).otherwise(_below(F.get(constant, F.col("__no")), key))
    return joined.withColumn(RANGE, place).drop("__no")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    condition = on[0]
    for part in on[1:]:
        condition &= part
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def positions(df: DataFrame, entity: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "position") -> DataFrame:
    """Zero-based rank of each row in its entity, by ``order``, computed in buckets.

    ``bucket`` must be monotone in ``order``. Only per-bucket counts, not rows, meet per entity.
    """
    keyed = df.withColumn("__bucket", bucket)
    inner = Window.partitionBy(*entity, "__bucket").orderBy(*order)
    counts = keyed.groupBy(*entity, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*entity).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*entity, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = keyed.withColumn("__r", F.row_number().over(inner).cast("bigint") - 1)
    return (
        null_safe_join(ranked, offsets, [*entity, "__bucket"])
        .withColumn(name, F.col("__before") + F.col("__r"))
        .drop("__bucket", "__before", "__r")
    )


def lagged(df: DataFrame, entity: Sequence[str], order: Sequence[str], bucket: Column, column: str, name: str) -> DataFrame:
    """Value of ``column`` in the row before, by ``order`` within the entity, computed in buckets.

    ``bucket`` must be monotone in the first order key, and ``column`` without nulls. Buckets hand on their last value
    through one summary row each.
    """
    keyed = df.withColumn("__bucket", bucket)
    inner = Window.partitionBy(*entity, "__bucket").orderBy(*order)
    ends = keyed.groupBy(*entity, "__bucket").agg(F.max_by(column, F.struct(*order)).alias("__last"))
    earlier = Window.partitionBy(*entity).orderBy("__bucket")
    handed = ends.select(*entity, "__bucket", F.lag("__last").over(earlier).alias("__handed"))
    inside = keyed.withColumn("__lag", F.lag(column).over(inner))
    return (
        null_safe_join(inside, handed, [*entity, "__bucket"])
        .withColumn(name, F.coalesce("__lag", "__handed"))
        .drop("__bucket", "__lag", "__handed")
    )
