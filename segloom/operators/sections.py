"""Token-budgeted sections of a timeline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION_TOKENS = 25_000
SEGMENT_OVERHEAD = 50


def fill_sections(sizes: list[int], budget: int) -> list[int]:
    """Section of each size in order: a new one begins where the budget would be passed and the current is not empty."""
    out, section, held, empty = [], 0, 0, True
    for size in sizes:
        if held + size > budget and not empty:
            section, held = section + 1, 0
        out.append(section)
        held += size
        empty = False
    return out


def _sections(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fill_sections(s or [], budget) for s in batch.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("timeline_id"), batch.column("sizes"), pa.array(made, pa.list_(pa.int64()))], names=["timeline_id", "sizes", "sections"])

    return run


def pack_sections(df: DataFrame, budget: int = SECTION_TOKENS) -> DataFrame:
    """timeline_id, position, tokens, section of every segment of nested timelines.

    A segment's size is a quarter of its content's bytes, rounded down, plus 50. A section's fill depends on all before
    it, so it is a linear pass over one timeline's sizes; contents never leave the JVM. An oversized
    segment has a section of its own; null and empty arrays give no row; a null content has no bytes.
    """
    size = lambda s: F.floor(F.coalesce(F.octet_length(s["content"]), F.lit(0)) / 4).cast("bigint") + SEGMENT_OVERHEAD
    sized = df.select("timeline_id", F.transform("segments", size).alias("sizes"))
    packed = sized.mapInArrow(_sections(budget), "timeline_id bigint, sizes array<bigint>, sections array<bigint>")
    return packed.select("timeline_id", F.posexplode(F.arrays_zip("sizes", "sections")).alias("position", "__z")).select(
        "timeline_id", "position", F.col("__z.sizes").alias("tokens"), F.col("__z.sections").alias("section")
    )


def stitch_sections(df: DataFrame, by: str = "timeline_id") -> DataFrame:
    """Section texts in order, parted by blank lines."""
    items = F.array_sort(F.collect_list(F.struct("section", "text")))
    return df.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n\n").alias("text"))
