"""All queries of the core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segloom.operators import segments as seg_ops
from segloom.operators.ordered import null_safe_join
from segloom.plans import intervals, timeline, timeline_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(timeline.QUERIES) | dict(intervals.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(timeline_sql.ORACLE) | dict(intervals.ORACLE)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Merged timelines with each chunk's transcript and the context carried from the chunk before."""
    rows = timeline.segments(spark, d)
    keys = ["job_id", "chunk_index"]
    texts = seg_ops.previous_contexts(seg_ops.chunk_texts(rows, keys)).select(*keys, "transcript", "previous_context")
    merged = null_safe_join(seg_ops.merge_timeline(rows), texts, keys, "left")
    return merged.select("job_id", "position", "seg_id", "chunk_index", "type", "start_time", "content", "transcript", "previous_context")
