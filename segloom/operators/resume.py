"""What is left to do, and what can be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["job_id", "chunk_index"]


def missing_chunks(chunks: DataFrame, checkpoints: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Chunks without a checkpoint, compared by key and not by count."""
    return chunks.join(checkpoints.select(*keys).distinct(), keys, "left_anti")


def reused_chunks(chunks: DataFrame, checkpoints: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every chunk with its checkpoint's rows, null where there are none."""
    rows = checkpoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("reused_segments"))
    return chunks.join(rows, keys, "left")


def cached(sources: DataFrame, cache: DataFrame, hit: bool = True) -> DataFrame:
    """Sources whose hash is in the cache, or those whose hash is not."""
    return sources.join(cache.select("hash").distinct(), "hash", "left_semi" if hit else "left_anti")


def persisted_results(jobs: DataFrame, timelines: DataFrame) -> DataFrame:
    """Completed jobs with their stored timeline."""
    done = jobs.where("status = 'completed'").select(F.col("id").alias("job_id"), "status").distinct()
    return timelines.join(done, "job_id")


def job_results(jobs: DataFrame, timelines: DataFrame) -> DataFrame:
    """Every job's result or why there is none: not completed yet, failed, or completed without a stored timeline."""
    one = jobs.select(F.col("id").alias("job_id"), "status", "error").distinct()
    joined = one.join(timelines.select("job_id", "timeline_id"), "job_id", "left")
    problem = (
        F.when(F.col("status") == "failed", F.coalesce("error", F.lit("unknown error")))
        .when(F.col("status") != "completed", F.lit("job not completed"))
        .when(F.col("timeline_id").isNull(), F.lit("result missing"))
    )
    return joined.select("job_id", "status", "timeline_id", problem.alias("problem"))
