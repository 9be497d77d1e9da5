"""Live forms: chunk windows over arriving rows, status changes per job, and context carried between chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_chunks(rows: DataFrame, seconds: int = 180, lateness: str = "10 minutes") -> DataFrame:
    """Rows and words per job and chunk window of arriving rows (job_id, received_at, content); late rows count until the watermark."""
    return (
        rows.withWatermark("received_at", lateness)
        .groupBy("job_id", F.window("received_at", f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("segments"), F.sum(F.octet_length("content")).alias("bytes"))
        .select("job_id", F.col("window.start").alias("chunk_start"), F.col("window.end").alias("chunk_end"), "segments", "bytes")
    )


def once(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Arriving rows without repeated deliveries of one seg_id within the watermark."""
    return rows.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["seg_id"])


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is the last status; ended jobs absorb whatever comes later."""
    last = state.get[0] if state.exists else None
    out = []
    for pdf in batches:
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            if last in ("completed", "failed") or r.status == last:
                continue
            out.append((key[0], r.event_id, r.status, last))
            last = r.status
    state.update((last,))
    yield pd.DataFrame(out, columns=["job_id", "event_id", "status", "previous_status"])


def live_status(log: DataFrame) -> DataFrame:
    """Changes of job status in a stream of events (job_id, event_id, ts, status); the state is one word per job."""
    return log.groupBy("job_id").applyInPandasWithState(
        _changes,
        "job_id bigint, event_id bigint, status string, previous_status string",
        "status string",
        "append",
        GroupStateTimeout.NoTimeout,
    )
