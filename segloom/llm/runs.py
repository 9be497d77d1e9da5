"""Repeated consecutive events: each run becomes one event with its count and duration."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segloom.operators.ordered import RANGE, slices
from segloom.runtime import broadcast_if_small, cut

EDITS = 2
ENTITY = ["job_id", "segment_type"]
ORDER = ["start_ms", "chunk_index", "ord", "seg_id"]
#: Most interview jobs whose ids are broadcast; beyond it the join is shuffled.
BROADCAST_JOBS = 500_000
RUN = pa.schema(
    [
        ("job_id", pa.string()),
        ("segment_type", pa.string()),
        ("slice", pa.int32()),
        ("part", pa.int32()),
        ("first_seg_id", pa.int64()),
        ("last_seg_id", pa.int64()),
        ("events", pa.int64()),
        ("start_ms", pa.int64()),
        ("end_ms", pa.int64()),
        ("head", pa.string()),
        ("tail", pa.string()),
        ("tail_end", pa.int64()),
        ("open_left", pa.bool_()),
        ("open_right", pa.bool_()),
    ]
)
RUN_DDL = (
    "job_id string, segment_type string, slice int, part int, first_seg_id bigint, last_seg_id bigint, events bigint, "
    "start_ms bigint, end_ms bigint, head string, tail string, tail_end bigint, open_left boolean, open_right boolean"
)
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def letters(text: str) -> str:
    """Only the letters of a text, composed and in lower case."""
    if text.isascii():
        return text.lower().encode().translate(None, _NO_LETTERS).decode()
    return "".join(filter(str.isalpha, unicodedata.normalize("NFC", text.lower())))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high - 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def within(a: str, b: str, k: int) -> bool:
    """True if at most ``k`` single letters are inserted, deleted or replaced between ``a`` and ``b``."""
    if a == b:
        return True
    if k == 0 or abs(len(a) - len(b)) > k:
        return False
    p = _common(a, b)
    a, b = a[p:], b[p:]
    if not a or not b:
        return len(a) + len(b) <= k
    if len(a) > k and len(b) > k:  # strip the common end, keeping what the edits may need
        q = _common(a[::-1], b[::-1])
        q = min(q, len(a), len(b))
        if q:
            a, b = a[: len(a) - q], b[: len(b) - q]
    if not a or not b:
        return len(a) + len(b) <= k
    return within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1)


def _scan(edits: int, max_gap_ms: int | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        job = kind = at = seen = raw = anchor = None
        run: list | None = None  # first_seg, last_seg, events, start, end, head, tail, open_left, the anchor's end
        part = 0

        def close(right: bool) -> None:
            nonlocal part
            if run is not None and (run[2] > 1 or run[7] or right):
                first, last, n, s, e, head, tail, left, until = run
                edge = left or right
                out.append((job, kind, at, part, first, last, n, s, e, head if edge else None, tail if edge else None, until, left, right))
                part += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("job_id", "segment_type", RANGE, "seg_id", "start_ms", "end_ms", "content")]
            for j, k, r, seg, s, e, text in zip(*columns, strict=True):
                same_key = run is not None and j == job and k == kind and r == at
                if same_key and seg == seen and seg is not None:
                    continue
                if same_key and text == raw:
                    key = anchor
                    near = True
                else:
                    key = text if text.isascii() else letters(text)
                    near = same_key and within(key, anchor, edits)
                if near and max_gap_ms is not None and s - run[8] > max_gap_ms:
                    near = False
                if near:
                    run[1] = seg
                    run[2] += 1
                    if e > run[4]:
                        run[4] = e
                    run[6], run[8] = key, e
                else:
                    # Only a range's first and last run may go on in the next range of its entity.
                    close(not same_key and at is not None and at >= 0)
                    job, kind, at = j, k, r
                    run = [seg, seg, 1, s, e, key, key, not same_key and r >= 0, e]
                seen, raw, anchor = seg, text, key
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN.types, strict=True)], schema=RUN)
                out.clear()
        close(at is not None and at >= 0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUN.types, strict=True)], schema=RUN)

    return scan


def collapse_runs(df: DataFrame, edits: int = EDITS, max_gap_ms: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Runs of two or more events of one (job_id, segment_type), each within ``edits`` letters of the one before.

    Needs the columns of ``usable`` and ``content``; others are ignored. A streaming state machine passes
    over each entity in order holding only the current run. A job too large for a task is cut into ranges; the runs
    open at their edges come out as fragments and are joined afterwards. ``sizes`` is where entities are counted
    for that, see :func:`slices`. With ``max_gap_ms`` a start later than that after the end of the event before also ends a run.

    Null and blank contents are passed over, repeated deliveries of a ``seg_id`` count once (null ids are
    not repeats of each other), texts without
    any letter equal each other, equal times are ordered by chunk_index, ord, seg_id, a null job_id is a job
    like any other, texts of any length are compared whole, and an empty input gives no row.
    """
    plain = F.octet_length("content") == F.length("content")
    # Plain texts travel as their letters, the others as they are.
    text = F.when(plain, F.lower(F.regexp_replace("content", "[^A-Za-z]+", ""))).otherwise(F.col("content"))
    rows = df.where(F.col("content").isNotNull() & F.col("content").rlike(r"(?U)\S")).select(*ENTITY, *ORDER, "end_ms", text.alias("content"))
    found = cut(slices(rows, ENTITY, ORDER, sizes).mapInArrow(_scan(edits, max_gap_ms), RUN_DDL))
    columns = ["job_id", "segment_type", "first_seg_id", "last_seg_id", "events", "start_ms", "end_ms"]
    whole = found.where("not open_left and not open_right").select(columns)
    w = Window.partitionBy("job_id", "segment_type").orderBy("slice", "part")
    # Not more than two fragments a range.
    before = lambda c: F.lag(c).over(w)
    joined = before("open_right") & F.col("open_left") & (F.levenshtein("tail_before", "head", edits) >= 0)
    if max_gap_ms is not None:
        joined &= F.col("start_ms") - before("tail_end") <= max_gap_ms
    numbered = (
        found.where("open_left or open_right")
        .withColumn("tail_before", before("tail"))
        .withColumn("fresh", (~F.coalesce(joined, F.lit(False))).cast("int"))
        .withColumn("n", F.sum("fresh").over(w))
    )
    at = F.struct("slice", "part")
    stitched = (
        numbered.groupBy("job_id", "segment_type", "n")
        .agg(
            F.min_by("first_seg_id", at).alias("first_seg_id"),
            F.max_by("last_seg_id", at).alias("last_seg_id"),
            F.sum("events").alias("events"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
        )
        .where("events > 1")
        .select(columns)
    )
    return whole.unionByName(stitched).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def without_interview_speech(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """``rows`` without the speech of jobs of profile interview; a null job_id is no interview's."""
    interviews = jobs.where("profile = 'interview' and id is not null").select(F.col("id").alias("__job")).distinct()
    on = (F.col("job_id") == F.col("__job")) & (F.col("segment_type") == "speech")
    return rows.join(broadcast_if_small(interviews, BROADCAST_JOBS), on, "left_anti")


def word_key(text: str) -> list[str]:
    """Words of a text: runs of letters or digits in lower case."""
    return re.findall(r"[^\W_]+", text.lower())
