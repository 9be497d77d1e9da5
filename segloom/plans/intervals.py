"""Queries on overlapping and gapped intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators.intervals import gaps, periods
from segloom.operators.segments import usable
from segloom.runtime import load


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return usable(load(spark, d, "segments")).where(F.col("segment_type").isin("speech", "visual"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of at least 100 ms of each job and type."""
    return gaps(_rows(spark, d), min_gap_ms=100)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of each job and type."""
    return periods(_rows(spark, d))


QUERIES = {"p6_found": p6_found, "p6_periods": p6_periods}
#: Offsets in every delivered notation, as milliseconds.
USABLE_SQL = r"""
with raw as (
  select distinct seg_id, job_id, chunk_index, ord, lower(trim(segment_type)) as segment_type, content, start_time, end_time,
         regexp_replace(translate(trim(lower(start_time)), 'hm,', '::.'), '\s+|s$', '', 'g') as a,
         regexp_replace(translate(trim(lower(end_time)), 'hm,', '::.'), '\s+|s$', '', 'g') as b
  from segments where segment_type is not null
), parts as (
  select *, string_split(a, ':') as x, string_split(b, ':') as y from raw
  where regexp_full_match(a, '([0-9]+:){0,2}[0-9]+([.][0-9]*)?') and regexp_full_match(b, '([0-9]+:){0,2}[0-9]+([.][0-9]*)?')
), timed as (
  select *,
    cast(round((coalesce(try_cast(x[-3] as double), 0) * 3600 + coalesce(try_cast(x[-2] as double), 0) * 60 + try_cast(x[-1] as double)) * 1000) as bigint) as start_ms,
    cast(round((coalesce(try_cast(y[-3] as double), 0) * 3600 + coalesce(try_cast(y[-2] as double), 0) * 60 + try_cast(y[-1] as double)) * 1000) as bigint) as end_ms
  from parts
), usable as (
  select seg_id, job_id, chunk_index, ord, segment_type, content, start_ms, end_ms from timed where end_ms >= start_ms
)
"""
_SWEEP = (
    USABLE_SQL
    + """, reach as (
  select job_id, segment_type, start_ms, end_ms,
         max(end_ms) over (partition by job_id, segment_type order by start_ms, end_ms, seg_id rows between unbounded preceding and 1 preceding) as before
  from usable where segment_type in ('speech', 'visual')
)"""
)
ORACLE = {
    "p6_found": _SWEEP
    + " select job_id, segment_type, before as gap_start_ms, start_ms as gap_end_ms from reach where start_ms - before >= 100",
    "p6_periods": _SWEEP
    + """, numbered as (
  select *, sum(case when before is null or start_ms > before then 1 else 0 end)
            over (partition by job_id, segment_type order by start_ms, end_ms rows unbounded preceding) as n from reach
) select job_id, segment_type, min(start_ms) as period_start_ms, max(end_ms) as period_end_ms from numbered group by job_id, segment_type, n""",
}
