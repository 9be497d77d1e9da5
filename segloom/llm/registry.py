"""Queries of the training-data problems, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm import encoding, lookalike, packing, repetition, runs, splitting, truncation, turns
from segloom.operators.segments import normal_type, usable
from segloom.plans.intervals import USABLE_SQL
from segloom.runtime import load


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return turns.interview_speech(usable(load(spark, d, "segments"), "content"), load(spark, d, "jobs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns of interview jobs."""
    sizes = load(spark, d, "segments").select("job_id")
    found = turns.speaker_turns(_speech(spark, d), load(spark, d, "speakers"), texts=False, sizes=sizes)
    return found.select("job_id", "speaker_id", "first_seg_id", "last_seg_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """Clean turns with text, also split at silences longer than nearly all."""
    speech, sizes = _speech(spark, d), load(spark, d, "segments").select("job_id")
    return turns.speaker_turns(speech, load(spark, d, "speakers"), turns.calibrated_pause(speech), sizes=sizes)


def _runs(spark: SparkSession, d: str, max_gap_ms: int | None = None) -> DataFrame:
    segments = load(spark, d, "segments")
    rows = runs.without_interview_speech(usable(segments, "content"), load(spark, d, "jobs"))
    sizes = segments.select("job_id", normal_type(F.col("segment_type")).alias("segment_type"))
    return runs.collapse_runs(rows, max_gap_ms=max_gap_ms, sizes=sizes)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of almost the same content."""
    return _runs(spark, d).select("job_id", "segment_type", "first_seg_id", "last_seg_id")


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    """Each run as one event with its count and duration; a silence of more than a minute ends a run too."""
    return _runs(spark, d, max_gap_ms=60_000)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized timelines and contents with the coarsest boundary that suffices."""
    return splitting.split_timelines(load(spark, d, "timelines"), cuts=False).select("timeline_id", "seg_pos", "boundary")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of oversized items."""
    return splitting.split_timelines(load(spark, d, "timelines"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Contents that mostly repeat themselves."""
    return repetition.repetitive(load(spark, d, "segments")).select("seg_id")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated words of every content."""
    return repetition.measured(load(spark, d, "segments"))


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Certified cutoff of each stratum with its bound, and what it did to all candidates."""
    return repetition.risk(load(spark, d, "segments"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Contents that lost their end."""
    return truncation.truncated(load(spark, d, "segments")).select("seg_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of damage per producer."""
    return truncation.truncation_rates(load(spark, d, "segments"))


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many contents were found for which reason, and what the trie said of their last tokens."""
    return truncation.truncated(load(spark, d, "segments")).groupBy("reason", "verdict").agg(F.count(F.lit(1)).alias("contents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look alike."""
    return lookalike.alike_pairs(load(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others, with their class."""
    return lookalike.alike_classes(load(spark, d, "documents"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its one form."""
    return lookalike.normalised(load(spark, d, "documents")).select("doc_id", "normal_text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document."""
    return encoding.encode_documents(load(spark, d, "documents"))


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document."""
    return packing.pack_items(encoding.measure_documents(load(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_bins(spark, d))


QUERIES = {
    "p7_ids": p7_ids,
    "p8_bins": p8_bins,
    "p8_fill": p8_fill,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_shares": p3_shares,
    "p3_cutoffs": p3_cutoffs,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_reasons": p5_reasons,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
    "p9_classes": p9_classes,
    "p1_found": p1_found,
    "p1_turns": p1_turns,
    "p4_found": p4_found,
    "p4_events": p4_events,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def _runs_sql(apart: str) -> str:
    return (
        USABLE_SQL
        + rf""", worded as (
  select *, regexp_replace(lower(nfc_normalize(content)), '[^\p{{L}}]', '', 'g') as letters from usable
  where regexp_matches(content, '\S')
), chained as (
  select *, case when levenshtein(letters, lag(letters) over w) <= 2 {apart} then 0 else 1 end as fresh, row_number() over w as pos
  from worded window w as (partition by job_id, segment_type order by start_ms, chunk_index, ord, seg_id)
), numbered as (
  select *, sum(fresh) over (partition by job_id, segment_type order by pos rows unbounded preceding) as n from chained
), found as (
  select job_id, segment_type, arg_min(seg_id, pos) as first_seg_id, arg_max(seg_id, pos) as last_seg_id,
         count(*) as events, min(start_ms) as start_ms, max(end_ms) as end_ms
  from numbered group by job_id, segment_type, n having count(*) > 1
), kept as (
  select * from found where not (segment_type = 'speech' and job_id in (select id from jobs where profile = 'interview' and id is not null))
)
"""
    )


#: Line ends parted by nothing but blanks; a sentence's end is marked first, as the engine has no look-behind.
_BLANK_LINE = r"(\r\n|\r|\n)([ \t\f\v]*(\r\n|\r|\n))+"
_FITS = r"len(list_filter({units}, lambda u: length(regexp_replace(u, '^\s+|\s+$', '', 'g')) > 1200)) = 0"
_PIECES_SQL = rf"""with item as (
  select timeline_id, unnest(segments) as s, generate_subscripts(segments, 1) - 1 as pos from timelines
), long as (
  select timeline_id, cast(pos as integer) as seg_pos, s.content as t from item where length(s.content) > 1200
), parted as (
  select *, string_split_regex(t, '{_BLANK_LINE}') as paragraphs from long
), ended as (
  select *, flatten(list_transform(paragraphs, lambda p: string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) as sentences,
    string_split_regex(t, '\s+') as words from parted
)
select timeline_id, seg_pos, case when {_FITS.format(units='paragraphs')} then 'paragraph' when {_FITS.format(units='sentences')} then 'sentence'
  when {_FITS.format(units='words')} then 'word' else 'none' end as boundary from ended
union all
select timeline_id, -1 as seg_pos, 'segment' as boundary from timelines
where list_sum(list_transform(segments, lambda s: coalesce(length(s.content), 0))) > 25000"""
_SHARES_SQL = r"""with w as (
  select distinct seg_id, lower(trim(segment_type)) as stratum, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from segments where content is not null
), g as (
  select seg_id, i, array_to_string(w[i:i + 4], ' ') as g from (select seg_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 6)
), again as (
  select seg_id, i from (select *, min(i) over (partition by seg_id, g) as first from g) where i > first
), covered as (
  select distinct seg_id, unnest(range(i, i + 5)) as p from again
), n as (select seg_id, count(*) as n from covered group by seg_id)
select seg_id, stratum, len(w.w) as words, case when len(w.w) = 0 then 0.0 else 1.0::double - len(list_distinct(w.w)) / len(w.w) end as score,
  case when n.n is null then 0.0 else n.n / len(w.w) end as share from w left join n using (seg_id)"""
_SHARE_SQL = r"""with w as (
  select distinct seg_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from segments where content is not null
), g as (
  select seg_id, i, array_to_string(w[i:i + 4], ' ') as g from (select seg_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 6)
), again as (
  select seg_id, i from (select *, min(i) over (partition by seg_id, g) as first from g) where i > first
), covered as (
  select distinct seg_id, unnest(range(i, i + 5)) as p from again
), n as (select seg_id, count(*) as n from covered group by seg_id)
select seg_id from n join w using (seg_id) where n.n >= 0.4 * len(w.w)"""
ORACLE: dict[str, str] = {
    "p2_found": _PIECES_SQL,
    "p3_found": _SHARE_SQL,
    "p3_shares": _SHARES_SQL,
    "p4_found": _runs_sql("") + "select job_id, segment_type, first_seg_id, last_seg_id from kept",
    "p4_events": _runs_sql("and start_ms - lag(end_ms) over w <= 60000") + "select *, end_ms - start_ms as duration_ms from kept",
}
