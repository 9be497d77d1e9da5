"""SQL of the timeline queries, for DuckDB."""

from __future__ import annotations

#: Unicode White_Space for DuckDB's patterns.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def utrim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def blank(x: str) -> str:
    return f"(strlen({utrim(x)}) = 0)"


def number(x: str) -> str:
    return rf"(case when regexp_full_match({x}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast({x} as double) end)"


def parsed(x: str) -> str:
    p = f"string_split({x}, ':')"
    q = f"string_split({p}[3], '.')"
    fraction = f"(case when len({q}) > 1 then {number(q + '[2]')} / pow(10.0, strlen({q}[2])) else 0.0 end)"
    return f"(case when len({p}) = 3 then {number(p + '[1]')} * 3600 + {number(p + '[2]')} * 60 + {number(q + '[1]')} + {fraction} end)"


def formatted(x: str) -> str:
    ms = f"cast(round(greatest(case when isnan({x}) then 0.0 else {x} end, 0.0) * 1000) as bigint)"
    return f"(case when {x} is not null then printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} % 3600000 // 60000, {ms} % 60000 // 1000, {ms} % 1000) end)"


def byte_prefix(x: str, n: int) -> str:
    """Longest prefix of at most n bytes: as many characters as fit."""
    count = f"len(list_filter(range(1, least(length({x}), {n}) + 1), lambda k: strlen(left({x}, k)) <= {n}))"
    return f"left({x}, {count})"


def ellipsized(x: str, limit: int, keep: int) -> str:
    return f"(case when strlen({x}) > {limit} then {byte_prefix(x, keep)} || '...' else {x} end)"


SEGS = """segs as (
  select distinct seg_id, job_id, chunk_index, ord, lower(trim(segment_type)) as type, start_time, end_time, content from segments
)"""
CHUNKS = "chunk_rows as (select distinct * from chunks)"
JOBS = "job_rows as (select distinct * from jobs)"
SPOKEN = f"(type = 'speech' and content is not null and not {blank('content')})"
TRANSCRIPTS = f"""transcripts as (
  select job_id, chunk_index, string_agg(case when {SPOKEN} then content end, ' ' order by ord) as transcript
  from segs group by job_id, chunk_index
)"""
CONTEXTS = f"""said as (
  select job_id, chunk_index, string_agg(content, ' ' order by ord) as said from (
    select *, row_number() over (partition by job_id, chunk_index order by ord desc) as r from segs where {SPOKEN}
  ) where r <= 5 group by job_id, chunk_index
), seen as (
  select job_id, chunk_index, arg_max_null(content, ord) as seen from segs where type = 'visual' group by job_id, chunk_index
), groups as (select distinct job_id, chunk_index from segs),
contexts as (
  select g.job_id, g.chunk_index,
    concat_ws(' ', 'Recent dialogue: ' || said, 'Last visual: ' || {ellipsized('seen', 200, 200)}) as context
  from groups g left join said s on g.job_id = s.job_id and g.chunk_index = s.chunk_index
  left join seen v on g.job_id = v.job_id and g.chunk_index = v.chunk_index
), carried as (
  select job_id, chunk_index, lag(context) over (partition by job_id order by chunk_index) as previous_context from contexts
)"""
HASHED = f"{JOBS}, hashed as (select id, source, sha256(source)[:8] as hash from job_rows where source is not null)"
MERGED = f"""merged as (
  select *, coalesce({parsed('start_time')}, 0.0) as start_s from segs
), placed as (
  select *, row_number() over (partition by job_id order by start_s, chunk_index, ord, seg_id) - 1 as position from merged
)"""
LOG = """log as (
  select event_id, ts, user_id as job_id, case event_type when 'click' then 'queued' when 'signup' then 'queued' when 'view' then 'processing'
    when 'purchase' then 'completed' when 'error' then 'failed' end as status from events
)"""


def plain_number(x: str) -> str:
    return f"(case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end)"


def packed(budget: int) -> str:
    return f"""with recursive item as (
  select timeline_id, unnest(segments) as s, generate_subscripts(segments, 1) as i from timelines
), sized as (
  select timeline_id, i, cast(coalesce(strlen(s.content), 0) // 4 + 50 as bigint) as tokens from item
), pack as (
  select timeline_id, i, tokens, tokens as held, cast(0 as bigint) as section from sized where i = 1
  union all
  select p.timeline_id, n.i, n.tokens,
    case when p.held + n.tokens > {budget} then n.tokens else p.held + n.tokens end,
    case when p.held + n.tokens > {budget} then p.section + 1 else p.section end
  from pack p join sized n on n.timeline_id = p.timeline_id and n.i = p.i + 1
)"""


PROMPT = """'Describe the visual content of these video frames in detail.'
  || case when previous_context is not null and not BLANKC then chr(10) || chr(10) || 'Context from previous segment:' || chr(10) || '"' || previous_context
     || '"' || chr(10) || 'Maintain continuity with what was previously described.' else '' end
  || case when transcript is not null and not BLANKT then chr(10) || chr(10) || 'Audio transcript for this segment:' || chr(10) || '"' || transcript
     || '"' || chr(10) || chr(10) || 'Use this transcript as context to enrich your visual description. Note how the visual content relates to what is being said or heard.' else '' end
""".replace("BLANKC", blank("previous_context")).replace("BLANKT", blank("transcript"))
NAME = "regexp_extract('/data/in/' || source, '[^/]*$')"
STEM = rf"(case when regexp_matches({NAME}, '.[.][^.]*$') then regexp_replace({NAME}, '[.][^.]*$', '') else {NAME} end)"
DIR = "regexp_replace('/data/in/' || source, '[^/]*$', '')"
HEAD = "case when strpos(text, '## Scene') > 0 then left(text, strpos(text, '## Scene') - 1) else left(text, 2000) end"
THINK = "'<think>' || coalesce(source, '') || '</think> ' || text"
CLASSIFY_T = utrim("content")

ORACLE = {
    "timecode_parse": f"select seg_id, {parsed('start_time')} as start_s, {parsed('end_time')} as end_s from segments",
    "timecode_format": f"with {CHUNKS} select job_id, printf('chunk_%03d', chunk_index) as chunk_name, {formatted('start_seconds')} as start_time, {formatted('end_seconds')} as end_time from chunk_rows",
    "chunk_plan": """with t as (select timeline_id, duration_seconds as d, floor(duration_seconds / 180) as f from timelines
        where duration_seconds > 0 and not isnan(duration_seconds)),
      e as (select *, unnest(range(0, cast(f as bigint) + 1)) as i from t)
      select timeline_id, i as chunk_index, cast(i * 180 as double) as start_seconds, cast(case when i < f then (i + 1) * 180 else d end as double) as end_seconds
      from e where i < f or d - f * 180 > 0.01""",
    "frame_batches": f"""with {CHUNKS}, n as (select *, cast(floor((end_seconds - start_seconds) * 2.0::double) as bigint) as n from chunk_rows),
      b as (select *, unnest(range(0, (n - 1) // 15 + 1)) as batch from n where n > 0)
      select job_id, chunk_index, batch, batch * 15 as first_frame, least(n - batch * 15, 15::bigint) as frames,
        start_seconds + (batch * 15) / 2.0::double as batch_start,
        least(start_seconds + (batch * 15 + least(n - batch * 15, 15)) / 2.0::double, end_seconds) as batch_end from b""",
    "classify_segments": rf"""with t as (select seg_id, {CLASSIFY_T} as t from segments), k as (select *, regexp_full_match(t, '\[[^\[\]]+\]') as sound from t where strlen(t) > 0)
      select seg_id, case when sound then 'sound' else 'speech' end as type, case when sound then lower(substr(t, 2, length(t) - 2)) else t end as content from k""",
    "transcript": f"with {SEGS}, {TRANSCRIPTS} select * from transcripts",
    "recent_context": f"with {SEGS}, {CONTEXTS} select * from contexts",
    "prev_context": f"with {SEGS}, {CONTEXTS} select * from carried",
    "vision_prompts": f"with {SEGS}, {TRANSCRIPTS}, {CONTEXTS} select job_id, chunk_index, {PROMPT} as prompt from transcripts join carried using (job_id, chunk_index)",
    "merge_timeline": f"with {SEGS}, {MERGED} select job_id, seg_id, position, start_s from placed",
    "nested_timelines": f"with {SEGS}, {MERGED} select job_id, count(*) as segment_count, string_agg(coalesce(start_time, '?'), '|' order by position) as starts from placed group by job_id",
    "timeline_parts": f"""with {SEGS}, {MERGED} select job_id, position // 10000 as part, count(*) as segment_count,
      arg_min_null(start_time, position) as first, arg_max_null(start_time, position) as last from placed group by job_id, position // 10000""",
    "exploded_timelines": """with e as (select timeline_id, unnest(segments) as s, generate_subscripts(segments, 1) as i from timelines)
      select timeline_id, cast(i - 1 as integer) as position, s.type as type, s.start as start, s."end" as "end", s.content as content from e""",
    "repetition_guard": f"""with s as (select doc_id, unnest(string_split(text, '.')) as s, generate_subscripts(string_split(text, '.'), 1) - 1 as pos from documents),
      k as (select *, lower({utrim('s')}) as k from s),
      r as (select doc_id, pos, row_number() over (partition by doc_id, k order by pos) as r from k where strlen(k) >= 15),
      c as (select doc_id, min(pos) as cut from r where r = 3 group by doc_id),
      j as (select doc_id, text, cut, {utrim("case when cut is not null then array_to_string(string_split(text, '.')[1:cut], '.') else text end")} as kept from documents left join c using (doc_id))
      select doc_id, case when strlen(kept) = 0 then text else kept end as guarded_text, cut is not null as was_cut from j""",
    "strip_thinking": f"with t as (select doc_id, {THINK} as t from documents) select doc_id, {utrim("substr(t, strpos(t, '</think>') + 8)")} as answer from t",
    "vision_answers": f"""with t as (select doc_id, case when doc_id % 7 = 0 then null else text end as t from documents)
      select doc_id, case when t is not null and not {blank('t')} then {utrim('t')} end as content,
        case when t is null then 'vision model error: response has no message content' when {blank('t')} then 'vision model error: empty response' end as error from t""",
    "response_texts": "select event_id, event_type || chr(10) || chr(10) || user_id as text from events",
    "chat_requests": "select doc_id, text as content, case when doc_id % 2 = 0 then 'aGk=' end as image, 'false' as stream, '65536' as \"window\" from documents",
    "chat_answers": "select doc_id, case when doc_id % 7 = 0 then '' else coalesce(text, '') end as text from documents",
    "event_properties": "select event_id, json_extract_string(props, '$.k') as k from events",
    "pack_sections": packed(25_000) + " select timeline_id, cast(i - 1 as integer) as position, tokens, section from pack",
    "pack_sections_small": packed(2_500) + " select timeline_id, cast(i - 1 as integer) as position, tokens, section from pack",
    "stitched_sections": packed(2_500)
    + """, lines as (select timeline_id, section, 'Section ' || (section + 1) || ': ' || count(*) as text from pack group by timeline_id, section)
      select timeline_id, string_agg(text, chr(10) || chr(10) order by section) as text from lines group by timeline_id""",
    "token_estimate": "select doc_id, strlen(text) // 4 as tokens, strlen(text) // 4 > 25000 as needs_sections from documents",
    "header_context": f"select doc_id, {HEAD} as header from documents",
    "byte_cut": f"select doc_id, {ellipsized('text', 200, 200)} as head from documents",
    "unicode_trim": f"select doc_id, {utrim('text')} as trimmed, {blank('text')} as blank from documents",
    "resume_antijoin": f"with {CHUNKS} select * from chunk_rows c where not exists (select 1 from segments s where s.job_id = c.job_id and s.chunk_index = c.chunk_index)",
    "resume_left": f"""with {CHUNKS}, {SEGS}, k as (select job_id, chunk_index, count(*) as reused_segments from segs group by job_id, chunk_index)
      select c.job_id, c.chunk_index, reused_segments from chunk_rows c left join k on c.job_id = k.job_id and c.chunk_index = k.chunk_index""",
    "source_hash": f"with {HASHED} select id, hash, regexp_full_match(hash, '[0-9a-fA-F]{{8}}') as is_hash, regexp_replace(source, '([.]mp4)+$', '') as title from hashed",
    "cache_semijoin": f"with {HASHED} select id, hash from hashed where hash in (select hash from cache_meta)",
    "cache_misses": f"with {HASHED} select id, hash from hashed where hash not in (select hash from cache_meta where hash is not null)",
    "cache_list": f"select hash, {ellipsized('title', 48, 45)} as title, printf('%.1f', duration_seconds / 60) as minutes, segment_count, {byte_prefix('processed_at', 10)} as date from cache_meta",
    "output_paths": f"""with {JOBS} select id, regexp_matches('/data/in/' || source, '[^/][.]mp4$') as is_mp4, ends_with(source, '.mp4') as is_upload,
      {DIR} || {STEM} || '.json' as beside, '/out/' || {STEM} || '.json' as in_dir,
      {DIR} || (case when contains('/data/in/' || source, '/cache/') then 'formatted.md' else {STEM} || '_formatted.md' end) as formatted,
      coalesce(nullif(error, ''), nullif({NAME}, ''), '/data/in/' || source) as name from job_rows where source is not null""",
    "format_selectors": f"""with {JOBS}, r as (select id, case when series_id % 2 = 0 then '720' else '1080' end as r, coalesce(series_id, 30) as f from job_rows)
      select id, 'bestvideo[height<=' || r || '][fps<=' || f || ']+bestaudio/best[height<=' || r || ']' as selector from r""",
    "error_texts": f"""with {JOBS} select id, case coalesce(series_id, 0) % 10 when 0 then 'ffmpeg error: ' || error when 1 then 'whisper error: ' || error
      when 2 then 'vision model error: ' || error when 3 then 'config error: ' || error when 4 then 'io error: ' || error when 5 then 'json error: ' || error
      when 6 then 'server error: ' || error when 7 then 'client error: ' || error when 8 then 'download error: ' || error else 'job cancelled' end as shown
      from job_rows where error is not null""",
    "uuid_valid": f"with {JOBS} select id, regexp_full_match(id, '[0-9a-fA-F]{{8}}-?([0-9a-fA-F]{{4}}-?){{3}}[0-9a-fA-F]{{12}}') as valid from job_rows",
    "segment_validation": """with b as (select timeline_id, source, duration_seconds, len(segments) as n,
        len(list_filter(segments, lambda s: coalesce(s.type is null or s.start is null or s."end" is null or s.content is null or s.type not in ('speech', 'visual', 'sound'), true))) as bad from timelines)
      select timeline_id, bad as bad_segments, source is not null and duration_seconds is not null and bad = 0 as accepted, n as segment_count from b""",
    "model_present": "select timeline_id, len(list_filter(segments, lambda s: starts_with(s.type, 'vis'))) > 0 as present from timelines",
    "pcm_normalise": "select event_id, cast((event_id * 7919 % 65536 - 32768) as float) / cast(32767 as float) as sample from events",
    "recogniser_times": f"with {CHUNKS} select job_id, chunk_index, start_seconds + cast(floor((end_seconds - start_seconds) * 50) as bigint) / 100.0::double as middle_s from chunk_rows",
    "persisted_results": "select t.job_id, t.timeline_id, j.status from timelines t join (select distinct id, status from jobs where status = 'completed') j on t.job_id = j.id",
    "results_loaded": """select j.profile, count(*) as loaded from timelines t
      join (select distinct id, profile from jobs where status = 'completed') j on t.job_id = j.id group by j.profile""",
    "checkpoint_rows": f"""with {SEGS} select job_id, cast(chunk_index as bigint) as chunk_index,
      cast(row_number() over (partition by job_id, chunk_index order by ord, seg_id) - 1 as integer) as ord, type, start_time as start, end_time as "end", content
      from segs where chunk_index % 3 <> 2""",
    "extract_commands": f"""with {CHUNKS}, n as (select job_id, cast(chunk_index as bigint) as chunk_index, printf('/jobs/%s/chunk_%03d', job_id, chunk_index) as folder,
        '-y -ss ' || {plain_number('start_seconds')} || ' -to ' || {plain_number('end_seconds')} || ' -i /in/' || job_id || '.mp4' as span from chunk_rows)
      select job_id, chunk_index, 'ffmpeg ' || span || ' -vn -acodec pcm_s16le -ar 16000 -ac 1 ' || folder || '/audio.wav' as audio,
        'ffmpeg ' || span || ' -vf fps=2 -q:v 2 ' || folder || '/frame_%06d.jpg' as frames from n""",
    "probe_answers": "select timeline_id, duration_seconds as seconds from timelines",
    "job_results": """with j as (select distinct id, status, error from jobs)
      select j.id as job_id, j.status, t.timeline_id, case when j.status = 'failed' then coalesce(j.error, 'unknown error')
        when j.status <> 'completed' then 'job not completed' when t.timeline_id is null then 'result missing' end as problem
      from j left join timelines t on t.job_id = j.id""",
    "job_fold": f"""with {LOG} select job_id, coalesce(arg_min(status, (ts, event_id)) filter (where status in ('completed', 'failed')), arg_max(status, (ts, event_id))) as status,
      count(*) as events from log group by job_id""",
    "status_changes": f"""with {LOG}, w as (select *, lag(status) over (partition by job_id order by ts, event_id) as previous_status from log)
      select job_id, event_id, status, previous_status from w where previous_status is null or previous_status <> status""",
    "cancel_all": f"""with {JOBS} select id, case when status in ('queued', 'processing') then 'failed' else status end as status,
      case when status in ('queued', 'processing') then 'cancelled by user' else error end as error from job_rows""",
    "job_summary": """with j as (select distinct id, profile, status from jobs) select profile, count(*) as jobs,
      count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where status in ('queued', 'processing')) as cancellable,
      case when bool_and(status = 'completed') then 'ok' else 'degraded' end as health from j group by profile""",
    "stage_union": f"""with {SEGS} select seg_id, job_id, chunk_index,
      row_number() over (partition by job_id, chunk_index order by case when type = 'visual' then 1 else 0 end, ord, seg_id) - 1 as stage_ord from segs where type is not null""",
}
