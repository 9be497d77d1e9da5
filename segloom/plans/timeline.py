"""Queries of the timeline pipeline's operators over the driver tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.config import Media, Vision
from segloom.functions import text as T
from segloom.functions.timecode import chunk_name, format_timestamp, parse_timestamp
from segloom.operators import chunking, guards, prompts, resume, sections
from segloom.operators import jobs as job_ops
from segloom.operators import segments as seg_ops
from segloom.runtime import load
from segloom.sources import media, store

SEGMENT_COLUMNS = ["seg_id", "job_id", "chunk_index", "ord", "type", "start_time", "end_time", "content"]


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered segment once, with its type in plain spelling.

    Repeats agree on every column kept, so they are found within their chunk; partitioned by chunk, the rows
    need no further shuffle for whatever groups by chunk, and a very long job is spread over its chunks.
    """
    rows = load(spark, d, "segments").withColumn("type", seg_ops.normal_type(F.col("segment_type")))
    return rows.select(*SEGMENT_COLUMNS).repartition("job_id", "chunk_index").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "chunks").distinct()


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "jobs").distinct()


def timecode_parse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "segments").select(
        "seg_id", parse_timestamp(F.col("start_time")).alias("start_s"), parse_timestamp(F.col("end_time")).alias("end_s")
    )


def timecode_format(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select(
        "job_id",
        chunk_name(F.col("chunk_index")).alias("chunk_name"),
        format_timestamp(F.col("start_seconds")).alias("start_time"),
        format_timestamp(F.col("end_seconds")).alias("end_time"),
    )


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_plan(load(spark, d, "timelines").select("timeline_id", "duration_seconds")).drop("duration_seconds")


def frame_batches(spark: SparkSession, d: str) -> DataFrame:
    return chunking.frame_batches(chunks(spark, d)).drop("start_seconds", "end_seconds")


def classify_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "segments").select("seg_id", F.col("content").alias("text"))
    return seg_ops.classify(rows).select("seg_id", "type", "content")


def transcript(spark: SparkSession, d: str) -> DataFrame:
    return seg_ops.transcripts(segments(spark, d), ["job_id", "chunk_index"])


def recent_context(spark: SparkSession, d: str) -> DataFrame:
    return seg_ops.contexts(segments(spark, d), ["job_id", "chunk_index"])


def prev_context(spark: SparkSession, d: str) -> DataFrame:
    return seg_ops.previous_contexts(recent_context(spark, d)).select("job_id", "chunk_index", "previous_context")


def vision_prompts(spark: SparkSession, d: str) -> DataFrame:
    texts = seg_ops.previous_contexts(seg_ops.chunk_texts(segments(spark, d), ["job_id", "chunk_index"]))
    prompt = prompts.vision_prompt(prompts.DEFAULT_VISION_PROMPT, F.col("transcript"), F.col("previous_context"))
    return texts.select("job_id", "chunk_index", prompt.alias("prompt"))


def merge_timeline(spark: SparkSession, d: str) -> DataFrame:
    return seg_ops.merge_timeline(segments(spark, d)).select("job_id", "seg_id", "position", "start_s")


def nested_timelines(spark: SparkSession, d: str) -> DataFrame:
    nested = seg_ops.collect_timelines(seg_ops.merge_timeline(segments(spark, d)))
    starts = F.array_join(F.transform("segments", lambda s: F.coalesce(s["start"], F.lit("?"))), "|")
    return nested.select("job_id", "segment_count", starts.alias("starts"))


def timeline_parts(spark: SparkSession, d: str) -> DataFrame:
    """Nested timelines in parts of at most 10,000 segments, so that no job's row outgrows its task."""
    nested = seg_ops.collect_timelines(seg_ops.merge_timeline(segments(spark, d)), part_rows=10_000)
    return nested.select("job_id", "part", "segment_count", F.element_at("segments", 1)["start"].alias("first"), F.element_at("segments", -1)["start"].alias("last"))


def exploded_timelines(spark: SparkSession, d: str) -> DataFrame:
    return seg_ops.explode_timelines(load(spark, d, "timelines").select("timeline_id", "segments"))


def repetition_guard(spark: SparkSession, d: str) -> DataFrame:
    return guards.guard_repetition(load(spark, d, "documents"))


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    tagged = F.concat(F.lit("<think>"), F.coalesce("source", F.lit("")), F.lit("</think> "), "text")
    return load(spark, d, "documents").select("doc_id", T.strip_thinking(tagged).alias("answer"))


def vision_answers(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 7 == 0, F.lit('{"done": true}')).otherwise(F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"))))
    rows = load(spark, d, "documents").select("doc_id", body.alias("body"))
    return guards.parse_vision_response(rows).select("doc_id", "content", "error")


def response_texts(spark: SparkSession, d: str) -> DataFrame:
    """Event properties as parts of a stored-prompt answer; reasoning items are passed over."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    item = lambda kind, *p: F.struct(F.lit(kind).alias("type"), F.array(*p).alias("content"))
    body = F.to_json(
        F.struct(
            F.array(
                item("reasoning", part("output_text", F.col("event_type"))),
                item("message", part("output_text", F.col("event_type")), part("refusal", F.lit("no")), part("output_text", F.col("user_id").cast("string"))),
            ).alias("output")
        )
    )
    return load(spark, d, "events").select("event_id", guards.responses_text(body).alias("text"))


def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of vision requests over documents, read back: text, first image, streaming and window."""
    images = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("aGk="))).otherwise(F.array().cast("array<string>"))
    body = prompts.chat_request("m", F.col("text"), images)
    part = lambda path: F.get_json_object("body", path)
    return (
        load(spark, d, "documents")
        .select("doc_id", body.alias("body"))
        .select("doc_id", part("$.messages[0].content").alias("content"), part("$.messages[0].images[0]").alias("image"), part("$.stream").alias("stream"), part("$.options.num_ctx").alias("window"))
    )


def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """Text of the first choice of chat answers, some of which hold no choice."""
    message = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit('{"choices": []}')).otherwise(F.to_json(F.struct(F.array(message).alias("choices"))))
    return load(spark, d, "documents").select("doc_id", guards.chat_text(body).alias("text"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def pack_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.pack_sections(load(spark, d, "timelines"))


def pack_sections_small(spark: SparkSession, d: str) -> DataFrame:
    return sections.pack_sections(load(spark, d, "timelines"), budget=2500)


def stitched_sections(spark: SparkSession, d: str) -> DataFrame:
    packed = sections.pack_sections(load(spark, d, "timelines"), budget=2500)
    line = F.concat(F.lit("Section "), (F.col("section") + 1).cast("string"), F.lit(": "), F.count(F.lit(1)).cast("string"))
    return sections.stitch_sections(packed.groupBy("timeline_id", "section").agg(line.alias("text")))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = T.estimated_tokens(F.col("text"))
    return load(spark, d, "documents").select("doc_id", n.alias("tokens"), (n > sections.SECTION_TOKENS).alias("needs_sections"))


def header_context(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.header_context(F.col("text")).alias("header"))


def byte_cut(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.ellipsize_bytes(F.col("text"), 200, 200).alias("head"))


def unicode_trim(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.utrim(F.col("text")).alias("trimmed"), T.is_blank(F.col("text")).alias("blank"))


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return resume.missing_chunks(chunks(spark, d), load(spark, d, "segments")).select("job_id", "chunk_index", "start_seconds", "end_seconds")


def resume_left(spark: SparkSession, d: str) -> DataFrame:
    return resume.reused_chunks(chunks(spark, d), segments(spark, d)).select("job_id", "chunk_index", "reused_segments")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("source is not null").select("id", "source", T.source_hash(F.col("source")).alias("hash"))


def source_hash(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("id", "hash", T.is_hash(F.col("hash")).alias("is_hash"), T.title_of(F.col("source")).alias("title"))


def cache_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return resume.cached(_hashed(spark, d), load(spark, d, "cache_meta")).select("id", "hash")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return resume.cached(_hashed(spark, d), load(spark, d, "cache_meta"), hit=False).select("id", "hash")


def cache_list(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries as listed: newest first by their written time, minutes, cut titles and dates."""
    rows = load(spark, d, "cache_meta").orderBy(F.desc("processed_at"))
    return rows.select(
        "hash",
        T.ellipsize_bytes(F.col("title"), 48, 45).alias("title"),
        F.when(F.col("duration_seconds").isNotNull(), F.format_string("%.1f", F.col("duration_seconds") / 60)).alias("minutes"),
        "segment_count",
        T.byte_prefix(F.col("processed_at"), 10).alias("date"),
    )


def output_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/in/"), "source")
    return jobs(spark, d).where("source is not null").select(
        "id",
        T.is_mp4_path(path).alias("is_mp4"),
        T.is_mp4_upload(F.col("source")).alias("is_upload"),
        T.json_output_path(path).alias("beside"),
        T.json_output_path(path, "/out").alias("in_dir"),
        T.formatted_output_path(path, "/cache/").alias("formatted"),
        T.source_name(F.nullif(F.col("error"), F.lit("")), path).alias("name"),
    )


def format_selectors(spark: SparkSession, d: str) -> DataFrame:
    resolution = F.when(F.col("series_id") % 2 == 0, F.lit("720"))
    return jobs(spark, d).select("id", T.format_selector(resolution, F.col("series_id")).alias("selector"))


def error_texts(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["ffmpeg", "whisper", "vision", "config", "io", "json", "server", "client", "download", "cancelled"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.pmod(F.coalesce("series_id", F.lit(0)), F.lit(10)) + 1)
    return jobs(spark, d).where("error is not null").select("id", T.error_text(kind, F.col("error")).alias("shown"))


def uuid_valid(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"\A[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\z"
    return jobs(spark, d).select("id", F.col("id").rlike(pattern).alias("valid"))


def segment_validation(spark: SparkSession, d: str) -> DataFrame:
    """Strictness of the wire form: every field given and the type one of three."""
    bad = lambda s: s["type"].isNull() | s["start"].isNull() | s["end"].isNull() | s["content"].isNull() | ~s["type"].isin(*seg_ops.TYPES)
    flagged = F.size(F.filter("segments", lambda s: F.coalesce(bad(s), F.lit(True)))).cast("bigint")
    return load(spark, d, "timelines").select(
        "timeline_id",
        flagged.alias("bad_segments"),
        (F.col("source").isNotNull() & F.col("duration_seconds").isNotNull() & (flagged == 0)).alias("accepted"),
        F.size("segments").cast("bigint").alias("segment_count"),
    )


def model_present(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "timelines").select("timeline_id", guards.model_present(F.transform("segments", lambda s: s["type"]), "vis").alias("present"))


def pcm_normalise(spark: SparkSession, d: str) -> DataFrame:
    sample = (F.pmod(F.col("event_id") * 7919, F.lit(65536)) - 32768).cast("smallint")
    return load(spark, d, "events").select("event_id", F.element_at(chunking.pcm_to_float(F.array(sample)), 1).alias("sample"))


def recogniser_times(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser ticks of 10 ms inside a chunk, as global offsets."""
    ticks = F.floor((F.col("end_seconds") - F.col("start_seconds")) * 50)
    return chunks(spark, d).select("job_id", "chunk_index", chunking.to_global(F.col("start_seconds"), ticks).alias("middle_s"))


def persisted_results(spark: SparkSession, d: str) -> DataFrame:
    return resume.persisted_results(jobs(spark, d), load(spark, d, "timelines")).select("job_id", "timeline_id", "status")


def results_loaded(spark: SparkSession, d: str) -> DataFrame:
    """How many stored results a start finds for each profile."""
    done = jobs(spark, d).where("status = 'completed'").select("id", "profile").distinct()
    found = resume.persisted_results(jobs(spark, d), load(spark, d, "timelines"))
    return found.join(done, found["job_id"] == done["id"]).groupBy("profile").agg(F.count(F.lit(1)).alias("loaded"))


def checkpoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as bodies of checkpoints, some of another version, and read back."""
    one = F.struct("ord", "seg_id", "type", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "content")
    items = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["content"].alias("content")))
    chunked = segments(spark, d).groupBy("job_id", "chunk_index").agg(items.alias("segments"))
    version = F.when(F.col("chunk_index") % 3 == 2, 2).otherwise(1)
    bodies = chunked.select("job_id", F.to_json(F.struct(version.alias("version"), "chunk_index", "segments")).alias("value"))
    return store.segment_rows(store.checkpoint_bodies(bodies))


def extract_commands(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), "job_id", F.lit(".mp4"))
    rows = chunks(spark, d).select("job_id", path.alias("path"), F.concat(F.lit("/jobs/"), "job_id").alias("job_dir"), "chunk_index", "start_seconds", "end_seconds")
    return media.extract_commands(rows, Media(), Vision())


def probe_answers(spark: SparkSession, d: str) -> DataFrame:
    """Durations read from answers of the probe, some of which name none."""
    body = F.to_json(F.struct(F.struct(F.col("duration_seconds").cast("string").alias("duration"), F.lit("mp4").alias("format_name")).alias("format")))
    return load(spark, d, "timelines").select("timeline_id", media.probed_duration(body).alias("seconds"))


def job_results(spark: SparkSession, d: str) -> DataFrame:
    return resume.job_results(jobs(spark, d), load(spark, d, "timelines"))


#: Events stand for the steps of a job, users for jobs.
EVENT_STATUS = {"click": "queued", "signup": "queued", "view": "processing", "purchase": "completed", "error": "failed"}


def _log(spark: SparkSession, d: str) -> DataFrame:
    status = None
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, F.lit(name)) if status is None else status.when(F.col("event_type") == kind, F.lit(name))
    return load(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), status.alias("status"))


def job_fold(spark: SparkSession, d: str) -> DataFrame:
    return job_ops.fold_status(_log(spark, d))


def status_changes(spark: SparkSession, d: str) -> DataFrame:
    return job_ops.status_changes(_log(spark, d)).select("job_id", "event_id", "status", "previous_status")


def cancel_all(spark: SparkSession, d: str) -> DataFrame:
    return job_ops.cancel_open(jobs(spark, d)).select("id", "status", "error")


def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return job_ops.summary(load(spark, d, "jobs"))


def stage_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the speech stage, then those of the vision stage, numbered on within each chunk."""
    rows = segments(spark, d).where("type is not null")
    heard = rows.where("type <> 'visual'").withColumn("stage", F.lit(0))
    seen = rows.where("type = 'visual'").withColumn("stage", F.lit(1))
    both = heard.unionByName(seen)
    from pyspark.sql.window import Window

    w = Window.partitionBy("job_id", "chunk_index").orderBy("stage", "ord", "seg_id")
    return both.select("seg_id", "job_id", "chunk_index", (F.row_number().over(w) - 1).cast("bigint").alias("stage_ord"))


QUERIES = {
    f.__name__: f
    for f in (
        timecode_parse, timecode_format, chunk_plan, frame_batches, classify_segments, transcript, recent_context, prev_context,
        vision_prompts, merge_timeline, nested_timelines, timeline_parts, exploded_timelines, repetition_guard, strip_thinking, vision_answers,
        response_texts, chat_requests, chat_answers, event_properties, pack_sections, pack_sections_small, stitched_sections, token_estimate, header_context,
        byte_cut, unicode_trim, resume_antijoin, resume_left, source_hash, cache_semijoin, cache_misses, cache_list, output_paths,
        format_selectors, error_texts, uuid_valid, segment_validation, model_present, pcm_normalise, recogniser_times,
        persisted_results, results_loaded, checkpoint_rows, extract_commands, probe_answers, job_results, job_fold, status_changes, cancel_all, job_summary, stage_union,
    )
}
