"""Checkpoints, persisted results, the cache of processed recordings, and timeline files."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.errors import ApiError, JsonError

CHECKPOINT_VERSION = 1
SEGMENTS = "array<struct<type: string, start: string, end: string, content: string>>"
CHECKPOINT_SCHEMA = f"version int, chunk_index bigint, segments {SEGMENTS}"
TIMELINE_SCHEMA = f"source string, duration_seconds double, segments {SEGMENTS}"
JOB_SCHEMA = "id string, source string, status string, error string"
CACHE_SCHEMA = "hash string, url string, title string, source string, duration_seconds double, segment_count bigint, processed_at string"
TYPES = ("speech", "visual", "sound")


def write_atomically(path: Path, body: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f"{path.name}.{uuid.uuid4().hex[:8]}.tmp")
    draft.write_text(body)
    os.replace(draft, path)


def checkpoint_dir(root: str | Path, job: str) -> Path:
    return Path(root) / job / "checkpoints"


def checkpoint_key(content_hash: str, fingerprint: str) -> str:
    """Key of a recording's checkpoints: the same recording under the same settings finds them again."""
    return hashlib.sha256(f"{content_hash}:{fingerprint}".encode()).hexdigest()[:32]


def checkpoint_path(root: str | Path, job: str, chunk_index: int) -> Path:
    return checkpoint_dir(root, job) / f"chunk_{chunk_index:03d}.json"


def save_checkpoint(root: str | Path, job: str, chunk_index: int, segments: Iterable[dict]) -> Path:
    """One chunk's rows, in place at once or not at all."""
    path = checkpoint_path(root, job, chunk_index)
    body = {"version": CHECKPOINT_VERSION, "chunk_index": chunk_index, "segments": list(segments)}
    write_atomically(path, json.dumps(body, indent=2, ensure_ascii=False))
    return path


def read_checkpoint(root: str | Path, job: str, chunk_index: int) -> list[dict] | None:
    """One chunk's rows, for use inside a partition; None if there is no checkpoint of this version."""
    path = checkpoint_path(root, job, chunk_index)
    if not path.exists():
        return None
    body = json.loads(path.read_text())
    return body["segments"] if body.get("version") == CHECKPOINT_VERSION else None


def checkpoint_bodies(df: DataFrame, body: str = "value") -> DataFrame:
    """Bodies of checkpoints taken apart: chunk_index and segments beside the other columns; other versions are passed
    over, a malformed body fails the query."""
    parsed = F.from_json(F.col(body), CHECKPOINT_SCHEMA, {"mode": "FAILFAST"})
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, parsed.alias("__c")).where(F.col("__c.version") == CHECKPOINT_VERSION).select(*kept, "__c.chunk_index", "__c.segments")


def segment_rows(df: DataFrame) -> DataFrame:
    """One row for each of ``segments``: the other columns, ord, type, start, end, content."""
    kept = [c for c in df.columns if c != "segments"]
    return df.select(*kept, F.posexplode("segments").alias("ord", "s")).select(*kept, "ord", "s.*")


def checkpoints(spark: SparkSession, root: str | Path, job: str) -> DataFrame:
    """A job's checkpoints: chunk_index, segments. No folder means none; drafts are not read."""
    where = checkpoint_dir(root, job)
    if not where.is_dir() or not any(where.glob("*.json")):
        return checkpoint_bodies(spark.createDataFrame([], "value string"))
    return checkpoint_bodies(spark.read.text(str(where), wholetext=True, pathGlobFilter="*.json"))


def load_checkpoints(spark: SparkSession, root: str | Path, job: str) -> DataFrame:
    """Rows of a job's checkpoints: chunk_index, ord, type, start, end, content."""
    return segment_rows(checkpoints(spark, root, job))


def clear_checkpoints(root: str | Path, job: str) -> None:
    shutil.rmtree(checkpoint_dir(root, job), ignore_errors=True)


def persist_result(results: str | Path, job: str, source: str, timeline: dict) -> None:
    """The timeline first, the job's file second: that one marks the result as whole."""
    where = Path(results) / job
    write_atomically(where / "timeline.json", json.dumps(timeline, ensure_ascii=False))
    write_atomically(where / "job.json", json.dumps({"id": job, "source": source, "status": "completed"}))


def persisted_results(spark: SparkSession, results: str | Path) -> DataFrame:
    """Completed jobs with their timelines; malformed and half-written ones are passed over."""
    root = Path(results)
    if not any(root.glob("*/job.json")) or not any(root.glob("*/timeline.json")):
        return spark.createDataFrame([], f"{JOB_SCHEMA}, duration_seconds double, segments {SEGMENTS}")
    read = lambda schema, name: (
        spark.read.schema(schema + ", _bad string")
        .json(f"{root}/*/{name}", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        .withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
        .where("_bad is null")
        .drop("_bad")
    )
    jobs = read(JOB_SCHEMA, "job.json").where("status = 'completed'")
    timelines = read(TIMELINE_SCHEMA, "timeline.json").drop("source").where("segments is not null")
    return jobs.join(timelines, "folder").drop("folder")


def stored_result(results: str | Path, job: str) -> dict | None:
    """One job's timeline, or None if it is not there."""
    path = Path(results) / job / "timeline.json"
    return read_timeline(path) if path.exists() else None


def cache_hash(source: str) -> str:
    return hashlib.sha256(source.encode()).hexdigest()[:8]


def cache_store(cache: str | Path, source: str, url: str | None, timeline: dict) -> Path:
    """Keeps a timeline under its source's hash."""
    key = cache_hash(source)
    where = Path(cache) / key
    title = timeline["source"]
    while title.endswith(".mp4"):
        title = title[: -len(".mp4")]
    meta = {
        "hash": key,
        "url": url,
        "title": title,
        "source": source,
        "duration_seconds": timeline["duration_seconds"],
        "segment_count": len(timeline["segments"]),
        "processed_at": datetime.datetime.now(datetime.UTC).isoformat(),
    }
    write_atomically(where / "timeline.json", json.dumps(timeline, ensure_ascii=False))
    write_atomically(where / "meta.json", json.dumps(meta, ensure_ascii=False))
    return where / "timeline.json"


def cache_lookup(cache: str | Path, source: str) -> Path | None:
    path = Path(cache) / cache_hash(source) / "timeline.json"
    return path if path.exists() else None


def cache_load(cache: str | Path, source: str) -> dict | None:
    path = cache_lookup(cache, source)
    return None if path is None else read_timeline(path)


def cache_entries(spark: SparkSession, cache: str | Path) -> DataFrame:
    """Metadata of all entries, newest first by the written time; malformed ones are passed over."""
    root = Path(cache)
    if not any(root.glob("*/meta.json")):
        return spark.createDataFrame([], CACHE_SCHEMA)
    read = spark.read.schema(CACHE_SCHEMA).json(f"{root}/*/meta.json", multiLine=True, mode="DROPMALFORMED")
    return read.where("hash is not null").orderBy(F.desc("processed_at"))


def resolve_input(cache: str | Path, given: str) -> Path:
    """Path of a cache hash's or an existing file's timeline."""
    if len(given) == 8 and all(c in "0123456789abcdefABCDEF" for c in given):
        path = Path(cache) / given / "timeline.json"
        if not path.exists():
            raise ApiError(404, f"no cached timeline with hash '{given}'")
        return path
    if not Path(given).exists():
        raise ApiError(404, f"file not found: {given}")
    return Path(given)


def checked_timeline(value: Any) -> dict:
    """A timeline whose every field is given and of the right kind, else an error; unknown fields are dropped."""
    try:
        segments = [{k: s[k] for k in ("type", "start", "end", "content")} for s in value["segments"]]
        out = {"source": value["source"], "duration_seconds": float(value["duration_seconds"]), "segments": segments}
    except (KeyError, TypeError, ValueError) as e:
        raise JsonError(f"not a timeline: {e}") from e
    if not isinstance(out["source"], str) or any(not isinstance(v, str) for s in segments for v in s.values()):
        raise JsonError("not a timeline: a field has the wrong type")
    if any(s["type"] not in TYPES for s in segments):
        raise JsonError("not a timeline: unknown segment type")
    return out


def read_timeline(path: str | Path) -> dict:
    try:
        return checked_timeline(json.loads(Path(path).read_text()))
    except json.JSONDecodeError as e:
        raise JsonError(str(e)) from e


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Timeline files with a flag for those that hold every field and known types only."""
    read = spark.read.schema(TIMELINE_SCHEMA).json(path, multiLine=True, mode="PERMISSIVE")
    given = lambda s: s["type"].isin(*TYPES) & s["start"].isNotNull() & s["end"].isNotNull() & s["content"].isNotNull()
    whole = F.col("source").isNotNull() & F.col("duration_seconds").isNotNull() & F.coalesce(F.forall("segments", given), F.lit(False))
    return read.withColumn("accepted", whole)
