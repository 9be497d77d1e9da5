"""Jobs over recordings: submit, follow, cancel, fetch; and the pipeline that makes a timeline."""

from __future__ import annotations

import hashlib
import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom import errors, models
from segloom.config import ServerConfig, prompt_template, resolve_config
from segloom.errors import ApiError, Cancelled, EngineError, MediaError
from segloom.functions.timecode import format_timestamp
from segloom.operators import chunking
from segloom.operators.resume import missing_chunks
from segloom.operators.segments import collect_timelines, contexts, merge_timeline, transcripts
from segloom.runtime import shared_folder, ship
from segloom.sources import media, store

CANCELLED = "cancelled by user"
log = logging.getLogger("segloom")


@contextmanager
def stage(name: str, job: str) -> Iterator[None]:
    """Logs how long a stage of a job took."""
    began = time.monotonic()
    try:
        yield
    finally:
        log.info("%s: %s took %.1f s", job, name, time.monotonic() - began)


def artifact_batches(artifacts: DataFrame, config: ServerConfig) -> DataFrame:
    """Batches of each chunk's frames in order: their times and paths."""
    sized = artifacts.withColumn("n", F.size("frame_paths").cast("bigint"))
    batched = chunking.frame_batches(sized, config.vision.fps, config.vision.max_frames_per_request, frames="n")
    paths = F.slice("frame_paths", F.col("first_frame").cast("int") + 1, F.col("frames").cast("int"))
    one = F.struct("batch", format_timestamp(F.col("batch_start")).alias("start"), format_timestamp(F.col("batch_end")).alias("end"), paths.alias("paths"))
    return batched.groupBy("job_id", "chunk_index").agg(F.array_sort(F.collect_list(one)).alias("batches"))


def work_list(todo: DataFrame, artifacts: DataFrame, speech: DataFrame, old: DataFrame, config: ServerConfig) -> DataFrame:
    """A row for each chunk left to do, see :func:`models.describe`.

    ``old`` holds the rows of chunks that are reused; the context that one of them hands on to the chunk after it comes along.
    """
    keys = ["job_id", "chunk_index"]
    one = F.struct("ord", "type", "start", "end", "content")
    heard = speech.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("speech"))
    handed = contexts(old, ["chunk_index"]).select((F.col("chunk_index") + 1).alias("chunk_index"), F.col("context").alias("carried"))
    spoken = transcripts(speech, keys)
    rows = todo.select(*keys).join(heard, keys, "left").join(spoken, keys, "left").join(artifact_batches(artifacts, config), keys, "left")
    return rows.join(handed, "chunk_index", "left").select(*keys, "speech", "transcript", "batches", "carried")


def process_video(
    spark: SparkSession,
    config: ServerConfig,
    path: str,
    job: str,
    transcriber: Callable[[], models.Transcriber],
    describer: Callable[[], models.Describer],
    force: bool = False,
    source_name: str | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    run: Callable[..., str] = media.run_tool,
) -> dict:
    """Timeline of one recording.

    Checkpoints are keyed by the recording's content and the settings its rows depend on, so a new job over the
    same recording resumes; chunks with a checkpoint are left out before anything is extracted, and each other chunk
    gets its own as soon as it is described. ``force`` starts anew.
    """
    config.validate()
    if not os.path.exists(path):
        raise MediaError(f"file not found: {path}")
    ship(spark)
    root = job_root(spark, config)
    template = prompt_template(config.ollama.prompt_template_path if Path(config.ollama.prompt_template_path or "").exists() else None, config.ollama.default_prompt)
    key = store.checkpoint_key(content_hash(path), config.fingerprint(template))
    if force:
        store.clear_checkpoints(root, key)

    def check() -> None:
        if cancelled():
            raise Cancelled("")

    check()
    with stage("pipeline", job):
        where = os.path.join(root, job)
        recordings = spark.createDataFrame([(job, path, where)], "job_id string, path string, job_dir string")
        probed = media.probe_durations(recordings.select("path"), config.ffmpeg, run).first()
        if probed is None or probed.duration_seconds is None:
            raise MediaError((probed.error if probed else None) or "no duration")
        plan = chunking.chunk_plan(recordings.withColumn("duration_seconds", F.lit(probed.duration_seconds)), size=config.ffmpeg.chunk_duration_secs)
        done = store.checkpoints(spark, root, key)
        todo = missing_chunks(plan, done, ["chunk_index"])
        extracted = media.extract_artifacts(todo, config.ffmpeg, config.vision, run)
        artifacts = extracted.join(todo.select("chunk_index", "start_seconds", "end_seconds"), "chunk_index").persist()  # effects, once
        try:
            with stage("extraction", job):
                bad = artifacts.where("error is not null").select("error").first()
            if bad is not None:
                raise MediaError(bad.error)
            media.write_manifest(artifacts, where)
            check()
            speech = models.transcribe(artifacts, transcriber).persist()
            try:
                work = work_list(todo, artifacts, speech, store.load_checkpoints(spark, root, key), config)
                with stage("speech and vision", job):
                    report = models.describe(work, describer, template, root, key).collect()  # a line a chunk
            finally:
                speech.unpersist()
        finally:
            artifacts.unpersist()
        for r in sorted(report, key=lambda r: r.chunk_index):
            if r.kind is not None:
                raise getattr(errors, r.kind)(r.error)
            log.info("%s: chunk %d took %.1f s, %d frames, %d batches, %d segments", job, r.chunk_index, r.seconds, r.frames, r.batches, r.segments)
        check()
        rows = store.load_checkpoints(spark, root, key).select(
            F.lit(job).alias("job_id"),
            F.lit(0).alias("seg_id"),
            "chunk_index",
            "ord",
            "type",
            F.col("start").alias("start_time"),
            F.col("end").alias("end_time"),
            "content",
        )
        with stage("merge", job):
            merged = collect_timelines(merge_timeline(rows)).first()
    segments = [s.asDict() for s in merged.segments] if merged else []
    timeline = {"source": source_name or os.path.basename(path) or path, "duration_seconds": probed.duration_seconds, "segments": segments}
    if config.processing.cleanup_checkpoints:
        store.clear_checkpoints(root, key)
    return timeline


def job_root(spark: SparkSession, config: ServerConfig) -> str:
    """The folder of checkpoints, extracted media and uploads, shared by all executors."""
    return config.processing.temp_dir or shared_folder(spark)


def processor(run: Callable[..., str] = media.run_tool) -> Callable[..., dict]:
    """:func:`process_video` over the configured recogniser's command and model server."""

    def process(spark: SparkSession, config: ServerConfig, path: str, job: str, **options) -> dict:
        speech, server, vision = config.whisper, config.ollama, config.vision
        hear = lambda: models.CommandRecogniser(speech, run)
        see = lambda: models.HttpDescriber(server.endpoint, server.model, vision.max_tokens, server.num_ctx, server.timeout_seconds)
        return process_video(spark, config, path, job, hear, see, run=run, **options)

    return process


def content_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


@dataclass
class Job:
    id: str
    source: str
    status: str = "queued"
    error: str | None = None
    stop: threading.Event = field(default_factory=threading.Event)

    def response(self) -> dict:
        out = {"id": self.id, "source": self.source, "status": self.status}
        return out | ({"error": self.error} if self.error is not None else {})


class Engine:
    """The job surface: submission by path, upload or URL, status, result, cancellation, health."""

    def __init__(
        self,
        spark: SparkSession,
        config: ServerConfig,
        process: Callable[..., dict] | None = None,
        download: Callable[..., tuple[str, str]] = media.download_video,
        profiles: Path | None = None,
    ):
        self.spark, self.config, self.process, self.download, self.profiles = spark, config, process or processor(), download, profiles
        self.root = job_root(spark, config)
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()
        self.slots = threading.Semaphore(config.server.max_concurrent_jobs)
        # Only names are loaded; a timeline is read when it is asked for.
        for r in store.persisted_results(spark, config.processing.results_dir).select("id", "source").toLocalIterator():
            self.jobs[r.id] = Job(r.id, r.source, "completed")
        self.loaded = len(self.jobs)
        if self.loaded:
            log.info("loaded %d completed results", self.loaded)

    def _config(self, profile: str | None) -> ServerConfig:
        try:
            return resolve_config(self.config, profile, self.profiles)
        except EngineError as e:
            raise ApiError(400, str(e)) from e

    def _start(self, source: str, work: Callable[[Job], dict]) -> Job:
        job = Job(str(uuid.uuid4()), source)
        with self.lock:
            self.jobs[job.id] = job
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job

    def _run(self, job: Job, work: Callable[[Job], dict]) -> None:
        with self.slots:
            if not self._move(job, "processing"):
                return
            self.spark.sparkContext.addJobTag(job.id)
            try:
                timeline = work(job)
                store.persist_result(self.config.processing.results_dir, job.id, timeline["source"], timeline)
                with self.lock:  # the result is there before the status says so
                    if job.status != "failed":
                        job.source = timeline["source"]
                        job.status = "completed"
            except Exception as e:
                self._move(job, "failed", str(e))
            finally:
                self.spark.sparkContext.removeJobTag(job.id)

    def _move(self, job: Job, status: str, error: str | None = None) -> bool:
        """Failed absorbs: a cancelled job is not revived."""
        with self.lock:
            if job.status == "failed":
                return False
            job.status, job.error = status, error
            return True

    def submit(self, path: str, force: bool = False, profile: str | None = None, name: str | None = None) -> Job:
        if not path:
            raise ApiError(400, "source must not be empty")
        if not os.path.exists(path):
            raise ApiError(400, f"file not found: {path}")
        if not os.path.basename(path)[:-4] or not path.endswith(".mp4"):
            raise ApiError(400, "source must be an mp4 file")
        config = self._config(profile)
        return self._start(
            name or path,
            lambda job: self.process(
                self.spark, config, path, job.id, force=force, source_name=name or os.path.basename(path), cancelled=job.stop.is_set
            ),
        )

    def upload_name(self, filename: str) -> str:
        """The plain name of an uploaded recording, refused if it is none."""
        if not filename.endswith(".mp4"):
            raise ApiError(400, "uploaded file must be an mp4 file")
        return os.path.basename(filename)

    def upload_path(self) -> Path:
        """A fresh place for an uploaded recording."""
        where = Path(self.root) / f"upload-{uuid.uuid4()}"
        where.mkdir(parents=True)
        return where / "input.mp4"

    def upload(self, filename: str, path: str | Path, force: bool = False, profile: str | None = None) -> Job:
        """A job over a recording that was uploaded to ``path`` under the name ``filename``."""
        return self.submit(str(path), force, profile, name=self.upload_name(filename))

    def submit_url(self, url: str, force: bool = False, profile: str | None = None, max_resolution: str | None = None, max_fps: int | None = None) -> Job:
        if not url:
            raise ApiError(400, "url must not be empty")
        config = self._config(profile)

        def work(job: Job) -> dict:
            path, title = self.download(config.ytdlp, url, os.path.join(self.root, job.id), max_resolution, max_fps)
            return self.process(self.spark, config, path, job.id, force=force, source_name=f"{title}.mp4", cancelled=job.stop.is_set)

        return self._start(url, work)

    def _job(self, job_id: str) -> Job:
        try:
            uuid.UUID(job_id)
        except ValueError as e:
            raise ApiError(400, "invalid job id") from e
        if job_id not in self.jobs:
            raise ApiError(404, "job not found")
        return self.jobs[job_id]

    def status(self, job_id: str) -> dict:
        return self._job(job_id).response()

    def result(self, job_id: str) -> dict:
        job = self._job(job_id)
        if job.status != "completed":
            raise ApiError(409, f"job is {job.status}")
        found = store.stored_result(self.config.processing.results_dir, job_id)
        if found is None:
            raise ApiError(500, "result missing")
        return found

    def cancel(self, job_id: str) -> dict:
        job = self._job(job_id)
        if job.status not in ("queued", "processing"):
            raise ApiError(409, f"job is {job.status}")
        job.stop.set()
        self._move(job, "failed", CANCELLED)
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        return job.response()

    def cancel_all(self) -> int:
        open_jobs = [j.id for j in list(self.jobs.values()) if j.status in ("queued", "processing")]
        for job_id in open_jobs:
            self.cancel(job_id)
        return len(open_jobs)

    def health(self, run: Callable[[list[str], float], str] = media.run_tool, get: Callable[[str], dict] | None = None) -> dict:
        """Versions of the tools or why there are none, and ok only if all of them answer."""
        c = self.config

        def version(*command: str) -> str:
            return run(list(command), 30).partition("\n")[0].strip()

        def tried(ask: Callable[[], object]) -> object:
            try:
                return ask()
            except EngineError as e:
                return {"error": str(e)}

        def model_server() -> str:
            models.check_model_server(c.ollama.endpoint, c.ollama.model, get)
            return "ok"

        found = {
            "ffmpeg": tried(lambda: {"ffmpeg_version": version(c.ffmpeg.path, "-version"), "ffprobe_version": version(c.ffmpeg.probe_path, "-version")}),
            "ollama": tried(model_server),
            "ytdlp": tried(lambda: {"version": version(c.ytdlp.path, "--version")}),
        }
        good = all(not (isinstance(v, dict) and "error" in v) for v in found.values())
        return {"status": "ok" if good else "degraded", **found}
