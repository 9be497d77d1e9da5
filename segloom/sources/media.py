"""Recordings, their audio and their frames; the binaries that cut them are run per partition."""

from __future__ import annotations

import io
import os
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.config import Downloader, Media, Vision
from segloom.errors import DownloadError, MediaError
from segloom.functions.text import format_selector  # noqa: F401  (part of the source's surface)

#: Fixed values here and below: the sample format, tool arguments and the download selector.
RATE = 16_000
FULL_SCALE = 32767.0


def recordings(spark: SparkSession, directory: str) -> DataFrame:
    """The mp4 files of one directory, not of those below it, by path; the extension is case-sensitive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(directory)
    return files.where(F.col("path").rlike(r"[^/]\.mp4$")).select("path", "length", "modificationTime").orderBy("path")


def probed_duration(body: Column) -> Column:
    """Seconds from the probe's JSON answer, null if it names none."""
    return F.get_json_object(body, "$.format.duration").try_cast("double")


def decode_wav(data: bytes) -> np.ndarray:
    """Samples of a 16 kHz, mono, 16-bit recording as floats; any other layout raises."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getnchannels() != 1:
            raise MediaError(f"expected mono audio, got {w.getnchannels()} channels")
        if w.getframerate() != RATE:
            raise MediaError(f"expected {RATE} Hz audio, got {w.getframerate()} Hz")
        if w.getsampwidth() != 2:
            raise MediaError(f"expected 16-bit audio, got {8 * w.getsampwidth()}-bit")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / np.float32(FULL_SCALE)


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def audio_command(media: Media, video: str, start: float, end: float, out: str) -> list[str]:
    span = ["-y", "-ss", _number(start), "-to", _number(end), "-i", video]
    return [media.path, *span, "-vn", "-acodec", "pcm_s16le", "-ar", str(RATE), "-ac", "1", out]


def frames_command(media: Media, vision: Vision, video: str, start: float, end: float, directory: str) -> list[str]:
    span = ["-y", "-ss", _number(start), "-to", _number(end), "-i", video]
    pattern = os.path.join(directory, f"frame_%06d.{media.frame_format}")
    return [media.path, *span, "-vf", f"fps={_number(vision.fps)}", "-q:v", str(media.frame_quality), pattern]


def probe_command(media: Media, video: str) -> list[str]:
    return [media.probe_path, "-v", "quiet", "-print_format", "json", "-show_format", video]


def extract_commands(chunks: DataFrame, media: Media, vision: Vision) -> DataFrame:
    """The two command lines that :func:`extract_artifacts` runs for each chunk, in a folder named by chunk."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                where = os.path.join(r.job_dir, f"chunk_{r.chunk_index:03d}")
                audio = audio_command(media, r.path, r.start_seconds, r.end_seconds, os.path.join(where, "audio.wav"))
                seen = frames_command(media, vision, r.path, r.start_seconds, r.end_seconds, where)
                rows.append((r.job_id, r.chunk_index, " ".join(audio), " ".join(seen)))
            yield pd.DataFrame(rows, columns=["job_id", "chunk_index", "audio", "frames"])

    given = chunks.select("job_id", "job_dir", "path", F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_seconds", "end_seconds")
    return given.mapInPandas(lines, "job_id string, chunk_index bigint, audio string, frames string")


def run_tool(command: list[str], timeout: float | None = None) -> str:
    """Standard output of a tool; a failure raises with its last lines."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    except FileNotFoundError as e:
        raise MediaError(f"{command[0]} not found") from e
    except subprocess.TimeoutExpired as e:
        raise MediaError(f"{command[0]} timed out after {timeout} s") from e
    if done.returncode:
        raise MediaError(f"{command[0]} failed with code {done.returncode}: {done.stderr[-500:]}")
    return done.stdout


def probe_durations(df: DataFrame, media: Media, run: Callable[[list[str]], str] = run_tool) -> DataFrame:
    """Adds body and error of the probe for each path."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append((path, run(probe_command(media, path)), None))
                except MediaError as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "body", "error"])

    out = df.select("path").mapInPandas(probe, "path string, body string, error string")
    seconds = probed_duration(F.col("body"))
    missing = F.when(seconds.isNull(), F.lit("ffmpeg error: the probe names no duration"))
    return out.select("path", seconds.alias("duration_seconds"), F.coalesce("error", missing).alias("error"))


def extract_artifacts(chunks: DataFrame, media: Media, vision: Vision, run: Callable[[list[str]], str] = run_tool) -> DataFrame:
    """Audio and frames of each chunk (path, job_dir, chunk_index, start_seconds, end_seconds), extracted in parallel.

    ``job_dir`` lies in a folder that all executors share. Each attempt gets a fresh folder, so frames of an earlier
    run are never listed.
    """
    columns = ["job_id", "chunk_index", "audio_path", "frame_paths", "error"]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                where = os.path.join(r.job_dir, f"chunk_{r.chunk_index:03d}", uuid.uuid4().hex[:8])
                os.makedirs(where, exist_ok=True)
                audio = os.path.join(where, "audio.wav")
                try:
                    run(audio_command(media, r.path, r.start_seconds, r.end_seconds, audio))
                    run(frames_command(media, vision, r.path, r.start_seconds, r.end_seconds, where))
                    found = sorted(e.path for e in os.scandir(where) if e.is_file() and e.name.endswith("." + media.frame_format))
                    rows.append((r.job_id, r.chunk_index, audio, found, None))
                except MediaError as e:
                    rows.append((r.job_id, r.chunk_index, None, [], str(e)))
            yield pd.DataFrame(rows, columns=columns)

    schema = "job_id string, chunk_index bigint, audio_path string, frame_paths array<string>, error string"
    return chunks.select("job_id", "job_dir", "path", "chunk_index", "start_seconds", "end_seconds").mapInPandas(extract, schema)


def selector_of(config: Downloader, resolution: str | None = None, fps: int | None = None) -> str:
    height, rate = resolution or config.max_resolution, fps or config.max_fps
    return f"bestvideo[height<={height}][fps<={rate}]+bestaudio/best[height<={height}]"


def download_video(
    config: Downloader,
    url: str,
    directory: str,
    resolution: str | None = None,
    fps: int | None = None,
    run: Callable[..., str] = run_tool,
) -> tuple[str, str]:
    """(path, title) of a downloaded recording: a dry run names the file, then it is fetched under the timeout."""
    os.makedirs(directory, exist_ok=True)
    template = os.path.join(directory, "%(title)s.%(ext)s")
    base = [config.path, "-f", selector_of(config, resolution, fps), "--merge-output-format", "mp4", "-o", template]
    try:
        name = run([*base, "--print", "filename", "--skip-download", url], config.timeout_seconds).strip().splitlines()[-1]
        run([*base, url], config.timeout_seconds)
    except (MediaError, IndexError) as e:
        raise DownloadError(str(e)) from e
    path = os.path.splitext(name)[0] + ".mp4"
    if not os.path.exists(path):
        raise DownloadError(f"no file at {path} after the download")
    return path, os.path.splitext(os.path.basename(path))[0]


def write_manifest(artifacts: DataFrame, job_dir: str) -> None:
    """What was extracted of a recording, one JSON line a chunk, in the job's folder; written by the tasks."""
    artifacts.select("chunk_index", "start_seconds", "end_seconds", "audio_path", "frame_paths").coalesce(1).sortWithinPartitions(
        "chunk_index"
    ).write.mode("overwrite").json(os.path.join(job_dir, "manifest"))
