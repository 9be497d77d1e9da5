"""Boundaries to the external models: two protocols, run inside partitions."""

from __future__ import annotations

import base64
import json
import logging
import os
import time
import urllib.error
import urllib.request
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.config import Speech
from segloom.errors import ClientError, EngineError, MediaError, SpeechError, VisionError
from segloom.functions.timecode import format_timestamp
from segloom.operators.chunking import to_global
from segloom.operators.segments import classify
from segloom.sources.media import decode_wav, run_tool

log = logging.getLogger("segloom")
TRIES = 3
THINK_END = "</think>"


class Transcriber(Protocol):
    """Speech recogniser: rows of (start, end) in centiseconds from the chunk's start, and text."""

    def transcribe(self, wav_path: str) -> list[tuple[int, int, str]]: ...


class Describer(Protocol):
    """Vision model: the raw answer to a prompt with images."""

    def describe(self, prompt: str, images: list[str]) -> str: ...


def transcribe(artifacts: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """Speech and sound rows of each chunk in global time: job_id, chunk_index, ord, type, start, end, content.

    The model is made once per partition and only if the partition has a row. Chunks are independent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                began, model = time.monotonic(), model or make()
                heard = model.transcribe(r.audio_path)
                rows += [(r.job_id, r.chunk_index, k, t0, t1, text, r.start_seconds) for k, (t0, t1, text) in enumerate(heard)]
                log.info("%s: chunk %d speech took %.1f s, %d segments", r.job_id, r.chunk_index, time.monotonic() - began, len(heard))
            yield pd.DataFrame(rows, columns=["job_id", "chunk_index", "ord", "t0", "t1", "text", "start_seconds"])

    schema = "job_id string, chunk_index bigint, ord int, t0 bigint, t1 bigint, text string, start_seconds double"
    heard = artifacts.where("audio_path is not null").select("job_id", "chunk_index", "audio_path", "start_seconds").mapInPandas(run, schema)
    at = lambda c: format_timestamp(to_global(F.col("start_seconds"), F.col(c)))
    return classify(heard).select("job_id", "chunk_index", "ord", "type", at("t0").alias("start"), at("t1").alias("end"), "content")


def answer_text(answer: str) -> str:
    """Text of a vision answer: thinking removed, or its inside if nothing else is left; blank raises."""
    if not answer.strip():
        raise VisionError("empty response")
    text = answer.split(THINK_END, 1)[1].strip() if THINK_END in answer else answer.strip()
    if not text:
        text = answer.replace("<think>", "").replace(THINK_END, "").strip()
    if not text:
        raise VisionError("response holds no text")
    return text


def truncate_repetition(text: str) -> str:
    """Single-text form of the repetition guard, for use inside a partition."""
    seen: dict[str, int] = {}
    kept = []
    for sentence in text.split("."):
        key = sentence.strip().lower()
        if len(key.encode()) >= 15:
            seen[key] = seen.get(key, 0) + 1
            if seen[key] == 3:
                break
        kept.append(sentence)
    return ".".join(kept).strip() or text


def describe_batch(model: Describer, prompt: str, images: list[str], tries: int = TRIES) -> str:
    """Guarded description of one batch; only empty answers are tried again, transport errors are not."""
    for attempt in range(tries):
        try:
            return truncate_repetition(answer_text(model.describe(prompt, images)))
        except VisionError:
            if attempt + 1 == tries:
                raise
    raise VisionError("no answer")


def _context(spoken: list[str], seen: str | None) -> str:
    parts = []
    if spoken:
        parts.append("Recent dialogue: " + " ".join(spoken[-5:]))
    if seen is not None:
        cut = seen.encode()
        parts.append("Last visual: " + (cut[:200].decode(errors="ignore") + "..." if len(cut) > 200 else seen))
    return " ".join(parts)


REPORT = "job_id string, chunk_index bigint, frames int, batches int, segments int, seconds double, kind string, error string"
REPORT_SCHEMA = pa.schema(
    [("job_id", pa.string()), ("chunk_index", pa.int64()), ("frames", pa.int32()), ("batches", pa.int32()), ("segments", pa.int32()), ("seconds", pa.float64()), ("kind", pa.string()), ("error", pa.string())]
)


def describe(work: DataFrame, make: Callable[[], Describer], template: str, root: str, key: str) -> DataFrame:
    """Describes chunks and writes each one's rows as its checkpoint as soon as they are whole; gives a report a chunk.

    ``work`` has a row for each chunk left to do: job_id, chunk_index, speech (its rows), transcript, batches (their times and
    the paths of their frames) and carried, the context of the chunk before where that one was reused. A chunk's
    prompt holds what was said and seen in the chunk before, so a job's chunks run in order in one task and
    jobs run in parallel; that is the model's own constraint. Images are read batch by batch. A task that
    runs again takes the chunks it has finished from their checkpoints. An error of the model ends the job's
    report with it; anything else fails the task.
    """
    from segloom.operators.prompts import CONTEXT_AFTER, CONTEXT_BEFORE, TRANSCRIPT_AFTER, TRANSCRIPT_BEFORE
    from segloom.sources import store

    def run(table: pa.Table) -> pa.Table:
        model, context, last, out = None, "", None, []
        for r in sorted(table.to_pylist(), key=lambda r: r["chunk_index"]):
            began, index = time.monotonic(), r["chunk_index"]
            if last is None or index != last + 1:
                context = r["carried"] or ""
            last = index
            batches = r["batches"] or []
            rows = store.read_checkpoint(root, key, index)
            try:
                if rows is None:
                    rows = [{k: s[k] for k in ("type", "start", "end", "content")} for s in r["speech"] or []]
                    prompt = template
                    if context.strip():
                        prompt += CONTEXT_BEFORE + context + CONTEXT_AFTER
                    if (r["transcript"] or "").strip():
                        prompt += TRANSCRIPT_BEFORE + r["transcript"] + TRANSCRIPT_AFTER
                    for b in batches:
                        model = model or make()
                        seen = describe_batch(model, prompt, encode_frames(b["paths"]))
                        rows.append({"type": "visual", "start": b["start"], "end": b["end"], "content": seen})
                    store.save_checkpoint(root, key, index, rows)
            except EngineError as e:
                out.append((r["job_id"], index, 0, 0, 0, time.monotonic() - began, type(e).__name__, e.args[0] if e.args else ""))
                break
            said = [s["content"] for s in rows if s["type"] == "speech" and s["content"].strip()]
            context = _context(said, next((s["content"] for s in reversed(rows) if s["type"] == "visual"), None))
            frames = sum(len(b["paths"]) for b in batches)
            out.append((r["job_id"], index, frames, len(batches), len(rows), time.monotonic() - began, None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), REPORT_SCHEMA.types, strict=True)], schema=REPORT_SCHEMA)

    return work.groupBy("job_id").applyInArrow(run, REPORT)


def post_json(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 300) -> dict:
    """One POST; any failure of transport or status raises at once."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise ClientError(f"request to {url} failed: {e}") from e


class HttpDescriber:
    """Describer over a chat endpoint that takes base64 images."""

    def __init__(self, endpoint: str, model: str, max_tokens: int = 4096, num_ctx: int = 65536, timeout: float = 300, post=post_json):
        self.url, self.model, self.timeout, self.post = endpoint.rstrip("/") + "/api/chat", model, timeout, post
        self.options = {"num_predict": max_tokens, "num_ctx": num_ctx}

    def describe(self, prompt: str, images: list[str]) -> str:
        message: dict = {"role": "user", "content": prompt}
        if images:
            message["images"] = images
        body = {"model": self.model, "messages": [message], "stream": False, "options": self.options}
        answer = self.post(self.url, body, None, self.timeout)
        content = (answer.get("message") or {}).get("content")
        if content is None:
            raise ClientError("response has no message content")
        return content


def installed_models(tags: dict) -> list[str]:
    return [m["name"] for m in tags.get("models", [])]


def model_installed(tags: dict, model: str) -> bool:
    return any(name.startswith(model) for name in installed_models(tags))


def encode_frames(paths: list[str]) -> list[str]:
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(base64.b64encode(f.read()).decode())
    return out


class CommandRecogniser:
    """Transcriber over a recogniser's command line, which writes JSON beside the recording."""

    def __init__(self, config: Speech, run: Callable[..., str] = run_tool):
        if not os.path.exists(config.model_path):
            raise SpeechError(f"failed to load model '{config.model_path}'")
        self.config, self.run = config, run

    def transcribe(self, wav_path: str) -> list[tuple[int, int, str]]:
        try:
            with open(wav_path, "rb") as f:
                if not len(decode_wav(f.read())):
                    return []
            out = os.path.splitext(wav_path)[0] + ".speech"
            c = self.config
            self.run([c.path, "-m", c.model_path, "-l", c.language, "-t", str(c.n_threads), "-np", "-oj", "-of", out, "-f", wav_path])
            with open(out + ".json", encoding="utf-8", errors="replace") as f:
                heard = json.load(f)["transcription"]
            return [(s["offsets"]["from"] // 10, s["offsets"]["to"] // 10, s["text"]) for s in heard]
        except MediaError as e:
            raise SpeechError(e.args[0] if e.args else "") from e
        except (OSError, EOFError, wave.Error, ValueError, KeyError, TypeError) as e:
            raise SpeechError(f"transcription failed: {e}") from e


def check_model_server(endpoint: str, model: str, get: Callable[[str], dict] | None = None) -> None:
    """Raises unless the model server answers and has the configured model."""

    def fetch(url: str) -> dict:
        with urllib.request.urlopen(url, timeout=10) as answer:
            return json.loads(answer.read())

    try:
        tags = (get or fetch)(endpoint.rstrip("/") + "/api/tags")
        if not model_installed(tags, model):
            raise VisionError(f"model '{model}' is not installed")
    except (urllib.error.URLError, OSError, ValueError, KeyError) as e:
        raise VisionError(f"cannot reach {endpoint}: {e}") from e
