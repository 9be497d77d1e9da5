import io
import json
import os
import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from segloom import cli, formatting, models
from segloom.config import ClientConfig, Processing, ServerConfig, VisionServer
from segloom.engine import Engine, process_video
from segloom.errors import ApiError, Cancelled, ClientError, VisionError
from segloom.sources import store


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Words:
    def transcribe(self, wav_path):
        return [(0, 100, " Hello there "), (100, 200, "[MUSIC]"), (200, 300, "  ")]


class Ledger:
    """Prompts of a describer that breaks at a given call, kept in a file that tasks share."""

    def __init__(self, path, breaks=None):
        self.path, self.breaks = path, breaks

    def describe(self, prompt, images):
        with open(self.path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        n = sum(1 for _ in open(self.path))
        if self.breaks == n:
            raise RuntimeError("the machine went away")
        return f"scene {len(prompt)}"


class Pictures:
    def describe(self, prompt, images):
        return f"<think>x</think> {len(images)} pictures{' after ' + prompt.split('Last visual: ')[1].split(chr(34))[0] if 'Last visual: ' in prompt else ''}"


def tools(seconds, calls=None):
    def run(command, timeout=None):
        if calls is not None:
            calls.append(command)
        if command[0].endswith("ffprobe"):
            return json.dumps({"format": {"duration": str(seconds)}})
        if command[-1].endswith(".wav"):
            open(command[-1], "wb").close()
        else:
            for i in range(17):
                with open(command[-1].replace("%06d", f"{i:06d}"), "wb") as f:
                    f.write(b"jpg")
        return ""

    return run


@pytest.fixture
def config(tmp_path):
    c = ServerConfig(processing=Processing(str(tmp_path / "tmp"), str(tmp_path / "results")), ollama=VisionServer(prompt_template_path=None))
    return c


@pytest.fixture
def video(tmp_path):
    path = tmp_path / "in" / "clip.mp4"
    path.parent.mkdir()
    path.write_bytes(b"film")
    return str(path)


def test_pipeline_and_resume(spark, config, video):
    config.processing.cleanup_checkpoints = False
    timeline = process_video(spark, config, video, "job1", Words, Pictures, run=tools(200.0))
    assert timeline["source"] == "clip.mp4" and timeline["duration_seconds"] == 200.0
    got = [(s["type"], s["start"], s["content"]) for s in timeline["segments"]]
    assert got[:3] == [("speech", "00:00:00.000", "Hello there"), ("visual", "00:00:00.000", "15 pictures"), ("sound", "00:00:01.000", "music")]
    assert [g[1] for g in got] == sorted(g[1] for g in got) and sum(g[0] == "visual" for g in got) == 4
    assert any(g[2] == "15 pictures after 2 pictures" for g in got)
    again = process_video(spark, config, video, "job2", None, None, run=tools(200.0))
    assert again == timeline
    config.processing.cleanup_checkpoints = True
    assert process_video(spark, config, video, "job3", Words, Pictures, force=True, run=tools(10.0))["duration_seconds"] == 10.0
    with pytest.raises(Cancelled):
        process_video(spark, config, video, "job4", Words, Pictures, cancelled=lambda: True, run=tools(10.0))


def test_a_crash_loses_only_the_chunk_it_hit(spark, config, video, tmp_path):
    config.processing.cleanup_checkpoints = False
    config.vision.max_frames_per_request = 17
    whole, broken = tmp_path / "whole", tmp_path / "broken"
    want = process_video(spark, config, video, "a", Words, lambda: Ledger(whole), run=tools(720.0))
    prompts = [json.loads(x) for x in whole.read_text().splitlines()]
    assert len(prompts) == 4 and all("Last visual: scene" in p and "Recent dialogue: Hello there" in p for p in prompts[1:]) and "Last visual" not in prompts[0]
    config.vision.max_tokens += 1  # other settings, other checkpoints
    root = config.processing.temp_dir
    before = set(os.listdir(root))
    with pytest.raises(Exception, match="the machine went away"):
        process_video(spark, config, video, "b", Words, lambda: Ledger(broken, 4), run=tools(720.0))
    (key,) = (d for d in set(os.listdir(root)) - before if os.path.isdir(os.path.join(root, d, "checkpoints")))
    assert sorted(os.listdir(store.checkpoint_dir(root, key))) == ["chunk_000.json", "chunk_001.json", "chunk_002.json"]
    broken.unlink()
    calls = []
    assert process_video(spark, config, video, "c", Words, lambda: Ledger(broken), run=tools(720.0)) == want
    assert [json.loads(x) for x in broken.read_text().splitlines()] == prompts[3:]
    assert process_video(spark, config, video, "d", None, None, run=tools(720.0, calls)) == want
    assert len(calls) == 0 or all(c[0].endswith("ffprobe") for c in calls)
    # A hole in the middle is filled with the context of the chunk before it, and the prompt's text is part of the key.
    store.checkpoint_path(root, key, 1).unlink()
    broken.unlink()
    assert process_video(spark, config, video, "e", Words, lambda: Ledger(broken), run=tools(720.0)) == want
    assert [json.loads(x) for x in broken.read_text().splitlines()] == prompts[1:2]
    assert config.fingerprint("one") != config.fingerprint("another")


def test_model_errors_and_chunks_without_frames(spark, config, video):
    class Down:
        def describe(self, prompt, images):
            raise ClientError("down")

    with pytest.raises(ClientError, match="down"):
        process_video(spark, config, video, "a", Words, Down, run=tools(10.0))

    def no_frames(command, timeout=None):
        if command[0].endswith("ffprobe"):
            return json.dumps({"format": {"duration": "200"}})
        if command[-1].endswith(".wav"):
            open(command[-1], "wb").close()
        return ""

    timeline = process_video(spark, config, video, "b", Words, None, run=no_frames)
    assert [s["type"] for s in timeline["segments"]] == ["speech", "sound"] * 2


def test_recogniser_command(tmp_path):
    from segloom.config import Speech
    from segloom.errors import MediaError, SpeechError

    model, sound = tmp_path / "m.bin", tmp_path / "a.wav"
    model.write_bytes(b"x")
    calls = []

    def run(command):
        calls.append(command)
        with open(command[command.index("-of") + 1] + ".json", "w") as f:
            json.dump({"transcription": [{"offsets": {"from": 0, "to": 1234}, "text": " Hello"}]}, f)
        return ""

    def wav(n, channels=1):
        import wave

        with wave.open(str(sound), "wb") as w:
            w.setnchannels(channels), w.setframerate(16000), w.setsampwidth(2)
            w.writeframes(b"\0\0" * n * channels)

    r = models.CommandRecogniser(Speech(model_path=str(model)), run)
    wav(10)
    assert r.transcribe(str(sound)) == [(0, 123, " Hello")] and calls[0][0] == "whisper-cli" and str(model) in calls[0]
    wav(0)
    assert r.transcribe(str(sound)) == [] and len(calls) == 1
    wav(10, 2)
    with pytest.raises(SpeechError, match="mono"):
        r.transcribe(str(sound))
    sound.write_bytes(b"junk")
    with pytest.raises(SpeechError):
        r.transcribe(str(sound))

    def broken(command):
        raise MediaError("no such tool")

    wav(10)
    for bad in (broken, lambda c: ""):
        (tmp_path / "a.speech.json").unlink(missing_ok=True)
        with pytest.raises(SpeechError):
            models.CommandRecogniser(Speech(model_path=str(model)), bad).transcribe(str(sound))
    with pytest.raises(SpeechError, match="model"):
        models.CommandRecogniser(Speech(model_path="/no/model"))


def test_shared_folder(spark, config):
    from segloom.engine import job_root
    from segloom.runtime import shared_folder

    assert job_root(spark, config) == config.processing.temp_dir
    config.processing.temp_dir = None
    assert job_root(spark, config) == shared_folder(spark) and shared_folder(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def timeline_of(path):
    return {"source": os.path.basename(path), "duration_seconds": 1.0, "segments": []}


def ended(engine, job):
    for _ in range(2000):
        if engine.status(job.id)["status"] in ("completed", "failed"):
            return engine.status(job.id)
        time.sleep(0.01)
    raise AssertionError("not ended")


def uploaded(engine):
    path = engine.upload_path()
    path.write_bytes(b"x")
    return path


def test_jobs(spark, config, video):
    gate, began = threading.Event(), threading.Event()

    def process(spark, config, path, job, force, source_name, cancelled):
        began.set()
        gate.wait(20)
        if "bad" in source_name:
            raise VisionError("broken")
        return timeline_of(source_name)

    e = Engine(spark, config, process)
    first = e.submit(video)
    began.wait(20)
    second, third = e.submit(video), e.upload("bad.mp4", uploaded(e))
    assert e.status(second.id)["status"] == "queued"
    with pytest.raises(ApiError, match="processing|queued"):
        e.result(second.id)
    e.cancel(second.id)
    gate.set()
    assert ended(e, first)["status"] == "completed" and e.result(first.id) == timeline_of("clip.mp4")
    assert ended(e, third) == {"id": third.id, "source": "bad.mp4", "status": "failed", "error": "vision model error: broken"}
    assert e.status(second.id)["error"] == "cancelled by user"
    for call, status in ((lambda: e.submit(""), 400), (lambda: e.submit("/no.mp4"), 400), (lambda: e.submit(os.path.dirname(video)), 400), (lambda: e.submit(video, profile="none"), 400),
                         (lambda: e.submit_url(""), 400), (lambda: e.upload("a.txt", video), 400), (lambda: e.status("x"), 400), (lambda: e.status("0" * 32), 404), (lambda: e.cancel(first.id), 409)):
        with pytest.raises(ApiError) as err:
            call()
        assert err.value.status == status
    assert len([j for j in e.jobs.values() if j.status == "queued"]) == 0
    back = Engine(spark, config, process)
    assert back.result(first.id) == timeline_of("clip.mp4") and back.cancel_all() == 0 and back.loaded == 1


def test_urls_and_health(spark, config, video):
    from segloom.errors import MediaError

    e = Engine(spark, config, lambda *a, **k: timeline_of(k["source_name"]), download=lambda c, url, d, r, f: (video, "A title"))
    job = e.submit_url("https://x.invalid/v")
    ended(e, job)
    assert e.result(job.id)["source"] == "A title.mp4"
    tags = {"models": [{"name": config.ollama.model}]}
    assert e.health(lambda c, t: f"{c[0]} 7\nmore", lambda url: tags) == {
        "status": "ok", "ffmpeg": {"ffmpeg_version": "ffmpeg 7", "ffprobe_version": "ffprobe 7"}, "ollama": "ok", "ytdlp": {"version": "yt-dlp 7"}
    }

    def gone(command, timeout):
        raise MediaError(f"{command[0]} not found")

    found = e.health(gone, lambda url: {})
    assert found["status"] == "degraded" and all("error" in found[k] for k in ("ffmpeg", "ollama", "ytdlp"))
    assert found["ytdlp"] == {"error": "ffmpeg error: yt-dlp not found"}


def test_tries_only_for_empty_answers():
    class Model:
        def __init__(self, *answers):
            self.answers, self.n = list(answers), 0

        def describe(self, prompt, images):
            self.n += 1
            a = self.answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

    assert models.describe_batch(Model("", "<think> </think>", "ok"), "p", []) == "ok"
    m = Model("", "", "", "late")
    with pytest.raises(VisionError):
        models.describe_batch(m, "p", [])
    m = Model(ClientError("down"), "late")
    with pytest.raises(ClientError):
        models.describe_batch(m, "p", [])
    assert m.n == 1
    sent = []
    d = models.HttpDescriber("http://h/", "m", post=lambda *a: sent.append(a) or {"message": {"content": "x"}})
    assert d.describe("p", []) == "x" and "images" not in sent[0][1]["messages"][0] and sent[0][0] == "http://h/api/chat"
    assert models.model_installed({"models": [{"name": "qwen:8b"}]}, "qwen") and not models.model_installed({}, "q")


def test_guard_forms_agree(spark):
    from segloom.operators.guards import guard_repetition

    s = "A sentence that is long. "
    texts = [s * 4, s + "x. " + s + s + "y.", "", "  ", "a.b.c", "É" * 20 + ". " + "é" * 20 + "." + "é" * 20 + ".end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.guarded_text for r in guard_repetition(df).collect()} == {i: models.truncate_repetition(t) for i, t in enumerate(texts)}


def long_timeline():
    seg = {"type": "speech", "start": "00:00:00.000", "end": "00:00:01.000", "content": "x" * 4000}
    return {"source": "a.mp4", "duration_seconds": 1.0, "segments": [dict(seg) for _ in range(60)]}


def test_formatting():
    calls = []

    def post(url, body, headers, timeout):
        calls.append((url, body))
        if "prompt" in body:
            return {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "S"}]}]}
        return {"choices": [{"message": {"content": f"head {len(calls)}\n## Scene"}}]}

    f = formatting.ChatFormatter("https://h/v1/chat/completions", "key", "m", 10, post)
    short = long_timeline() | {"segments": long_timeline()["segments"][:2]}
    assert formatting.format_timeline(short, f, "SYS") == "head 1\n## Scene" and calls[0][1]["messages"][0]["content"] == "SYS"
    calls.clear()
    told = []
    text = formatting.format_timeline(long_timeline(), f, "SYS", say=told.append)
    assert [t.split(",")[0] for t in told] == ["section 1/3", "section 2/3", "section 3/3"]
    assert len(calls) == 3 and text.count("## Scene") == 3
    assert calls[1][1]["messages"][0]["content"].startswith("You are continuing") and "head 1\n\n\nNow" in calls[1][1]["messages"][0]["content"]
    assert sum(len(json.loads(c[1]["messages"][1]["content"])["segments"]) for c in calls) == 60
    assert formatting.format_timeline(long_timeline(), f, "SYS", "pid") == "S" and calls[-1][0] == "https://h/v1/responses"
    with pytest.raises(ClientError):
        formatting.ChatFormatter("h", "", "m", 1, post)
    empty = formatting.ChatFormatter("h", "k", "m", 1, lambda *a: {"choices": []})
    with pytest.raises(ClientError):
        empty.chat("a", "b")


@pytest.fixture
def served(spark, config, video):
    from segloom.server import serve

    def process(spark, config, path, job, force, source_name, cancelled):
        if "b.mp4" in source_name:
            raise VisionError("no")
        return timeline_of(source_name)

    server = serve(Engine(spark, config, process, download=lambda *a: (video, "T")), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def home_of(tmp_path, monkeypatch, port, more=""):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    home = tmp_path / "home" / ".segloom"
    (home / "config").mkdir(parents=True)
    text = f'[server]\nhost = "127.0.0.1"\nport = {port}\n[polling]\npoll_interval_secs = 1\ntimeout_secs = 30\n{more}'
    (home / "config" / "client.toml").write_text(text)
    return home


def test_cli(spark, served, video, tmp_path, monkeypatch):
    home = home_of(tmp_path, monkeypatch, served.server_address[1], f'[output]\ndir = "{tmp_path}/results"\n')
    said = []
    run = lambda *argv: cli.main(list(argv), lambda: spark, said.append)
    out = tmp_path / "out.json"
    assert run("process", video, "-o", str(out)) == 0 and json.loads(out.read_text()) == timeline_of("clip.mp4")
    assert run("process", video) == 0 and any(s.startswith("cached: ") for s in said)
    assert json.loads((tmp_path / "results" / "clip.json").read_text()) == timeline_of("clip.mp4")
    assert run("process", "https://x.invalid/v") == 0 and (tmp_path / "results" / "T.json").exists() and run("process") == 2
    (tmp_path / "in" / "b.mp4").write_bytes(b"x")
    said.clear()
    assert run("process", os.path.dirname(video), "--force") == 1 and said[-1] == "1 of 2 processed" and any("vision model error: no" in s for s in said)
    assert run("list") == 0 and any("clip" in s for s in said)
    said.clear()
    assert run("doctor") == 1 and any("reachable" in s for s in said) and any(s.startswith("[!!] ffmpeg: ") for s in said) and "[ok] configuration is valid" in said
    assert run("cancel", "all") == 0 and said[-1] == "cancelled 0 jobs"
    assert run("cancel", "nope") == 1 and run("process", "/no.mp4") == 1 and run("process", "-s", "127.0.0.1:9", "--force", video) == 1
    args = cli.parser().parse_args(["format", store.cache_hash(os.path.realpath(video))])
    path = cli.run_format(args, ClientConfig(), home / "cache", "key", lambda *a: {"choices": [{"message": {"content": "MD"}}]})
    assert path.endswith("formatted.md") and open(path).read() == "MD"


def test_cli_starts_without_parts(spark, tmp_path, monkeypatch):
    """Nothing is given from outside: the default session, engine, client and server."""
    home_of(tmp_path, monkeypatch, 9)
    (tmp_path / "home" / ".segloom" / "config" / "server.toml").write_text(f'[processing]\nresults_dir = "{tmp_path}/results"\n')
    assert cli.main(["list"]) == 0 and cli.main(["doctor"]) == 1 and cli.main(["cancel", "all"]) == 1
    (tmp_path / "home" / ".segloom" / "config" / "client.toml").write_text("[server")
    assert cli.main(["cancel", "all"]) == 1
    up = threading.Event()
    started = []
    ready = lambda server: (started.append(server), up.set())
    thread = threading.Thread(target=lambda: cli.main(["serve", "--address", "127.0.0.1", "--port", "0"], ready=ready), daemon=True)
    thread.start()
    assert up.wait(60)
    from segloom.server import Client

    client = Client(f"http://127.0.0.1:{started[0].server_address[1]}")
    assert client.health()["status"] == "degraded" and client.cancel_all() == 0
    film = tmp_path / "x.mp4"
    film.write_bytes(b"x")
    job = client.upload(str(film))
    assert client.wait(job["id"], 0.1, 60)["error"].startswith("ffmpeg error: ")
    started[0].shutdown()
    thread.join(20)
    assert not thread.is_alive()


def test_http(spark, config, video, served):
    from segloom.server import Client, Form

    c = Client(f"http://127.0.0.1:{served.server_address[1]}")
    up, there, url = c.upload(video, force=True), c.submit(video), c.submit_url("https://x.invalid/v", max_fps=30)
    for job, name in ((up, "clip.mp4"), (there, "clip.mp4"), (url, "T.mp4")):
        assert c.wait(job["id"], 0.01, 20)["status"] == "completed"
        assert c.result(job["id"]) == timeline_of(name)
    assert c.health()["status"] == "degraded" and c.cancel_all() == 0
    for call, status in ((lambda: c.status("x"), 400), (lambda: c.result("0" * 32), 404), (lambda: c.cancel(up["id"]), 409), (lambda: c.submit(""), 400),
                         (lambda: c._call("GET", "/none"), 404), (lambda: c._call("POST", "/jobs", b"{"), 400), (lambda: c._call("POST", "/jobs/upload", b"x", "text/plain"), 400)):
        with pytest.raises(ApiError) as err:
            call()
        assert err.value.status == status
    with pytest.raises(ClientError):
        Client("http://127.0.0.1:9").health()
    root, kept = config.processing.temp_dir, [d for d in os.listdir(config.processing.temp_dir) if d.startswith("upload-")]
    refused = os.path.join(os.path.dirname(video), "clip.avi")
    os.link(video, refused)
    for path, profile in ((refused, None), (video, "no-such-profile")):
        with pytest.raises(ApiError) as err:
            c.upload(path, profile=profile)
        assert err.value.status == 400 and [d for d in os.listdir(root) if d.startswith("upload-")] == kept
    import urllib.request

    body = json.dumps({"source": video}).encode()
    request = urllib.request.Request(c.url + "/jobs", body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request) as answer:
        assert answer.status == 201


class Trickle(io.BytesIO):
    """Gives few bytes at a time, so that marks fall across blocks."""

    def read(self, n=-1):
        return super().read(min(n, 3) if n >= 0 else 3)


def test_forms_are_read_as_streams():
    from segloom.server import Form

    data = bytes(range(256)) * 20 + b"\r\n--almost\r\n--b no"
    text = b'--b\r\nContent-Disposition: form-data; name="force"\r\n\r\ntrue\r\n--b\r\nContent-Disposition: form-data; name="file"; filename="a.mp4"\r\n\r\n' + data + b'\r\n--bb--\r\n'
    text = text.replace(b"\r\n--bb--", b"\r\n--bound--").replace(b"--b\r\nContent", b"--bound\r\nContent")
    for stream in (Trickle(text), io.BytesIO(text)):
        form = Form(stream, len(text), "multipart/form-data; boundary=bound")
        found = [(name, file, b"".join(content)) for name, file, content in form.fields()]
        assert found == [("force", None, b"true"), ("file", "a.mp4", data)] and form.left == 0
    for bad in (text[:50], b"nothing", b""):
        with pytest.raises(ApiError):
            list((n, b"".join(c)) for n, _, c in Form(io.BytesIO(bad), len(bad), "multipart/form-data; boundary=bound").fields())
    with pytest.raises(ApiError):
        Form(io.BytesIO(b""), 0, "text/plain")


def test_model_server():
    tags = {"models": [{"name": "m:8b"}]}
    models.check_model_server("http://h", "m", lambda url: tags)
    with pytest.raises(VisionError, match="not installed"):
        models.check_model_server("http://h", "n", lambda url: tags)
    with pytest.raises(VisionError, match="cannot reach"):
        models.check_model_server("http://127.0.0.1:9", "m")
