import dataclasses

import pytest

from segloom import config as C
from segloom.errors import ConfigError


def test_defaults_are_valid():
    C.ClientConfig().validate()
    C.ServerConfig().validate()
    s = C.ServerConfig()
    assert (s.ffmpeg.chunk_duration_secs, s.vision.fps, s.vision.max_frames_per_request, s.server.bind_address) == (180, 2.0, 15, "0.0.0.0:3001")
    assert C.ClientConfig().server.url == "http://localhost:3001"
    assert C.Media().probe_path == "ffprobe" and C.Media(path="/opt/bin/ffmpeg").probe_path == "/opt/bin/ffprobe"


@pytest.mark.parametrize(
    "section,key,value",
    [("server", "listen_address", ""), ("server", "listen_port", 0), ("server", "max_concurrent_jobs", 0), ("ffmpeg", "path", ""), ("ffmpeg", "chunk_duration_secs", 0), ("ffmpeg", "frame_format", "gif"),
     ("ffmpeg", "frame_quality", 0), ("ffmpeg", "frame_quality", 32), ("whisper", "model_path", ""), ("whisper", "n_threads", 0), ("ollama", "endpoint", ""), ("ollama", "model", ""), ("ollama", "timeout_seconds", 0),
     ("vision", "fps", 0.0), ("vision", "max_tokens", 0), ("vision", "max_frames_per_request", 0), ("processing", "temp_dir", ""), ("processing", "results_dir", ""), ("ytdlp", "path", ""), ("ytdlp", "max_fps", 0), ("ytdlp", "timeout_seconds", 0)],
)
def test_server_rules(section, key, value):
    with pytest.raises(ConfigError, match=f"{section}.{key}"):
        C.from_table(C.ServerConfig, {section: {key: value}}).validate()


@pytest.mark.parametrize("section,key,value", [("server", "host", ""), ("server", "port", 0), ("polling", "poll_interval_secs", 0), ("polling", "timeout_secs", 0), ("openai", "model", ""), ("openai", "endpoint", ""), ("openai", "max_tokens", 0)])
def test_client_rules(section, key, value):
    with pytest.raises(ConfigError, match=f"{section}.{key}"):
        C.from_table(C.ClientConfig, {section: {key: value}}).validate()


def test_files(tmp_path):
    assert C.load_config(C.ServerConfig, "server.toml", tmp_path) == C.ServerConfig()
    (tmp_path / "server.toml").write_text("[vision]\nfps = 1\n[unknown]\nx = 1\n")
    assert C.load_config(C.ServerConfig, "server.toml", tmp_path).vision == C.Vision(fps=1.0)
    for text in ("[vision]\nfps = 'fast'\n", "vision = 3\n", "[vision\n", "[server]\nlisten_port = -1\n"):
        (tmp_path / "server.toml").write_text(text)
        with pytest.raises(ConfigError):
            C.load_config(C.ServerConfig, "server.toml", tmp_path)


def test_profiles(tmp_path):
    (tmp_path / "charts.toml").write_text("[vision]\nfps = 0.5\n")
    (tmp_path / "bad.toml").write_text("[vision]\nfps = 0.0\n")
    assert C.list_profiles(tmp_path) == ["bad", "charts"] and C.list_profiles(tmp_path / "no") == []
    got = C.resolve_config(C.ServerConfig(), "charts", tmp_path)
    assert got.vision.fps == 0.5 and got.vision.max_tokens == 4096 and got.fingerprint() != C.ServerConfig().fingerprint()
    for name in ("none", "../charts", "bad", ""):
        with pytest.raises(ConfigError):
            C.resolve_config(C.ServerConfig(), name, tmp_path)
    assert C.merge_tables({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}, "d": {"e": 1}}) == {"a": {"b": 1, "c": [3]}, "d": {"e": 1}}


def test_addresses_and_prompts(tmp_path):
    c = C.ClientConfig()
    at = lambda a: dataclasses.astuple(C.with_server(c, a).server)
    assert at("h:99") == ("h", 99) and at("h:x") == ("h:x", 3001) and at("h") == ("h", 3001) and at(None) == ("localhost", 3001)
    assert C.prompt_template(None, "d") == "d" == C.prompt_template("", "d")
    (tmp_path / "p").write_text("file")
    assert C.prompt_template(str(tmp_path / "p"), "d") == "file"
    with pytest.raises(ConfigError):
        C.prompt_template(str(tmp_path / "no"), "d")
