"""Layered configuration: defaults, then a TOML file, then a named profile, then overrides."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, TypeVar

from segloom.errors import ConfigError

HOME = ".segloom"
#: The defaults below are fixed values.


@dataclass
class ClientServer:
    host: str = "localhost"
    port: int = 3001

    @property
    def url(self) -> str:
        return f"http://{self.host}:{self.port}"


@dataclass
class Output:
    dir: str | None = None


@dataclass
class Polling:
    poll_interval_secs: int = 3
    timeout_secs: int = 1800


@dataclass
class Formatter:
    model: str = "gpt-5.4"
    endpoint: str = "https://api.openai.com/v1/chat/completions"
    max_tokens: int = 4096
    format_prompt_path: str | None = "prompts/format.txt"


@dataclass
class ClientConfig:
    server: ClientServer = field(default_factory=ClientServer)
    output: Output = field(default_factory=Output)
    polling: Polling = field(default_factory=Polling)
    openai: Formatter = field(default_factory=Formatter)

    def validate(self) -> None:
        filled(self, "server.host")
        positive(self, "server.port", "polling.poll_interval_secs", "polling.timeout_secs")
        filled(self, "openai.model", "openai.endpoint")
        positive(self, "openai.max_tokens")


@dataclass
class Listen:
    listen_address: str = "0.0.0.0"
    listen_port: int = 3001
    max_concurrent_jobs: int = 1

    @property
    def bind_address(self) -> str:
        return f"{self.listen_address}:{self.listen_port}"


@dataclass
class Media:
    path: str = "ffmpeg"
    chunk_duration_secs: int = 180
    frame_format: str = "jpg"
    frame_quality: int = 2

    @property
    def probe_path(self) -> str:
        parent = os.path.dirname(self.path)
        return os.path.join(parent, "ffprobe") if parent else "ffprobe"


@dataclass
class Speech:
    path: str = "whisper-cli"
    model_path: str = "models/ggml-large-v3-turbo.bin"
    language: str = "en"
    n_threads: int = 8


@dataclass
class VisionServer:
    endpoint: str = "http://localhost:11434"
    model: str = "qwen3-vl:8b"
    prompt_template_path: str | None = "prompts/vision.txt"
    default_prompt: str = "Describe the visual content of these video frames in detail."
    timeout_seconds: int = 300
    num_ctx: int = 65536


@dataclass
class Vision:
    fps: float = 2.0
    max_tokens: int = 4096
    max_frames_per_request: int = 15


@dataclass
class Processing:
    #: A folder that all executors share; None takes one beside the session's checkpoints.
    temp_dir: str | None = None
    results_dir: str = field(default_factory=lambda: str(Path.home() / HOME / "server" / "results"))
    max_upload_bytes: int = 4_294_967_296
    cleanup_checkpoints: bool = True


@dataclass
class Downloader:
    path: str = "yt-dlp"
    max_resolution: str = "1080"
    max_fps: int = 30
    timeout_seconds: int = 600


@dataclass
class ServerConfig:
    server: Listen = field(default_factory=Listen)
    ffmpeg: Media = field(default_factory=Media)
    whisper: Speech = field(default_factory=Speech)
    ollama: VisionServer = field(default_factory=VisionServer)
    vision: Vision = field(default_factory=Vision)
    processing: Processing = field(default_factory=Processing)
    ytdlp: Downloader = field(default_factory=Downloader)

    def validate(self) -> None:
        """The first failing rule, in the order of the sections, raises."""
        filled(self, "server.listen_address")
        positive(self, "server.listen_port", "server.max_concurrent_jobs")
        filled(self, "ffmpeg.path")
        positive(self, "ffmpeg.chunk_duration_secs")
        if self.ffmpeg.frame_format not in ("jpg", "png"):
            raise ConfigError('ffmpeg.frame_format must be "jpg" or "png"')
        if not 1 <= self.ffmpeg.frame_quality <= 31:
            raise ConfigError("ffmpeg.frame_quality must be between 1 and 31")
        filled(self, "whisper.model_path")
        positive(self, "whisper.n_threads")
        filled(self, "ollama.endpoint", "ollama.model")
        positive(self, "ollama.timeout_seconds", "vision.fps", "vision.max_tokens", "vision.max_frames_per_request")
        if self.processing.temp_dir is not None:
            filled(self, "processing.temp_dir")
        filled(self, "processing.results_dir", "ytdlp.path")
        positive(self, "ytdlp.max_fps", "ytdlp.timeout_seconds")

    def fingerprint(self, template: str = "") -> str:
        """What a chunk's rows depend on besides the recording, the prompt's text included; part of every checkpoint's key."""
        cut = (self.ffmpeg.chunk_duration_secs, self.ffmpeg.frame_format, self.ffmpeg.frame_quality)
        parts = (cut, self.whisper, self.ollama.model, self.ollama.num_ctx, self.vision, template)
        return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


def _get(config: Any, key: str) -> Any:
    for name in key.split("."):
        config = getattr(config, name)
    return config


def filled(config: Any, *keys: str) -> None:
    for key in keys:
        if not _get(config, key):
            raise ConfigError(f"{key} must not be empty")


def positive(config: Any, *keys: str) -> None:
    for key in keys:
        if not _get(config, key) > 0:
            raise ConfigError(f"{key} must be greater than 0")


C = TypeVar("C")
_KINDS = {"str": str, "int": int, "float": (int, float), "bool": bool, "str | None": (str, type(None))}


def from_table(kind: type[C], table: dict[str, Any], where: str = "") -> C:
    """A config of ``kind`` from a TOML table: missing keys take defaults, unknown ones are ignored, wrong types raise."""
    if not isinstance(table, dict):
        raise ConfigError(f"{where.rstrip('.') or 'config'} must be a table")
    given: dict[str, Any] = {}
    for f in dataclasses.fields(kind):
        if f.name not in table:
            continue
        value = table[f.name]
        if f.type in _KINDS:
            right = isinstance(value, _KINDS[f.type]) and (f.type == "bool" or not isinstance(value, bool))
            if not right or (f.type == "int" and value < 0):
                raise ConfigError(f"{where}{f.name} has the wrong type: {value!r}")
            given[f.name] = float(value) if f.type == "float" else value
        else:
            given[f.name] = from_table(globals()[f.type], value, f"{where}{f.name}.")
    return kind(**given)


def merge_tables(base: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """``base`` with ``overrides``: tables are merged key by key, all else, lists included, is replaced whole."""
    out = dict(base)
    for key, value in overrides.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merge_tables(out[key], value) if both else value
    return out


def config_dir() -> Path:
    return Path.home() / HOME / "config"


def profiles_dir() -> Path:
    return config_dir() / "profiles"


def cache_dir() -> Path:
    return Path.home() / HOME / "cache"


def read_toml(path: Path) -> dict[str, Any]:
    """A TOML file as a table; a missing file is an empty one, a malformed one raises."""
    if not path.exists():
        return {}
    try:
        return tomllib.loads(path.read_text())
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"failed to parse {path}: {e}") from e


def load_config(kind: type[C], filename: str, directory: Path | None = None) -> C:
    return from_table(kind, read_toml((directory or config_dir()) / filename))


def load_profile(name: str, directory: Path | None = None) -> dict[str, Any]:
    """A profile's overrides; its name may hold letters, digits, dots, dashes and underscores only."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ConfigError(f"invalid profile name {name!r}")
    path = (directory or profiles_dir()) / f"{name}.toml"
    if not path.exists():
        raise ConfigError(f"profile not found: {name}")
    return read_toml(path)


def list_profiles(directory: Path | None = None) -> list[str]:
    where = directory or profiles_dir()
    return sorted(p.name[: -len(".toml")] for p in where.glob("*.toml")) if where.is_dir() else []


def resolve_config(base: ServerConfig, profile: str | None, directory: Path | None = None) -> ServerConfig:
    """``base`` with a profile's overrides, validated."""
    if profile is None:
        return base
    out = from_table(ServerConfig, merge_tables(dataclasses.asdict(base), load_profile(profile, directory)))
    out.validate()
    return out


def prompt_template(path: str | None, default: str) -> str:
    """The file's text if a path is given, which must then be readable, else the default."""
    if not path:
        return default
    try:
        return Path(path).read_text()
    except OSError as e:
        raise ConfigError(f"failed to read prompt template '{path}': {e}") from e


def with_server(config: ClientConfig, address: str | None) -> ClientConfig:
    """``config`` with the server given as host:port; if the port is none, the whole text is the host."""
    if not address:
        return config
    host, _, port = address.rpartition(":")
    if host and port.isdigit() and int(port) < 65536:
        server = ClientServer(host, int(port))
    else:
        server = ClientServer(address, config.server.port)
    return dataclasses.replace(config, server=server)
