"""Errors of the engine; each is shown with its kind's prefix."""

from __future__ import annotations


class EngineError(Exception):
    prefix = "server error: "

    def __str__(self) -> str:
        return self.prefix + super().__str__()


class ConfigError(EngineError):
    prefix = "config error: "


class MediaError(EngineError):
    prefix = "ffmpeg error: "


class SpeechError(EngineError):
    prefix = "whisper error: "


class VisionError(EngineError):
    prefix = "vision model error: "


class JsonError(EngineError):
    prefix = "json error: "


class ClientError(EngineError):
    prefix = "client error: "


class DownloadError(EngineError):
    prefix = "download error: "


class Cancelled(EngineError):
    prefix = "job cancelled"

    def __str__(self) -> str:
        return self.prefix


class ApiError(EngineError):
    """An answer to a caller: 400 bad request, 404 not found, 409 conflict, 500 internal."""

    prefix = ""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status
