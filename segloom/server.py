"""The job surface over HTTP, and a client for it.

GET /health, POST /jobs, POST /jobs/upload, POST /jobs/url, GET /jobs/{id}, GET /jobs/{id}/result, DELETE /jobs/{id},
DELETE /jobs. Errors are JSON with the status of their kind.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from segloom.engine import Engine
from segloom.errors import ApiError, ClientError, EngineError

#: Optional fields of a request and what they are if they are not given.
DEFAULTS: dict[str, Any] = {"force": False, "profile": None, "max_resolution": None, "max_fps": None}


#: Most bytes of a form's field that is not the file.
FIELD_BYTES = 1 << 16
#: Most bytes of a request that is not an upload.
JSON_BYTES = 1 << 20
BLOCK = 1 << 16


def short(pieces: Iterator[bytes]) -> bytes:
    """All of a field that must not be long."""
    out = b""
    for piece in pieces:
        out += piece
        if len(out) > FIELD_BYTES:
            raise ApiError(400, "malformed form: a field is too long")
    return out


class Form:
    """A multipart form read from a stream block by block; what it holds of the stream is bounded."""

    def __init__(self, stream, size: int, content_type: str):
        found = re.search(r'boundary="?([^";]+)"?', content_type or "")
        if not found:
            raise ApiError(400, "not a multipart form")
        self.mark = b"\r\n--" + found[1].encode()
        self.stream, self.left, self.held = stream, size, b"\r\n"

    def _more(self) -> bool:
        block = self.stream.read(min(BLOCK, self.left)) if self.left else b""
        self.left -= len(block)
        self.held += block
        return bool(block)

    def _until(self, mark: bytes) -> Iterator[bytes]:
        """What comes before ``mark``, piece by piece; the mark itself is passed over."""
        while (at := self.held.find(mark)) < 0:
            keep = len(mark) - 1
            if len(self.held) > keep:
                yield self.held[:-keep]
                self.held = self.held[-keep:]
            if not self._more():
                raise ApiError(400, "malformed form")
        yield self.held[:at]
        self.held = self.held[at + len(mark) :]

    def fields(self) -> Iterator[tuple[str, str | None, Iterator[bytes]]]:
        """Name, file name and content of each field in order; a content must be read before the next field."""
        for _ in self._until(self.mark):
            pass
        while True:
            while len(self.held) < 2 and self._more():
                pass
            if not self.held.startswith(b"\r\n"):
                while self.left and self._more():
                    self.held = b""  # the rest after the closing mark
                return
            head = short(self._until(b"\r\n\r\n"))
            name = re.search(rb'[; ]name="([^"]*)"', head)
            file = re.search(rb'filename="([^"]*)"', head)
            yield (name[1].decode(errors="replace") if name else ""), (file[1].decode(errors="replace") if file else None), self._until(self.mark)


def handler(engine: Engine) -> type[BaseHTTPRequestHandler]:
    limit = engine.config.processing.max_upload_bytes

    class Handler(BaseHTTPRequestHandler):
        def _size(self, most: int) -> int:
            size = int(self.headers.get("Content-Length") or 0)
            if size > most:
                self.close_connection = True
                raise ApiError(400, "upload is too large")
            return size

        def _json(self) -> dict:
            try:
                value = json.loads(self.rfile.read(self._size(min(limit, JSON_BYTES))) or b"{}")
            except ValueError as e:
                raise ApiError(400, f"malformed request: {e}") from e
            if not isinstance(value, dict):
                raise ApiError(400, "malformed request: not an object")
            return DEFAULTS | value

        def _answer(self, status: int, value: Any) -> None:
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _route(self, routes: list[tuple[str, Callable[..., Any]]], status: int = 200) -> None:
            try:
                for pattern, act in routes:
                    if m := re.fullmatch(pattern, self.path.split("?")[0].rstrip("/") or "/"):
                        self._answer(status, act(*m.groups()))
                        return
                raise ApiError(404, "no such route")
            except ApiError as e:
                self._answer(e.status, {"error": str(e)})
            except EngineError as e:
                self._answer(500, {"error": str(e)})

        def do_GET(self) -> None:
            self._route([("/health", engine.health), ("/jobs/([^/]+)", engine.status), ("/jobs/([^/]+)/result", engine.result)])

        def do_DELETE(self) -> None:
            self._route([("/jobs", lambda: {"cancelled": engine.cancel_all()}), ("/jobs/([^/]+)", engine.cancel)])

        def do_POST(self) -> None:
            def create() -> dict:
                r = self._json()
                return engine.submit(r.get("source") or "", bool(r["force"]), r["profile"]).response()

            def create_url() -> dict:
                r = self._json()
                return engine.submit_url(r.get("url") or "", bool(r["force"]), r["profile"], r["max_resolution"], r["max_fps"]).response()

            def upload() -> dict:
                form = Form(self.rfile, self._size(limit), self.headers.get("Content-Type") or "")
                self.close_connection = True  # a form given up half way leaves bytes in the stream
                text: dict[str, str] = {}
                name, path = None, None
                try:
                    for field, file, content in form.fields():
                        if field == "file" and file and path is None:
                            name, path = engine.upload_name(file), engine.upload_path()
                            with open(path, "wb") as out:
                                for piece in content:
                                    out.write(piece)
                        else:
                            text[field] = short(content).decode(errors="replace")
                    if path is None:
                        raise ApiError(400, "missing file field")
                    return engine.upload(name, path, text.get("force") == "true", text.get("profile")).response()
                except BaseException:
                    if path is not None:  # nobody will come for it
                        shutil.rmtree(path.parent, ignore_errors=True)
                    raise

            self._route([("/jobs", create), ("/jobs/url", create_url), ("/jobs/upload", upload)], status=201)

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def serve(engine: Engine, address: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server bound to the configured address; the caller runs ``serve_forever``."""
    listen = engine.config.server
    return ThreadingHTTPServer((address or listen.listen_address, listen.listen_port if port is None else port), handler(engine))


class Client:
    """Calls of the job surface."""

    def __init__(self, url: str, timeout: float = 600):
        self.url, self.timeout = url.rstrip("/"), timeout

    def _call(self, method: str, path: str, body: bytes | Iterator[bytes] | None = None, kind: str = "application/json", size: int | None = None) -> dict:
        headers = {"Content-Type": kind} | ({"Content-Length": str(size)} if size is not None else {})
        request = urllib.request.Request(self.url + path, body, headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")
            try:
                text = json.loads(text)["error"]
            except (ValueError, KeyError, TypeError):
                pass
            raise ApiError(e.code, text) from e
        except (urllib.error.URLError, OSError) as e:
            raise ClientError(f"cannot reach {self.url}: {e}") from e

    def health(self) -> dict:
        return self._call("GET", "/health")

    def submit(self, source: str, **options: Any) -> dict:
        return self._call("POST", "/jobs", json.dumps({"source": source} | options).encode())

    def submit_url(self, url: str, **options: Any) -> dict:
        given = {k: v for k, v in options.items() if v is not None}
        return self._call("POST", "/jobs/url", json.dumps({"url": url} | given).encode())

    def upload(self, path: str, force: bool = False, profile: str | None = None) -> dict:
        """Sends a file; the options go before it, so that a server reading in order meets them."""
        mark = uuid.uuid4().hex
        fields = {"force": "true"} if force else {}
        fields |= {"profile": profile} if profile else {}
        parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{os.path.basename(path)}"\r\nContent-Type: video/mp4\r\n\r\n'
        before, after = b"".join([*parts, head.encode()]), f"\r\n--{mark}--\r\n".encode()

        def body() -> Iterator[bytes]:
            yield before
            with open(path, "rb") as f:
                while block := f.read(BLOCK):
                    yield block
            yield after

        size = len(before) + os.path.getsize(path) + len(after)
        return self._call("POST", "/jobs/upload", body(), f"multipart/form-data; boundary={mark}", size)

    def status(self, job: str) -> dict:
        return self._call("GET", f"/jobs/{job}")

    def result(self, job: str) -> dict:
        return self._call("GET", f"/jobs/{job}/result")

    def cancel(self, job: str) -> dict:
        return self._call("DELETE", f"/jobs/{job}")

    def cancel_all(self) -> int:
        return self._call("DELETE", "/jobs")["cancelled"]

    def wait(self, job: str, interval: float = 3, timeout: float = 1800, say: Callable[[str], None] = lambda s: None) -> dict:
        """Waits, then asks, until the job has ended; tells each change of status."""
        began, last = time.monotonic(), None
        while True:
            time.sleep(interval)
            if time.monotonic() - began > timeout:
                raise ClientError(f"timed out after {timeout} s")
            found = self.status(job)
            if found["status"] != last:
                last = found["status"]
                say(last)
            if last in ("completed", "failed"):
                return found
