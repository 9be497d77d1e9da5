"""Command line: process, doctor, cancel, list and format over a server; serve starts one."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from segloom import config as cfg
from segloom.errors import ClientError, EngineError
from segloom.formatting import ChatFormatter, format_timeline
from segloom.models import post_json
from segloom.server import Client
from segloom.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="segloom")
    commands = p.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process", help="process an mp4 file, a folder of them, or a URL")
    process.add_argument("path", nargs="?")
    process.add_argument("-u", "--url")
    process.add_argument("-o", "--output")
    process.add_argument("-s", "--server")
    process.add_argument("--force", action="store_true")
    process.add_argument("--max-resolution")
    process.add_argument("--max-fps", type=int)
    process.add_argument("--profile")
    serve = commands.add_parser("serve", help="take jobs over HTTP")
    serve.add_argument("--address")
    serve.add_argument("--port", type=int)
    commands.add_parser("doctor", help="check tools and configuration")
    commands.add_parser("cancel", help="cancel one job, or all").add_argument("target")
    commands.add_parser("list", help="list processed recordings")
    fmt = commands.add_parser("format", help="format a timeline as Markdown")
    fmt.add_argument("input")
    fmt.add_argument("-o", "--output")
    fmt.add_argument("--model")
    fmt.add_argument("-p", "--prompt")
    fmt.add_argument("--prompt-id")
    return p


def is_url(text: str | None) -> bool:
    return bool(text) and text.startswith(("http://", "https://"))


def format_output(path: str, cache: str) -> str:
    """``formatted.md`` inside the cache, else ``{stem}_formatted.md`` beside the input."""
    folder, name = os.path.split(path)
    inside = os.path.commonpath([os.path.abspath(path), os.path.abspath(cache)]) == os.path.abspath(cache)
    return os.path.join(folder, "formatted.md" if inside else f"{os.path.splitext(name)[0]}_formatted.md")


def run_format(args, client: cfg.ClientConfig, cache: Path, key: str, post=post_json) -> str:
    path = str(store.resolve_input(cache, args.input))
    timeline = store.read_timeline(path)
    system = cfg.prompt_template(args.prompt or (client.openai.format_prompt_path if os.path.exists(client.openai.format_prompt_path or "") else None), "Format the timeline as Markdown.")
    formatter = ChatFormatter(client.openai.endpoint, key, args.model or client.openai.model, client.openai.max_tokens, post)
    out = args.output or format_output(path, str(cache))
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(format_timeline(timeline, formatter, system, args.prompt_id, lambda s: print(s, file=sys.stderr)))
    return out


def listing(entries) -> list[str]:
    """Lines of the cache listing: hash, title, minutes, segments, date."""
    lines = [f"{'HASH':<10}{'TITLE':<50}{'MIN':>7}{'SEGMENTS':>10}  DATE"]
    for r in entries:
        title = r.title or ""
        if len(title.encode()) > 48:
            title = title.encode()[:45].decode(errors="ignore") + "..."
        minutes = f"{r.duration_seconds / 60:.1f}" if r.duration_seconds is not None else "-"
        lines.append(f"{r.hash:<10}{title:<50}{minutes:>7}{r.segment_count or 0:>10}  {(r.processed_at or '')[:10]}")
    return lines


def load_client() -> cfg.ClientConfig:
    """The client's configuration, or the defaults with a warning where its file is no good."""
    try:
        return cfg.load_config(cfg.ClientConfig, "client.toml")
    except EngineError as e:
        print(f"warning: {e}, using defaults", file=sys.stderr)
        return cfg.ClientConfig()


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("segloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def doctor(client: cfg.ClientConfig, server: Client, say) -> int:
    """Configuration file, resolved values, their validity, and the server's tools."""
    path = cfg.config_dir() / "client.toml"
    say(f"[ok] configuration file: {path}" if path.exists() else f"[--] no configuration file at {path}, using defaults")
    for name, value in (
        ("server.host", client.server.host),
        ("server.port", client.server.port),
        ("output.dir", client.output.dir or "(only the cache)"),
        ("polling.poll_interval_secs", client.polling.poll_interval_secs),
        ("polling.timeout_secs", client.polling.timeout_secs),
        ("server url", client.server.url),
    ):
        say(f"  {name:<28}= {value}")
    good = True
    try:
        client.validate()
        say("[ok] configuration is valid")
    except EngineError as e:
        good = False
        say(f"[!!] {e}")
    try:
        found = server.health()
    except EngineError as e:
        say(f"[!!] {e}")
        return 1
    say(f"[ok] server reachable at {client.server.url}")
    for name, value in found.items():
        if name == "status":
            continue
        if isinstance(value, dict) and "error" in value:
            say(f"[!!] {name}: {value['error']}")
        else:
            say(f"[ok] {name}: {', '.join(map(str, value.values())) if isinstance(value, dict) else value}")
    say("all tools answer" if found["status"] == "ok" else "degraded: some tools do not answer")
    return int(not good or found["status"] != "ok")


def serve(args, spark, ready: Callable | None = None) -> int:
    """Serves until it is interrupted; ``ready`` is told the server."""
    import logging

    from segloom.engine import Engine
    from segloom.server import serve as bound

    logging.basicConfig(level=logging.INFO, format="%(message)s")
    try:
        config = cfg.load_config(cfg.ServerConfig, "server.toml")
    except EngineError as e:
        print(f"warning: {e}, using defaults", file=sys.stderr)
        config = cfg.ServerConfig()
    config.validate()
    server = bound(Engine(spark, config), args.address, args.port)
    print(f"listening on {server.server_address[0]}:{server.server_address[1]}", flush=True)
    if ready is not None:
        ready(server)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
    return 0


def main(argv: list[str] | None = None, spark_of: Callable = session, say=print, ready: Callable | None = None) -> int:
    """Runs a command. ``spark_of`` gives a session for those that need one, ``ready`` is told a server that was started."""
    args = parser().parse_args(argv)
    cache = cfg.cache_dir()
    try:
        client = cfg.with_server(load_client(), getattr(args, "server", None))
        server = Client(client.server.url, client.polling.timeout_secs + 60)
        if args.command == "serve":
            return serve(args, spark_of(), ready)
        if args.command == "doctor":
            return doctor(client, Client(client.server.url, 5), say)
        client.validate()
        if args.command == "list":
            entries = store.cache_entries(spark_of(), cache)
            for line in listing(entries.toLocalIterator()):
                say(line)
        elif args.command == "format":
            say(run_format(args, client, cache, os.environ.get("OPENAI_API_KEY", "")))
        elif args.command == "cancel":
            if args.target == "all":
                say(f"cancelled {server.cancel_all()} jobs")
            else:
                server.cancel(args.target)
                say(f"cancelled job {args.target}")
        else:
            return run_process(args, client, server, cache, say)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def output_path(given: str | None, client: cfg.ClientConfig, name: str) -> Path | None:
    """Where a result is written besides the cache: a named JSON file, or ``{stem}.json`` in a folder; None if nowhere."""
    if given and given.endswith(".json"):
        return Path(given)
    folder = given or client.output.dir
    return Path(folder) / f"{Path(name).stem}.json" if folder else None


def process_one(args, client: cfg.ClientConfig, server: Client, cache: Path, say, path: str | None = None, url: str | None = None) -> Path:
    """The cached timeline of a recording or URL, made by the server if it is not there or forced."""
    source = url or os.path.realpath(path)
    hit = None if args.force else store.cache_lookup(cache, source)
    if hit is not None:
        say(f"cached: {hit}")
        timeline = store.read_timeline(hit)
    else:
        if url:
            job = server.submit_url(url, force=args.force, profile=args.profile, max_resolution=args.max_resolution, max_fps=args.max_fps)
        else:
            job = server.upload(path, args.force, args.profile)
        ended = server.wait(job["id"], client.polling.poll_interval_secs, client.polling.timeout_secs, say)
        if ended["status"] != "completed":
            raise ClientError(ended.get("error") or "failed")
        timeline = server.result(job["id"])
        hit = store.cache_store(cache, source, url, timeline)
        say(str(hit))
    out = output_path(args.output, client, timeline["source"])
    if out is not None:
        store.write_atomically(out, json.dumps(timeline, ensure_ascii=False))
        say(str(out))
    return hit


def run_process(args, client: cfg.ClientConfig, server: Client, cache: Path, say) -> int:
    url = args.url or (args.path if is_url(args.path) else None)
    if url is None and args.path is None:
        say("a path or a URL is needed")
        return 2
    if url is not None:
        process_one(args, client, server, cache, say, url=url)
        return 0
    if not os.path.isdir(args.path):
        if not os.path.exists(args.path):
            raise ClientError(f"{args.path} not found")
        if not args.path.endswith(".mp4"):
            raise ClientError("only mp4 files are supported")
        process_one(args, client, server, cache, say, path=args.path)
        return 0
    paths = sorted(e.path for e in os.scandir(args.path) if e.is_file() and e.name.endswith(".mp4") and e.name != ".mp4")
    if not paths:
        raise ClientError(f"no mp4 files found in {args.path}")
    failed = 0
    for path in paths:  # a failure does not stop the others
        try:
            process_one(args, client, server, cache, say, path=path)
        except EngineError as e:
            failed += 1
            say(f"{path}: {e}")
    say(f"{len(paths) - failed} of {len(paths)} processed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
