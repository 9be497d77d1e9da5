"""Text expressions: Unicode trim, byte-bounded cuts, think tags, titles, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, one by one.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
THINK_END = "</think>"
HASH_LENGTH = 8


def utrim(c: Column) -> Column:
    """Strip every Unicode white-space character from both ends (``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """True if nothing but Unicode white space is left."""
    return F.octet_length(utrim(c)) == 0


def byte_prefix(c: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` bytes that ends on a character boundary."""
    raw = c.cast("binary")
    tries = [
        F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(n, max(n - 4, 0), -1)
    ]
    return F.when(c.isNotNull(), F.coalesce(*tries, F.lit("")))


def ellipsize_bytes(c: Column, limit: int, keep: int) -> Column:
    """``c``, or its first ``keep`` bytes and ``...`` if it is longer than ``limit`` bytes."""
    return F.when(F.octet_length(c) > limit, F.concat(byte_prefix(c, keep), F.lit("..."))).otherwise(c)


def strip_thinking(c: Column) -> Column:
    """What follows the first closing think tag, trimmed; text without one is only trimmed."""
    at = F.instr(c, THINK_END)
    return utrim(F.when(at > 0, F.substring(c, at + len(THINK_END), F.length(c))).otherwise(c))


def source_hash(c: Column) -> Column:
    """Cache key of a source: the first eight hex digits of its SHA-256."""
    return F.substring(F.sha2(c, 256), 1, HASH_LENGTH)


def is_hash(c: Column) -> Column:
    """True for exactly eight ASCII hex digits of either case."""
    return c.rlike(r"\A[0-9a-fA-F]{8}\z")


def title_of(c: Column) -> Column:
    """A source name without any trailing ``.mp4``."""
    return F.regexp_replace(c, r"(\.mp4)+$", "")


def is_mp4_path(c: Column) -> Column:
    """True if the last path component has a stem and the extension ``mp4``, case-sensitively."""
    return c.rlike(r"(?s)[^/]\.mp4\z")


def is_mp4_upload(c: Column) -> Column:
    """True if an uploaded file's name ends in ``.mp4`` (a bare ``.mp4`` passes here)."""
    return c.endswith(".mp4")


def file_stem(c: Column) -> Column:
    """Last path component without its last extension; a leading dot belongs to the stem."""
    name = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")


def parent_dir(c: Column) -> Column:
    """Everything up to and with the last slash, or the empty string."""
    return F.regexp_extract(c, r"(?s)\A(.*/)?[^/]*\z", 1)


def json_output_path(c: Column, output_dir: str | None = None) -> Column:
    """``{stem}.json`` in ``output_dir``, or beside the input."""
    name = F.concat(file_stem(c), F.lit(".json"))
    if output_dir is not None:
        return F.concat(F.lit(output_dir.rstrip("/") + "/"), name)
    return F.concat(parent_dir(c), name)


def formatted_output_path(c: Column, cache_marker: str) -> Column:
    """``formatted.md`` for an entry of the cache, else ``{stem}_formatted.md``; both beside the input."""
    name = F.when(F.instr(c, cache_marker) > 0, F.lit("formatted.md")).otherwise(
        F.concat(file_stem(c), F.lit("_formatted.md"))
    )
    return F.concat(parent_dir(c), name)


def source_name(given: Column, path: Column) -> Column:
    """A job's source name: the given one, else the file name, else the path."""
    return F.coalesce(given, F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def error_text(kind: Column, message: Column) -> Column:
    """An error as shown to users: its kind's fixed prefix and the message."""
    prefixes = {
        "ffmpeg": "ffmpeg error: ",
        "whisper": "whisper error: ",
        "vision": "vision model error: ",
        "config": "config error: ",
        "io": "io error: ",
        "json": "json error: ",
        "server": "server error: ",
        "client": "client error: ",
        "download": "download error: ",
    }
    out = F.when(kind == "cancelled", F.lit("job cancelled"))
    for name, prefix in prefixes.items():
        out = out.when(kind == name, F.concat(F.lit(prefix), message))
    return out


def header_context(c: Column) -> Column:
    """The part of a first section that later sections are given: all before the first scene heading.

    Without such a heading, the first 2,000 characters.
    """
    at = F.instr(c, "## Scene")
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(F.substring(c, 1, 2000))


def format_selector(resolution: Column, fps: Column, default_resolution: str = "1080", default_fps: int = 30) -> Column:
    """Download format selector; a null override falls back to the configured value."""
    r, f = F.coalesce(resolution, F.lit(default_resolution)), F.coalesce(fps.cast("int"), F.lit(default_fps))
    return F.format_string("bestvideo[height<=%s][fps<=%d]+bestaudio/best[height<=%s]", r, f, r)


def estimated_tokens(c: Column) -> Column:
    """Rough size of a text in model tokens: a quarter of its UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("bigint")
