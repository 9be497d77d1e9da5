"""Offsets of a recording as ``HH:MM:SS.mmm`` strings and back."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``; halves round away from zero, negatives and NaN give zero, hours may exceed two digits.

    Null gives null; an infinite offset, which no recording has, gives null too.
    """
    clean = F.greatest(F.when(F.isnan(seconds), F.lit(0.0)).otherwise(seconds), F.lit(0.0))
    ms = F.when(seconds.isNotNull(), F.round(clean * 1000).try_cast("bigint"))
    return F.when(
        ms.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d.%03d",
            F.floor(ms / 3600000),
            F.floor((ms % 3600000) / 60000),
            F.floor((ms % 60000) / 1000),
            ms % 1000,
        ),
    )


def _number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


CANONICAL = r"^\d\d:\d\d:\d\d\.\d{3}$"


def _digits(c: Column) -> Column:
    """The nine digits of a canonical time code as one number."""
    return F.replace(F.replace(c, F.lit(":"), F.lit("")), F.lit("."), F.lit("")).try_cast("bigint")


def parse_timestamp(c: Column) -> Column:
    """Seconds of a strict ``H:M:S[.fraction]`` string, else null.

    Exactly three parts; the fraction is its digits over a power of ten, and what follows a second
    dot is ignored. Words such as ``inf`` and ``nan`` are not numbers here. As in :func:`parse_offset_ms`, only
    what is not in the canonical form goes through an interpreted lambda.
    """

    def slow(text: Column) -> Column:
        parts = F.split(text, ":")
        sec = F.split(F.get(parts, F.lit(2)), "[.]")
        fraction = F.get(sec, F.lit(1))
        value = F.when(F.size(sec) > 1, _number(fraction) / F.pow(F.lit(10.0), F.octet_length(fraction))).otherwise(F.lit(0.0))
        whole = _number(F.get(parts, F.lit(0))) * 3600 + _number(F.get(parts, F.lit(1))) * 60 + _number(F.get(sec, F.lit(0)))
        return F.when(F.size(parts) == 3, whole + value)

    d = _digits(c)
    whole = F.floor(d / 10_000_000) * 3600 + F.floor(d / 100_000) % 100 * 60 + F.floor(d / 1000) % 100
    fast = whole.cast("double") + (d % 1000) / F.lit(1000.0)
    return F.when(c.rlike(CANONICAL), fast).otherwise(F.get(F.transform(F.array(c), slow), F.lit(0)))


def parse_offset_ms(c: Column) -> Column:
    """Milliseconds from offset 0 for every notation seen in delivered rows, else null.

    Accepts ``H:M:S.f``, ``M:S.f``, ``S.f``, a comma for the dot, no fraction, a trailing ``s``,
    ``0h00m00.000s`` and white space around any of them. An offset beyond 64 bits gives null.

    The canonical 12-character form, nearly all rows, is read as one number. The rest goes through an interpreted
    lambda, which keeps the generated code of the common case small enough to be compiled.
    """
    digits = _digits(c)
    fast = F.floor(digits / 10_000_000) * 3_600_000 + F.floor(digits / 100_000) % 100 * 60_000 + digits % 100_000

    def slow(plain: Column) -> Column:
        parts = F.split(plain, ":")
        part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)).try_cast("double"), F.lit(0.0))
        ms = F.round((part(3) * 3600 + part(2) * 60 + part(1)) * 1000).try_cast("bigint")
        return F.when(plain.rlike(r"^(\d+:){0,2}\d+(\.\d*)?$") & ms.isNotNull(), ms)

    plain = F.regexp_replace(F.translate(F.trim(F.lower(c)), "hm,", "::."), r"\s+|s$", "")
    other = F.get(F.transform(F.array(plain), slow), F.lit(0))
    return F.when(c.rlike(CANONICAL), fast).otherwise(other)


def offset_ms(text: str | None) -> int | None:
    """:func:`parse_offset_ms` of one text, for use inside a partition."""
    if text is None:
        return None
    plain = re.sub(r"[ \t\n\x0b\f\r]+|s$", "", text.lower().strip(" ").translate({104: ":", 109: ":", 44: "."}))
    if not re.fullmatch(r"([0-9]+:){0,2}[0-9]+(\.[0-9]*)?", plain):
        return None
    h, m, s = ([0.0, 0.0] + [float(part) for part in plain.split(":")])[-3:]
    return math.floor((h * 3600 + m * 60 + s) * 1000 + 0.5)


def chunk_name(index: Column) -> Column:
    """Folder name of a chunk, at least three digits wide."""
    return F.format_string("chunk_%03d", index)
