"""Oversized items cut into pieces at natural boundaries with a given overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from segloom.functions.timecode import offset_ms

TIMELINE_LIMIT = 25_000
CONTENT_LIMIT = 1_200
OVERLAP = 120
PARAGRAPH, SENTENCE, WORD, NONE = 3, 2, 1, 0
NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", NONE: "none"}
BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
SPACE = re.compile(r"\s+")


class RangeMax:
    """Sparse table over boundary strengths: the strongest cut of any window, ties to the right.

    Each entry holds strength and position in one integer, so one maximum answers both. Windows are never
    longer than the size limit, so log2(limit) levels suffice.
    """

    def __init__(self, strengths: np.ndarray, longest: int):
        base = strengths.astype(np.int64) * (len(strengths) + 1) + np.arange(len(strengths))
        self.width = len(strengths) + 1
        self.levels = [base]
        step = 1
        while 2 * step <= min(longest, len(base)):
            previous = self.levels[-1]
            self.levels.append(np.maximum(previous[:-step], previous[step:]))
            step *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int]:
        """(position, strength) of the strongest cut in low..high, both inside."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        best = int(max(level[low], level[high - (1 << k) + 1]))
        return best % self.width, best // self.width

    def strengths(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Greatest strength in each window low..high; -1 for an empty window."""
        out = np.full(len(low), -1, np.int64)
        length = np.maximum(high - low + 1, 0)
        for k, level in enumerate(self.levels):
            at = np.flatnonzero((length >= 1 << k) & (length < 2 << k))
            out[at] = np.maximum(level[low[at]], level[high[at] - (1 << k) + 1]) // self.width
        return out


def cut_points(strengths: np.ndarray, costs: np.ndarray, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int, int]]:
    """Pieces (start, end, strength of the cut at end) of a sequence of units with the given costs.

    ``strengths[p]`` rates a cut before unit p. The end of each piece is the strongest cut in the window that
    keeps it within ``limit`` and, if possible, above ``least`` of it; ties go right. The next piece starts ``overlap``
    units before the end. A single unit above the limit is a piece of its own; an overlap that would leave no
    room for a further unit is left out.
    """
    n = len(costs)
    total = np.concatenate(([0], np.cumsum(costs)))
    table = RangeMax(strengths, n)
    out: list[tuple[int, int, int]] = []
    start = end = 0
    while True:
        last = int(np.searchsorted(total, total[start] + limit, side="right")) - 1
        if last <= end and start < end:  # the overlap leaves no room
            start = end
            continue
        if last >= n:
            out.append((start, n, PARAGRAPH))
            return out
        low = max(end + 1, start + 1)
        last = max(last, low)
        low = max(low, min(last, int(np.searchsorted(total, total[start] + limit * least))))
        at, strength = table.strongest(low, last)
        out.append((start, at, strength))
        end, start = at, max(at - overlap, start + 1 if at - overlap > start else at)


def spaces(text: str) -> np.ndarray:
    """Start and end of each stretch of white space."""
    return np.array([m.span() for m in SPACE.finditer(text)], np.int64).reshape(-1, 2)


def text_strengths(text: str, found: np.ndarray | None = None) -> np.ndarray:
    """Strength of a cut before each code point, and before the end of the text."""
    found = spaces(text) if found is None else found
    s = np.zeros(len(text) + 1, np.int8)
    s[found[:, 1]] = WORD
    s[[m.end() for m in SENTENCE_END.finditer(text)]] = SENTENCE
    s[[m.end() for m in BLANK_LINE.finditer(text)]] = PARAGRAPH
    return s


def blanks(text: str, strengths: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and strongest cut of each stretch of white space that parts two pieces of text."""
    found = found[(found[:, 0] > 0) & (found[:, 1] < len(text))]
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    # A blank line may end before the stretch does; the strongest cut inside the stretch counts.
    best = np.maximum.reduceat(strengths, (found + 1).ravel())[::2]
    return found[:, 0], found[:, 1], best.astype(np.int64)


def coarsest_boundary(text: str, limit: int, strengths: np.ndarray | None = None, found: np.ndarray | None = None, block: int = 1 << 15) -> int:
    """The strongest class of which every gap between cuts of that class or stronger is at most ``limit`` code points.

    Asked of the range-maximum table: from each cut of a class, or the text's begin, is there a cut as strong within
    the limit, or else the text's end? White space around a unit does not count. The table is built over
    blocks of cuts, so it stays small for a text of any length.
    """
    found = spaces(text) if found is None else found
    strengths = text_strengths(text, found) if strengths is None else strengths
    start, end, strength = blanks(text, strengths, found)
    low, high = len(text) - len(text.lstrip()), len(text.rstrip())
    begins = np.concatenate(([low], end))
    rated = np.concatenate(([PARAGRAPH], strength))
    reach = np.full(len(begins), -1, np.int64)  # the strongest cut that ends a unit begun here within the limit
    for at in range(0, len(begins), block):
        some = np.arange(at, min(at + block, len(begins)))
        last = np.searchsorted(start, begins[some] + limit, side="right") - 1
        if last.max() >= some[0]:
            table = RangeMax(strength[some[0] : last.max() + 1], int((last - some).max()) + 1)
            reach[some] = table.strengths(some - some[0], last - some[0])
    reach[high - begins <= limit] = PARAGRAPH
    for kind in (PARAGRAPH, SENTENCE, WORD):
        if (reach[rated >= kind] >= kind).all():
            return kind
    return NONE


def split_text(text: str, limit: int = CONTENT_LIMIT, overlap: int = OVERLAP, strengths: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Pieces (start, end, strength) of a text; consecutive pieces share exactly ``overlap`` code points.

    Long texts are cut in blocks of many limits, so the table stays small for a text of any length.
    """
    if len(text) <= limit:
        return [(0, len(text), PARAGRAPH)]
    strengths = text_strengths(text) if strengths is None else strengths
    out: list[tuple[int, int, int]] = []
    block, at = 64 * limit, 0
    while True:
        whole = at + block >= len(text)
        part = strengths[at : at + block + 1]
        pieces = cut_points(part, np.ones(len(part) - 1, np.int64), limit, overlap)
        if whole:
            return out + [(at + a, at + b, s) for a, b, s in pieces]
        pieces = pieces[:-2]  # the last cuts saw the block's end instead of the text's
        out += [(at + a, at + b, s) for a, b, s in pieces]
        at = out[-1][1] - overlap


PIECE = pa.schema(
    [
        ("timeline_id", pa.int64()),
        ("seg_pos", pa.int32()),
        ("boundary", pa.string()),
        ("piece", pa.int32()),
        ("piece_start", pa.int64()),
        ("piece_end", pa.int64()),
        ("cut", pa.string()),
        ("text", pa.string()),
    ]
)
PIECE_DDL = "timeline_id bigint, seg_pos int, boundary string, piece int, piece_start bigint, piece_end bigint, cut string, text string"


def segment_strengths(segments: list[dict]) -> np.ndarray:
    """Cuts between segments: strongest where the one before has ended when the next begins, then where the type changes."""
    s = np.full(len(segments) + 1, WORD, np.int8)
    for i in range(1, len(segments)):
        a, b = segments[i - 1] or {}, segments[i] or {}
        until, begin = offset_ms(a.get("end")), offset_ms(b.get("start"))
        if until is not None and begin is not None and begin > until:
            s[i] = PARAGRAPH
        elif a.get("type") != b.get("type"):
            s[i] = SENTENCE
    return s


def _split(timeline_limit: int, content_limit: int, overlap: int, segment_overlap: int, cuts: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, segments in zip(batch.column("timeline_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
                out: list[tuple] = []
                segments = segments or []
                sizes = [len((s or {}).get("content") or "") for s in segments]
                if sum(sizes) > timeline_limit:
                    pieces = cut_points(segment_strengths(segments), np.array(sizes, np.int64), timeline_limit, segment_overlap) if cuts else [(None,) * 3]
                    out += [(tid, -1, "segment", k, a, b, "segment" if cuts else None, None) for k, (a, b, _) in enumerate(pieces)]
                for pos, s in enumerate(segments):
                    if sizes[pos] > content_limit:
                        text = s["content"]
                        found = spaces(text)
                        strengths = text_strengths(text, found)
                        name = NAMES[coarsest_boundary(text, content_limit, strengths, found)]
                        if not cuts:
                            out.append((tid, pos, name, 0, None, None, None, None))
                            continue
                        for k, (a, b, strength) in enumerate(split_text(text, content_limit, overlap, strengths)):
                            out.append((tid, pos, name, k, a, b, NAMES[strength], text[a:b]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECE.types, strict=True)], schema=PIECE)

    return split


def split_timelines(
    df: DataFrame,
    timeline_limit: int = TIMELINE_LIMIT,
    content_limit: int = CONTENT_LIMIT,
    overlap: int = OVERLAP,
    segment_overlap: int = 1,
    cuts: bool = True,
) -> DataFrame:
    """Pieces of each oversized timeline (seg_pos -1, counted in segments) and content (in code points).

    Needs timeline_id and segments; other columns are ignored. Items within their limit, null and empty
    arrays and null contents give no row; null contents count as empty; repeated rows give repeated
    pieces. Without ``cuts`` each item has one row with its boundary and no pieces are made. A content longer than the timeline's limit is a piece of its own there and is cut as a content. Each
    timeline is cut by itself, so the operator needs no shuffle.
    """
    return df.select("timeline_id", "segments").mapInArrow(_split(timeline_limit, content_limit, overlap, segment_overlap, cuts), PIECE_DDL)
