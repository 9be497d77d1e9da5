"""Encoding of the whole corpus with a public byte-level BPE tokenizer, chunks shared between documents encoded once.

Texts are cut where a rolling hash of the last characters says so, so that equal stretches of different
documents give equal chunks. Each distinct chunk is encoded once. A cut may split what the tokenizer would
have kept together, so joins are repaired: the end of one chunk and the start of the next are encoded again, out to
the nearest places where any encoding of any surrounding text must have a boundary. The tokenizer's pattern
never puts white space behind another character into one piece and looks ahead by white space only, so such a
place is wherever a blank or line feed follows a character that is not white space; there both encodings agree.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.runtime import broadcast_if_small, cut

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the tokenizer's splitting pattern, as its publisher states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters the rolling hash sees; a power of two, so that it is built by doubling.
WINDOW = 32
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 64, 512, 4096
#: Marks of texts and chunks a task remembers before it forgets and may emit some again.
CACHE = 400_000
#: Chunks that several tasks met whose marks are broadcast; beyond it those joins are shuffled.
BROADCAST_CHUNKS = 500_000


class Encoder:
    """The tokenizer without special tokens."""

    def __init__(self, directory: str = TOKENIZER_DIR, name: str = TOKENIZER):
        import tiktoken

        with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Ids travel between stages as narrow as the vocabulary allows.
        self.narrow = np.uint16 if max(ranks.values()) < 1 << 16 else np.int32

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(directory: str, name: str) -> Encoder:
    """The worker's own encoder; vocabulary files are read where they lie and never shipped."""
    if (directory, name) not in _ENCODERS:
        _ENCODERS[directory, name] = Encoder(directory, name)
    return _ENCODERS[directory, name]


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes + np.uint32(0x9E3779B9)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def cut_marks(texts: list[str], block: int = 1 << 15) -> np.ndarray:
    """Places behind which a chunk may end, in the texts put one behind another: where the rolling hash falls below a level.

    Hashed in blocks small enough for a core's cache. The hash at a text's first WINDOW characters also sees the text
    before; no chunk ends there, since none is shorter than MIN_CHUNK.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    level = np.uint32((1 << 32) // MEAN_CHUNK)
    marks = [np.zeros(0, np.int64)]
    for at in range(0, len(codes), block):
        low = max(0, at - WINDOW)
        rolling, step, power = _mixed(codes[low : at + block]), 1, 0x01000193
        while step < WINDOW:  # the hash of 2 x step characters from two of step
            wider = rolling.copy()
            wider[step:] += rolling[:-step] * np.uint32(power)
            rolling, step, power = wider, 2 * step, power * power & 0xFFFFFFFF
        hit = np.flatnonzero(_mixed(rolling) < level) + low
        marks.append(hit[hit >= at])
    return np.concatenate(marks)


def ends_from(marks: list[int], n: int) -> list[int]:
    """Chunk ends of a text of ``n`` characters from its marks, within the bounds on a chunk's length."""
    out: list[int] = []
    start = 0
    for mark in marks:
        end = mark + 1
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            out.append(start)
        if end - start >= MIN_CHUNK and end < n:
            out.append(end)
            start = end
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        out.append(start)
    if n:
        out.append(n)
    return out


def chunk_ends(text: str) -> list[int]:
    """Content-defined chunk ends of one text."""
    return ends_from(cut_marks([text]).tolist(), len(text))


def all_chunk_ends(texts: list[str]) -> list[list[int]]:
    """Content-defined chunk ends of each text, hashed together."""
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    marks = cut_marks(texts)
    at = np.searchsorted(marks, begins)
    return [ends_from((marks[at[i] : at[i + 1]] - begins[i]).tolist(), len(t)) for i, t in enumerate(texts)]


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


CHUNK = pa.schema([("doc_id", pa.int64()), ("doc", pa.binary()), ("pos", pa.int32()), ("chunk", pa.binary()), ("place", pa.int64()), ("text", pa.string())])
CHUNK_DDL = "doc_id bigint, doc binary, pos int, chunk binary, place bigint, text string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with its text's mark; and once for every text that this task meets, the places of its chunks,
    numbered through, with the text of chunks that this task meets for the first time."""
    met: set[bytes] = set()
    place = TaskContext.get().partitionId() << 40

    def first(key: bytes) -> bool:
        if key in met:
            return False
        if len(met) > CACHE:
            met.clear()
        met.add(key)
        return True

    for batch in batches:
        out: list[tuple] = []
        new: list[tuple[bytes, str]] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            mark = _key(text)
            out.append((doc, mark, -1, None, None, None))
            if first(b"t" + mark):
                new.append((mark, text))
        for (mark, text), ends in zip(new, all_chunk_ends([t for _, t in new]), strict=True):
            start = 0
            for pos, end in enumerate(ends):
                part = text[start:end]
                key = _key(part)
                out.append((None, mark, pos, key, place, part if first(b"c" + key) else None))
                place += 1
                start = end
            if len(out) > 2000:
                yield _batch(out, CHUNK)
                out = []
        if out:
            yield _batch(out, CHUNK)


ENCODED = pa.schema([("doc", pa.binary()), ("pos", pa.int32()), ("chunk", pa.binary()), ("head", pa.string()), ("body", pa.binary()), ("size", pa.int32()), ("tail", pa.string())])
ENCODED_DDL = "doc binary, pos int, chunk binary, head string, body binary, size int, tail string"
SURE = re.compile(r"\S(?=[ \n])")


def sure_places(text: str) -> tuple[int, int] | None:
    """The first and the last place at which every encoding of every text around this one has a boundary.

    None if there are not two of them.
    """
    m = SURE.search(text)
    if m is None:
        return None
    first = last = m.end()
    at = len(text)
    while at > first:
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        if at > first and not text[at - 1].isspace():
            last = at
            break
    return (first, last) if last > first else None


def encode_chunk(enc: Encoder, text: str) -> tuple[str, np.ndarray | None, str | None]:
    """(text before the first sure place, ids up to the last, text after it); without two such places only the text."""
    places = sure_places(text)
    if places is None:
        return text, None, None
    first, last = places
    return text[:first], np.array(enc.encode(text[first:last]), enc.narrow), text[last:]


def _encode(directory: str, name: str, sizes: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, name)
        for batch in batches:
            out = []
            for doc, pos, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "pos", "chunk", "text")), strict=True):
                head, ids, tail = encode_chunk(enc, text)
                out.append((doc, pos, key, head, None if ids is None or sizes else ids.tobytes(), None if ids is None else len(ids), tail))
            if out:
                yield _batch(out, ENCODED)

    return encode


def join_chunks(enc: Encoder, chunks: Iterable[tuple[str, bytes | np.ndarray | None, str | None]]) -> list[np.ndarray]:
    """Ids of a text from its encoded chunks in order."""
    out: list[np.ndarray] = []
    pending = ""
    for head, body, tail in chunks:
        pending += head
        if body is not None:
            out.append(np.array(enc.encode(pending), enc.narrow))
            out.append(np.frombuffer(body, enc.narrow))
            pending = tail or ""
    out.append(np.array(enc.encode(pending), enc.narrow))
    return out


def joined_size(enc: Encoder, chunks: Iterable[tuple[str, int | None, str | None]]) -> int:
    """How many ids :func:`join_chunks` would give, from the chunks' sizes."""
    total, pending = 0, ""
    for head, size, tail in chunks:
        pending += head
        if size is not None:
            total += len(enc.encode(pending)) + size
            pending = tail or ""
    return total + len(enc.encode(pending))


def _join(directory: str, name: str, sizes: bool):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(directory, name)
        for batch in batches:
            lists = batch.column("parts")
            flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            pos, head, body, tail = (flat.field(c).to_pylist() for c in ("pos", "head", "size" if sizes else "body", "tail"))
            values = []
            for row in range(batch.num_rows):
                at = {pos[i]: i for i in range(ends[row], ends[row + 1])}  # a place may come from two tasks, alike
                chunks = ((head[at[p]], body[at[p]], tail[at[p]]) for p in sorted(at))
                values.append(joined_size(enc, chunks) if sizes else np.concatenate(join_chunks(enc, chunks)))
            if sizes:
                made = pa.array(values, pa.int64())
            else:
                offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
                ids = pa.array(np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32))
                made = pa.ListArray.from_arrays(pa.array(offsets), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), made], names=["doc", "doc_id", "value"])

    return join


def _valued(df: DataFrame, directory: str, name: str, sizes: bool) -> DataFrame:
    """doc_id and the ids, or their number, of every text that is not empty."""
    found = cut(df.where("text <> ''").select("doc_id", "text").mapInArrow(_chunks, CHUNK_DDL))
    texts = found.where("text is not null")
    # Chunks that several tasks met are encoded where the first place stands; texts themselves are never shuffled.
    several = texts.groupBy("chunk").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk", "first")
    again = cut(texts.select("chunk", "place").join(several, "chunk").where("place > first").select("place"))
    again = broadcast_if_small(again, BROADCAST_CHUNKS)
    once = texts.join(again, "place", "left_anti").select("doc", "pos", "chunk", "text")
    encoded = cut(once.mapInArrow(_encode(directory, name, sizes), ENCODED_DDL))
    # Every other place takes its chunk's ids by the chunk's mark.
    columns = ["doc", "pos", "chunk"]
    others = cut(found.where("pos >= 0 and text is null").select(columns).unionByName(texts.join(again, "place", "left_semi").select(columns)).distinct())
    shared = broadcast_if_small(others.select("chunk").distinct(), BROADCAST_CHUNKS)
    piece = ["head", "body", "size", "tail"]
    taken = others.join(encoded.join(shared, "chunk", "left_semi").select("chunk", *piece), "chunk").select("doc", "pos", *piece)
    pieces = encoded.select("doc", "pos", *piece).unionByName(taken)
    docs = found.where("pos = -1").select("doc_id", "doc")
    first = cut(docs.groupBy("doc").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    kind = "bigint" if sizes else "array<int>"

    def assembled(texts: DataFrame, pieces: DataFrame) -> DataFrame:
        parts = pieces.groupBy("doc").agg(F.collect_list(F.struct("pos", *piece)).alias("parts"))
        return texts.join(parts, "doc").select("doc", "doc_id", "parts").mapInArrow(_join(directory, name, sizes), f"doc binary, doc_id bigint, value {kind}")

    # A text is assembled for the first of its documents; copies, however many, take what is assembled once for all of them.
    copied = first.where("copies > 1").select("doc", "doc_id")
    marks = broadcast_if_small(copied.select("doc"), BROADCAST_CHUNKS)
    values = cut(assembled(copied, pieces.join(marks, "doc", "left_semi"))).withColumnRenamed("doc_id", "first")
    copies = docs.join(marks, "doc", "left_semi").distinct().join(values, "doc").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return assembled(first, pieces).select("doc_id", "value").unionByName(copies.select("doc_id", "value"))


def encode_documents(df: DataFrame, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """doc_id and ids of each document, without special tokens.

    Needs doc_id and text; other columns are ignored. Null and empty texts have the empty list, blank texts are
    encoded like any other, strings of special tokens are ordinary text, texts of any length are encoded whole.
    Exactly repeated rows give one row; one doc_id with different texts gives a row for each. An empty input gives none.

    Texts are written once, as the chunks that a task meets for the first time, and never shuffled; ids are shuffled once, to
    their text's other parts. A chunk or text that very many documents share meets only small rows on the other
    side of its join, which AQE splits.
    """
    empty = df.where("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids")).distinct()
    return _valued(df, directory, name, False).select("doc_id", F.col("value").alias("ids")).unionByName(empty)


def measure_documents(df: DataFrame, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """doc_id and size, the number of ids that :func:`encode_documents` gives, of every text that is not null or empty.

    Made like the ids, but only the chunks' sizes and their ends travel.
    """
    return _valued(df, directory, name, True).select("doc_id", F.col("value").alias("size"))
