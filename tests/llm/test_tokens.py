import os
import random

import numpy as np
import pytest

from segloom.llm import encoding, packing

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.TOKENIZER_DIR), reason="no tokenizer files")


@pytest.fixture(scope="module")
def enc():
    return encoding.Encoder()


def joined(enc, text):
    start, parts = 0, []
    for end in encoding.chunk_ends(text):
        parts.append(encoding.encode_chunk(enc, text[start:end]))
        start = end
    ids = np.concatenate(encoding.join_chunks(enc, parts)).tolist()
    assert encoding.joined_size(enc, [(h, None if b is None else len(b), t) for h, b, t in parts]) == len(ids)
    return ids


def test_tiny_chunks_join_exactly(enc, monkeypatch):
    for name, value in (("MIN_CHUNK", 1), ("MEAN_CHUNK", 4), ("MAX_CHUNK", 9)):
        monkeypatch.setattr(encoding, name, value)
    rnd = random.Random(5)
    signs = ["a", "b", "'", "s", "re", " ", "  ", "\n", "1", "2", ".", "!", "é", "字", "　", "'ll", "\t", "'r", "e", "🎬", "\x1c", "\x85", "\u200b", "\u2028", "\r\n"]
    for _ in range(8000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60)))
        assert joined(enc, text) == enc.bpe.encode_ordinary(text), text


def test_chunks_are_content_defined():
    rnd = random.Random(6)
    body = "".join(rnd.choice("abcdefghij klmno.") for _ in range(20_000))
    a, b = encoding.chunk_ends(body), encoding.chunk_ends("some new start " + body)
    shared = {e for e in a} & {e - 15 for e in b}
    assert len(shared) >= len(a) - 2 and a[-1] == len(body)
    assert encoding.chunk_ends("") == [] and encoding.chunk_ends("a") == [1]
    texts = ["".join(rnd.choice("abcde é字") for _ in range(rnd.choice([0, 1, 40, 63, 64, 65, 900, 40_000]))) for _ in range(40)]
    assert encoding.all_chunk_ends(texts) == [encoding.chunk_ends(t) for t in texts] and encoding.all_chunk_ends([]) == []
    assert max(np.diff([0, *encoding.chunk_ends("a" * 50_000)])) <= encoding.MAX_CHUNK


def test_documents(spark, enc):
    long = "The camera holds on a rivet. " * 4000
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, " \n"), (5, long), (6, long), (7, "<|endoftext|>"), (1, "Hello  world"), (8, "x" * 30_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, chunk string")
    want = {i: enc.bpe.encode_ordinary(t) if t else [] for i, t in rows}
    for parts in (1, 5):
        out = encoding.encode_documents(df.repartition(parts)).collect()
        assert {r.doc_id: r.ids for r in out} == want and len(out) == 8
        sizes = encoding.measure_documents(df.repartition(parts)).collect()
        assert sorted((r.doc_id, r.size) for r in sizes) == sorted((i, len(x)) for i, x in want.items() if x)
    assert encoding.encode_documents(df.limit(0)).count() == encoding.measure_documents(df.limit(0)).count() == 0


def test_shared_chunks_and_copies_in_many_tasks(spark, enc):
    rnd = random.Random(11)
    body = [" ".join(rnd.choice(["camera", "holds", "on", "it's", "a", "rivet", "1984", "\n\n"]) for _ in range(400)) for _ in range(6)]
    texts = ["".join(rnd.sample(body, 3)) for _ in range(60)] + [body[0]] * 300 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for parts in (2, 9):
        got = {r.doc_id: r.ids for r in encoding.encode_documents(df.repartition(parts)).collect()}
        assert got == {i: enc.bpe.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_ids_given_twice(spark, enc):
    df = spark.createDataFrame([(1, "one text"), (1, "another"), (1, "one text"), (None, "no id"), (None, "no id"), (2, "no id")], "doc_id bigint, text string")
    got = [(r.doc_id, enc.bpe.decode(r.ids)) for r in encoding.encode_documents(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "one text"), (1, "another"), (None, "no id"), (2, "no id")], key=repr)


def test_first_fit_decreasing_is_the_plain_one():
    rnd = random.Random(7)
    for _ in range(200):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if k is None:
                room.append(50)
                k = len(room) - 1
            room[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit_decreasing(sizes, 50) == want


def test_containers(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randint(0, 900)) for i in range(2000)] + [(9000, 5000), (9001, None), (None, 10), (9002, 2048), (1, 7), (1, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint")
    out = packing.pack_items(df, group_documents=500).collect()
    held, pieces = {}, {}
    for r in out:
        held[r.container] = held.get(r.container, 0) + r.piece_size
        pieces.setdefault(r.doc_id, []).append((r.piece_start, r.piece_size))
    assert max(held.values()) <= 2048
    total = sum(s or 0 for _, s in rows)
    assert sum(held.values()) == total and len(held) <= -(-total // 2048) + 8
    assert sorted(pieces[9000]) == [(0, 2048), (2048, 2048), (4096, 904)] and pieces[9002] == [(0, 2048)]
    assert 9001 not in pieces and packing.pack_items(df.limit(0)).count() == 0
    assert packing.fill(packing.pack_items(df)).first().fullest <= 2048


def test_sure_places_are_boundaries_after_any_character(enc):
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        text = "a" + chr(code)
        if encoding.SURE.search(text + " \n"):
            for after in (" b", "\n\nb"):
                at = encoding.sure_places(text + after + " c")
                if at is not None and at[0] == len(text):
                    assert enc.encode(text + after) == enc.encode(text) + enc.encode(after), hex(code)
