"""Whole results of the problems' queries on the smallest tables, against plain programs over the same rows."""

import itertools
import math
import os

import pyarrow.parquet as pq
import pytest

from segloom.functions.timecode import offset_ms
from segloom.llm import encoding, lookalike, registry, splitting, turns

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def rows_of(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def usable():
    """Each usable segment once, with plain type and offsets."""
    out = {}
    for r in table("segments"):
        kind = (r["segment_type"] or "").strip(" ").lower()
        start, end = offset_ms(r["start_time"]), offset_ms(r["end_time"])
        if kind in ("speech", "visual", "sound") and start is not None and end is not None and end >= start:
            out[r["seg_id"]] = {**r, "kind": kind, "start": start, "end": end}
    return sorted(out.values(), key=lambda r: (r["job_id"], r["start"], r["chunk_index"], r["ord"], r["seg_id"]))


def spoken_silences(speech):
    out = []
    for _, rows in itertools.groupby(speech, key=lambda r: r["job_id"]):
        reach = None
        for r in rows:
            if reach is not None and r["start"] > reach:
                out.append(r["start"] - reach)
            reach = r["end"] if reach is None else max(reach, r["end"])
    return sorted(out)


def test_turns_with_text(spark):
    series = {j["id"]: j["series_id"] for j in table("jobs") if j["profile"] == "interview"}
    people = {}
    for s in table("speakers"):
        people.setdefault(s["series_id"], []).append((s["speaker_id"], s["display_name"], s["role"], s["seat"]))
    rosters = {k: turns.Roster(v) for k, v in people.items()}
    speech = [r for r in usable() if r["kind"] == "speech" and r["content"] is not None and r["job_id"] in series]
    silences = spoken_silences(speech)
    calibrated = turns.calibrated_pause(registry._speech(spark, DATA))
    assert calibrated == silences[math.ceil(0.99 * len(silences)) - 1]
    want = []
    for job, rows in itertools.groupby(speech, key=lambda r: r["job_id"]):
        turn = None  # speaker, first, last, start, end, texts, the caption before
        for r in rows:
            for who, words in turns.parts(r["content"], rosters.get(series[job])):
                who = who if who is not None else turn and turn[0]
                said = turns.clean_text(words)
                if turn and turn[0] == who and r["start"] - turn[4] <= calibrated:
                    turn[2], turn[4] = r["seg_id"], max(turn[4], r["end"])
                    if said:
                        turn[5].append(turns.without_overlap(turn[6], said))
                        turn[6] = turns.bare_words(said)
                    continue
                if turn and turn[0] is not None:
                    want.append((job, *turn[:5], " ".join(t for t in turn[5] if t)))
                turn = [who, r["seg_id"], r["seg_id"], r["start"], r["end"], [said], turns.bare_words(said)]
        if turn and turn[0] is not None:
            want.append((job, *turn[:5], " ".join(t for t in turn[5] if t)))
    got = [(r.job_id, r.speaker_id, r.first_seg_id, r.last_seg_id, r.start_ms, r.end_ms, r.text) for r in rows_of(spark, "p1_turns")]
    assert len(got) > 50 and sorted(got) == sorted(want)


def test_pieces(spark):
    timelines = {t["timeline_id"]: t["segments"] or [] for t in table("timelines")}
    found = {}
    for r in rows_of(spark, "p2_pieces"):
        found.setdefault((r.timeline_id, r.seg_pos), []).append(r)
    size = lambda s: len((s or {}).get("content") or "")
    want = {(t, -1) for t, ss in timelines.items() if sum(map(size, ss)) > 25_000} | {(t, k) for t, ss in timelines.items() for k, s in enumerate(ss) if size(s) > 1200}
    assert set(found) == want
    for (timeline, at), pieces in found.items():
        pieces.sort(key=lambda r: r.piece)
        ends = [(r.piece_start, r.piece_end) for r in pieces]
        if at == -1:
            sizes = [size(s) for s in timelines[timeline]]
            assert all(sum(sizes[a:b]) <= 25_000 or b == a + 1 for a, b in ends)
            assert ends[0][0] == 0 and ends[-1][1] == len(sizes) and all(c in (b - 1, b) and d > b for (_, b), (c, d) in itertools.pairwise(ends))
            continue
        text = timelines[timeline][at]["content"]
        strengths = splitting.text_strengths(text)
        assert ends[0][0] == 0 and ends[-1][1] == len(text) and all(text[a:b] == r.text and b - a <= 1200 for (a, b), r in zip(ends, pieces, strict=True))
        for (a, b), (c, _) in itertools.pairwise(ends):
            assert c == b - 120
            low = max(a + 600, a + 121 if a else 0)  # the window of the cut, behind what the piece before holds
            best = max((int(strengths[p]), p) for p in range(low, a + 1201))
            assert (int(strengths[b]), b) == best and pieces[0].boundary in splitting.NAMES.values()


def test_truncation_rates(spark):
    bad = {r.seg_id for r in rows_of(spark, "p5_found")}
    want = {}
    for seg, producer in {(r["seg_id"], r["producer"]) for r in table("segments") if r["content"] is not None and r["content"].strip()}:
        n, k = want.get(producer, (0, 0))
        want[producer] = (n + 1, k + (seg in bad))
    got = {r.producer: (r.contents, r.truncated, r.rate) for r in rows_of(spark, "p5_rates")}
    assert got == {p: (n, k, k / n) for p, (n, k) in want.items()} and bad
    reasons = rows_of(spark, "p5_reasons")
    assert sum(r.contents for r in reasons) == len(bad) and all(r.verdict == "cut" for r in reasons if r.reason == "word")


@pytest.mark.skipif(not os.path.exists(encoding.TOKENIZER_DIR), reason="no tokenizer files")
def test_containers_hold_every_text(spark):
    enc = encoding.Encoder()
    sizes = {r["doc_id"]: len(enc.encode(r["text"])) for r in table("documents") if r["text"]}
    placed, held = {}, {}
    for r in rows_of(spark, "p8_bins"):
        placed.setdefault(r.doc_id, []).append((r.piece_start, r.piece_size))
        held[r.container] = held.get(r.container, 0) + r.piece_size
    assert set(placed) == set(sizes) and max(held.values()) <= 2048
    for doc, pieces in placed.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(0, sizes[doc], 2048)) and sum(p[1] for p in pieces) == sizes[doc]
    assert len(held) <= -(-sum(sizes.values()) // 2048) * 1.02 + 1
    (fill,) = rows_of(spark, "p8_fill")
    assert (fill.containers, fill.held, fill.fullest) == (len(held), sum(sizes.values()), max(held.values()))


def plain_form(text, single):
    """The common form by whole-text normalisation, where no picture is involved."""
    plain = lookalike.unicodedata.normalize("NFD", lookalike._UNSEEN.sub("", text))
    return lookalike.unicodedata.normalize("NFC", "".join(single.get(c, c) for c in plain))


def test_common_forms_and_classes(spark):
    single, forms, texts = lookalike.rules(), {}, {r["doc_id"]: r["text"] for r in table("documents")}
    for r in rows_of(spark, "p9_texts"):
        forms[r.doc_id] = r.normal_text
        if texts[r.doc_id] is None:
            assert r.normal_text is None
        elif not lookalike._PICTURE.search(texts[r.doc_id]) and "ı" not in texts[r.doc_id]:
            assert r.normal_text == plain_form(texts[r.doc_id], single), ascii(texts[r.doc_id])[:300]
    known = [d for d in texts if texts[d] and forms[d]]
    want = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if forms[a] == forms[b] and texts[a] != texts[b]}
    assert {tuple(r) for r in rows_of(spark, "p9_found")} == want
    classes = {r.doc_id: r for r in rows_of(spark, "p9_classes")}
    assert set(classes) == {d for pair in want for d in pair}
    for d, r in classes.items():
        alike = [x for x in known if forms[x] == forms[d]]
        assert (r.class_id, r.same_as, r.documents) == (min(alike), min(x for x in alike if texts[x] == texts[d]), len(alike))
        assert r.spellings == len({texts[x] for x in alike})
