import random

from segloom.llm.turns import Roster, bare_words, clean_text, overlap, parts, speaker_turns, without_overlap

PEOPLE = [(1, "Anna Bérgman", "Host", 1), (2, "Otto Klein", "Guest", 2), (3, "Mira Stein", "Engineer", 3)]
SPEAKERS = [(a, 9, n, r, s) for a, n, r, s in PEOPLE]
SCHEMA = "job_id string, start_ms bigint, end_ms bigint, chunk_index int, ord int, seg_id bigint, content string, series_id int"
ROSTER = Roster(PEOPLE)


def who(text):
    return [p for p, _ in parts(text, ROSTER)]


def test_labels():
    for label in ("Anna:", "ANNA BERGMAN :", "anna bergman (off camera):", "[Bérgman, Anna]", "(A.B.)", "<v A. Bergman>", "**Host:**", ">> Dr. Bérgman:", "- Anana:",
                  "[00:00:35] Anna:", "00:01:12.5 | SPEAKER_01:", "spk1:", "speaker 1：", "Anna -", "(0:07) Bergmn:"):
        assert who(f"{label} Um, that was it.") == [1], label
    for text in ("One thing: it works.", "In short: yes.", "It works - mostly.", "Nobody: none", "Well, the [applause] end."):
        assert who(text) == [None], text


def test_labels_inside_and_nothing_spoken():
    assert who("Anna: It was so. Otto: Er, no. [Engineer] Maybe.\nHost : Yes.") == [1, 2, 3, 1]
    assert who("It was so. <v Otto Klein>No.") == [None, 2]
    for text in ("Anna: uhh,", "[laughs]", "Otto - [MUSIC]", "00:01:02", "♪ theme music ♪", "Um. Er...", "", "   "):
        assert who(text) == [], text
    assert who("Anna: Yes. Otto: hmm") == [1]


def test_ambiguous_names_name_nobody():
    assert Roster([(1, "Ab Cd", None, None), (2, "Ab Ef", None, None)]).who("Ab") is None
    assert Roster([]).who("x") is None


def test_text_is_cleaned():
    assert clean_text("Um, so [laughs] it er was, uh... good (coughs).") == "so it was, good."
    assert overlap("a b c d".split(), "c d e".split()) == 2
    assert without_overlap(bare_words("we went to the old mill"), "To the old mill, and back") == "and back"
    assert without_overlap(bare_words("we went"), "to the mill") == "to the mill"
    assert without_overlap(bare_words("we went"), "went away") == "went away"
    long = "one two three four " * 100
    assert without_overlap(bare_words(long + "start"), long + "start and end") == "and end"


def test_long_labels():
    long_role = Roster([(1, "Anna Berg", "Second deputy keeper of the old harbour records", 1), (2, "Otto Klein", None, 2)])
    of = lambda t: [p for p, _ in parts(t, long_role)]
    assert of("Second deputy keeper of the old harbour records: so it was.") == [1]
    assert of("Dr. Second Deputy Keeper of the Old Harbour Records (from the studio beside the harbour, where it was loud that evening and long after): yes.") == [1]
    assert of(f"Otto ({'very ' * 40}far away): yes. [Anna Berg{' ' * 90}] no.") == [2, 1]
    assert of("Otto and all of his many other friends from the old harbour said this: yes.") == [None]


def captioned(lines, every=10):
    return [("j", every * i, every * i + 9, 0, i, i, ("Anna: " if i == 0 else "") + t, 9) for i, t in enumerate(lines)]


ROLLING = {
    "growing": (["we start the", "we start the motor now", "We start the motor now, and wait"], "we start the motor now and wait"),
    "repeated": (["the mill is old"] * 3 + ["the mill is old and dry"], "the mill is old and dry"),
    "two words": (["we went to the old mill", "old mill and then", "and then we came back"], "we went to the old mill and then we came back"),
    "none": (["we went", "to the mill"], "we went to the mill"),
}


def rolled(words, width, step):
    """Captions of ``width`` words that move on by ``step``, as a rolling display shows them."""
    return [" ".join(words[max(0, i - width) : i]) for i in range(step, len(words) + 1, step)]


def test_rolling_captions(spark, sliced):
    speakers = spark.createDataFrame(SPEAKERS, "speaker_id int, series_id int, display_name string, role string, seat int")
    text_of = lambda rows: [r.text for r in speaker_turns(spark.createDataFrame(rows, SCHEMA), speakers).collect()]
    for name, (lines, want) in ROLLING.items():
        assert text_of(captioned(lines)) == [want], name
    words = [f"w{i}" for i in range(300)]
    rows = captioned(rolled(words, 8, 3)) + [("k", *r[1:6], r[6].replace("w", "v"), 9) for r in captioned([" ".join(words[:5])] + rolled(words, 8, 1)[5:])]
    want = {" ".join(words), " ".join(words).replace("w", "v")}
    for n, size in ((1, 1000), (9, 20), (6, 7)):
        with sliced(n, size):
            assert set(text_of(rows)) == want, (n, size)


def brute(rows):
    out, seen = set(), set()
    jobs = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4], r[5])):
        if r[5] not in seen:
            seen.add(r[5])
            jobs.setdefault(r[0], []).append(r)
    for job, rs in jobs.items():
        turn = None
        for r in rs:
            for p, _ in parts(r[6] or "", ROSTER):
                p = p or (turn[0] if turn else None)
                if p is None:
                    continue
                if turn and turn[0] == p:
                    turn[2] = r[5]
                else:
                    if turn:
                        out.add((job, *turn))
                    turn = [p, r[5], r[5]]
        if turn:
            out.add((job, *turn))
    return out


def found(df):
    return {(r.job_id, r.speaker_id, r.first_seg_id, r.last_seg_id) for r in df.collect()}


def test_turns_across_slices(spark, sliced):
    rnd = random.Random(3)
    texts = ["Anna: Hello there.", "Otto: No.", "going on", "um", "[laughs]", None, "yes. Mira: and more", "Otto: er", "more words. Anna: well. Otto: so"]
    speakers = spark.createDataFrame(SPEAKERS, "speaker_id int, series_id int, display_name string, role string, seat int")
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(rnd.choice(["hot"] * 8 + ["b", "c"]), rnd.randint(0, 50), 60, rnd.randint(0, 1), rnd.randint(0, 2), i, rnd.choice(texts[: rnd.choice([3, 9])] if seed else ["going on"] * 30 + texts), 9) for i in range(700)]
        rows += rows[::9]
        with sliced(9):
            assert found(speaker_turns(spark.createDataFrame(rows, SCHEMA), speakers)) == brute(rows)


def test_pauses_empty_and_unknown_series(spark):
    speakers = spark.createDataFrame(SPEAKERS, "speaker_id int, series_id int, display_name string, role string, seat int")
    rows = [("j", 0, 10, 0, 0, 1, "Anna: one", 9), ("j", 20, 30, 0, 1, 2, "two", 9), ("j", 5000, 5001, 0, 2, 3, "three", 9), ("k", 0, 1, 0, 0, 4, "Anna: lost", 8), ("l", 0, 1, 0, 0, 5, "lost", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = speaker_turns(df, speakers, max_pause_ms=1000)
    assert found(turns) == {("j", 1, 1, 2), ("j", 1, 3, 3)}
    assert {r.text for r in turns.collect()} == {"one two", "three"}
    assert speaker_turns(df.limit(0), speakers).count() == 0
