import random

from segloom.llm.runs import collapse_runs, letters, within, without_interview_speech

SCHEMA = "job_id string, segment_type string, start_ms bigint, end_ms bigint, chunk_index int, ord int, seg_id bigint, content string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, edits=2, gap=None):
    seen, groups = set(), {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2], r[4], r[5], r[6])):
        if r[6] in seen or r[7] is None or not r[7].strip():
            continue
        seen.add(r[6])
        groups.setdefault((r[0], r[1]), []).append(r)
    out = set()
    for (job, kind), rs in groups.items():
        run = [rs[0]]
        for a, b in zip(rs, rs[1:] + [None], strict=True):
            if b is not None and levenshtein(letters(a[7]), letters(b[7])) <= edits and (gap is None or b[2] - a[3] <= gap):
                run.append(b)
            else:
                if len(run) > 1:
                    out.add((job, kind, run[0][6], run[-1][6], len(run), run[0][2], max(x[3] for x in run)))
                run = [b]
    return out


def found(df):
    return {(r.job_id, r.segment_type, r.first_seg_id, r.last_seg_id, r.events, r.start_ms, r.end_ms) for r in df.collect()}


def test_within_is_bounded_levenshtein():
    rnd = random.Random(1)
    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        for k in (0, 1, 2, 3):
            assert within(a, b, k) == (levenshtein(a, b) <= k), (a, b, k)


def test_letters():
    assert letters("1. Hello, World! (22)") == "helloworld"
    assert letters("Café ²½ _x") == "caféx" == letters("café x")


def test_runs_across_slices(spark, sliced):
    rnd = random.Random(7)
    words = ["wind howling", "wind howlin", "drum roll", "coins dropping", "12", "...", "", None, "  "]
    rows = [
        (rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice(["sound", "speech"]), t := rnd.randint(0, 60), t + rnd.randint(0, 9), rnd.randint(0, 1), rnd.randint(0, 3), i, rnd.choice(words[: rnd.choice([2, 9])]))
        for i in range(900)
    ]
    rows += rows[::7]
    df = spark.createDataFrame(rows, SCHEMA)
    with sliced(7):
        assert found(collapse_runs(df)) == brute(rows)
        for gap in (0, 1):
            assert found(collapse_runs(df, max_gap_ms=gap)) == brute(rows, gap=gap)


def test_one_run_over_all_slices(spark, sliced):
    rows = [("j", "sound", i, i + 1, 0, i, i, "siren") for i in range(500)]
    with sliced(8):
        assert found(collapse_runs(spark.createDataFrame(rows, SCHEMA))) == {("j", "sound", 0, 499, 500, 0, 500)}


def test_time_gap_and_interviews(spark):
    rows = [("j", "speech", 0, 5, 0, 0, 1, "same"), ("j", "speech", 6, 8, 0, 1, 2, "same"), ("j", "speech", 900, 901, 0, 2, 3, "same")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(collapse_runs(df, max_gap_ms=10)) == {("j", "speech", 1, 2, 2, 0, 8)}
    jobs = spark.createDataFrame([("j", "interview"), ("j", "interview"), (None, "interview")], "id string, profile string")
    assert without_interview_speech(df, jobs).count() == 0
    assert without_interview_speech(spark.createDataFrame([(None, *rows[0][1:]), ("j", "sound", *rows[0][2:])], SCHEMA), jobs).count() == 2


def test_null_ids_are_not_repeats(spark):
    rows = [("j", "s", i, i + 1, None, None, None, "same") for i in range(3)]
    (run,) = collapse_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run.events == 3 and run.first_seg_id is None


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collapse_runs(df).count() == 0
    clash = spark.createDataFrame([("j", "s", 0, 1, 0, 0, 1, "x" * 100_000, 1, 2)], SCHEMA + ", slice int, events int")
    assert collapse_runs(clash).count() == 0
