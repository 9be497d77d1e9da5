import pytest
from pyspark.sql import functions as F

from segloom.operators import chunking, guards, jobs, ordered, prompts, resume, sections
from segloom.operators import segments as S


def plan(spark, d, size):
    df = spark.createDataFrame([(d,)], "duration_seconds double")
    return [(r.chunk_index, r.start_seconds, r.end_seconds) for r in chunking.chunk_plan(df, size=size).orderBy("chunk_index").collect()]


def test_chunk_plan(spark):
    assert plan(spark, 10.0, 180) == [(0, 0.0, 10.0)]
    assert len(plan(spark, 360.0, 180)) == 2 and plan(spark, 400.0, 180)[-1] == (2, 360.0, 400.0)
    for d, size in ((0.0, 180), (-5.0, 180), (100.0, 0), (float("nan"), 180), (None, 180)):
        assert plan(spark, d, size) == []
    assert len(plan(spark, 36000.0, 180)) == 200 and len(plan(spark, 0.5, 180)) == 1 and len(plan(spark, 180.005, 180)) == 1
    found = plan(spark, 500.0, 180)
    assert all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False))


def test_frame_batches(spark):
    df = spark.createDataFrame([(180.0, 197.0), (0.0, 0.2)], "start_seconds double, end_seconds double")
    got = [(r.batch, r.frames, r.batch_start, r.batch_end) for r in chunking.frame_batches(df).orderBy("batch").collect()]
    assert got == [(0, 15, 180.0, 187.5), (1, 15, 187.5, 195.0), (2, 4, 195.0, 197.0)]


def test_samples_and_offsets(spark):
    df = spark.createDataFrame([([32767, -32768, 0],)], "s array<smallint>")
    assert df.select(chunking.pcm_to_float("s")).first()[0] == pytest.approx([1.0, -1.00003, 0.0], abs=1e-4)
    assert df.select(chunking.to_global(F.lit(180.0), F.lit(500))).first()[0] == 185.0


def test_classify(spark):
    cases = {"Hello, how are you?": ("speech", "Hello, how are you?"), "[MUSIC]": ("sound", "music"), "  [APPLAUSE]  ": ("sound", "applause"), "he said [x] so": ("speech", "he said [x] so"), "": None, "   ": None, "[]": ("speech", "[]"), "[ A ]": ("sound", " a "), "[a][b]": ("speech", "[a][b]")}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "text string")
    got = {r.text: (r.type, r.content) for r in S.classify(df).collect()}
    assert got == {k: v for k, v in cases.items() if v}


ROWS = "job_id string, chunk_index int, ord int, seg_id bigint, type string, start_time string, end_time string, content string"


def test_transcript_and_context(spark):
    rows = [("j", 0, i, i, "speech", None, None, t) for i, t in enumerate(["a", " ", "b", "c", "d", "e", "f"])]
    rows += [("j", 0, 7, 7, "visual", None, None, "é" * 150), ("j", 1, 0, 8, "sound", None, None, "x")]
    df = spark.createDataFrame(rows, ROWS)
    keys = ["job_id", "chunk_index"]
    assert {r.chunk_index: r.transcript for r in S.transcripts(df, keys).collect()} == {0: "a b c d e f", 1: None}
    got = {r.chunk_index: r.context for r in S.contexts(df, keys).collect()}
    assert got == {0: "Recent dialogue: b c d e f Last visual: " + "é" * 100 + "...", 1: ""}
    carried = {r.chunk_index: r.previous_context for r in S.previous_contexts(S.contexts(df, keys)).collect()}
    assert carried == {0: None, 1: got[0]}


def test_merge_is_stable(spark):
    times = ["00:00:05.000", "bad", None, "00:00:05.000", "00:20:00.000", "00:00:01.000"]
    rows = [("j", i % 2, i, i, "speech", t, None, str(i)) for i, t in enumerate(times)]
    df = S.merge_timeline(spark.createDataFrame(rows, ROWS))
    assert [r.seg_id for r in df.orderBy("position").collect()] == [2, 1, 5, 0, 3, 4]
    nested = S.collect_timelines(df).first()
    assert [s.content for s in nested.segments] == ["2", "1", "5", "0", "3", "4"] and nested.segment_count == 6
    flat = S.explode_timelines(S.collect_timelines(df))
    assert sorted((r.position, r.content) for r in flat.collect()) == list(enumerate(["2", "1", "5", "0", "3", "4"]))


def test_positions_and_lag_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 1000).alias("t"), "id")
    got = ordered.positions(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 10)).collect()
    for k in (0, 1):
        mine = sorted((r.position, r.t) for r in got if r.k == k)
        assert [p for p, _ in mine] == list(range(500)) and [t for _, t in mine] == sorted(t for _, t in mine)
    lag = ordered.lagged(df, ["k"], ["t"], F.floor(F.col("t") / 10), "id", "before").collect()
    for k in (0, 1):
        mine = sorted((r.t, r.id, r.before) for r in lag if r.k == k)
        assert [m[2] for m in mine] == [None] + [m[1] for m in mine[:-1]]


def test_guard(spark):
    long = "This sentence is long enough"
    cases = {f"{long}. b. {long}. c. {long}. d": f"{long}. b. {long}. c", "a. a. a. a": "a. a. a. a", "": "", f"  {long}  ": long, None: None, " ": " "}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r.doc_id: r.guarded_text for r in guards.guard_repetition(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_answers(spark):
    bodies = ['{"message": {"content": " yes "}, "x": 1}', '{"message": {"content": "<think>a</think>b"}}', '{"message": {"content": "<think> in </think> "}}', '{"message": {"content": "<think> </think>"}}', '{"message": {"content": " "}}', "no json", "{}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r.i: (r.content, r.error is not None) for r in guards.parse_vision_response(df).collect()}
    assert got == {0: ("yes", False), 1: ("b", False), 2: ("in", False), 3: (None, True), 4: (None, True), 5: (None, True), 6: (None, True)}
    answer = '{"output": [{"type": "reasoning", "content": []}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "n"}, {"type": "output_text", "text": "b"}]}]}'
    row = spark.createDataFrame([(answer, '{"choices": [{"message": {"content": "c"}}]}', '{"choices": []}')], "a string, b string, c string")
    out = row.select(guards.responses_text(F.col("a")), guards.chat_text(F.col("b")), guards.chat_text(F.col("c"))).first()
    assert tuple(out) == ("a\n\nb", "c", "")


def test_prompts(spark):
    row = spark.createDataFrame([("T", "say", "ctx", None, " ")], "t string, a string, c string, n string, b string")
    p = lambda a, c: row.select(prompts.vision_prompt(F.col("t"), F.col(a), F.col(c))).first()[0]
    assert p("n", "b") == "T"
    assert p("a", "n").startswith("T\n\nAudio transcript for this segment:\n\"say\"\n\nUse this")
    assert p("a", "c").index("Context from previous segment") < p("a", "c").index("Audio transcript")
    body = row.select(prompts.chat_request("m", F.col("t"), F.array("a")), prompts.chat_request("m", F.col("t"), F.array().cast("array<string>"))).first()
    assert '"images":["say"]' in body[0] and "images" not in body[1] and '"stream":false' in body[0]


def test_sections(spark):
    assert sections.fill_sections([30, 80, 10, 5, 200, 1], 100) == [0, 1, 1, 1, 2, 3]
    assert sections.fill_sections([], 10) == []
    schema = "timeline_id bigint, segments array<struct<content: string>>"
    df = spark.createDataFrame([(1, [("x" * 400,), (None,), ("é" * 100,)]), (2, []), (3, None)], schema)
    got = [(r.position, r.tokens, r.section) for r in sections.pack_sections(df, 200).orderBy("position").collect()]
    assert got == [(0, 150, 0), (1, 50, 0), (2, 100, 1)]


def test_resume_and_jobs(spark):
    chunks = spark.createDataFrame([("j", 0), ("j", 1)], "job_id string, chunk_index int")
    done = spark.createDataFrame([("j", 1, "a"), ("j", 1, "b"), ("j", 7, "c")], "job_id string, chunk_index int, content string")
    assert [r.chunk_index for r in resume.missing_chunks(chunks, done).collect()] == [0]
    assert {(r.chunk_index, r.reused_segments) for r in resume.reused_chunks(chunks, done).collect()} == {(0, None), (1, 2)}
    log = [("a", 1, "queued"), ("a", 2, "failed"), ("a", 3, "completed"), ("b", 1, "queued"), ("b", 2, "processing"), ("b", 3, "processing")]
    df = spark.createDataFrame([(j, i, s) for j, i, s in log], "job_id string, event_id int, status string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 50_000))
    assert {(r.job_id, r.status) for r in jobs.fold_status(df).collect()} == {("a", "failed"), ("b", "processing")}
    assert {(r.job_id, r.event_id) for r in jobs.status_changes(df).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)}
    table = spark.createDataFrame([("1", "queued", None), ("2", "completed", None)], "id string, status string, error string")
    assert {tuple(r) for r in jobs.cancel_open(table).collect()} == {("1", "failed", "cancelled by user"), ("2", "completed", None)}
