import pytest
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.functions import timecode as C


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_format_timestamp(spark):
    cases = {0.0: "00:00:00.000", 72.4: "00:01:12.400", 3661.5: "01:01:01.500", 360_000.0: "100:00:00.000", -5.0: "00:00:00.000", float("nan"): "00:00:00.000", 0.0005: "00:00:00.001"}
    assert column(spark, list(cases), C.format_timestamp, "double") == list(cases.values())
    assert column(spark, [None, float("inf")], C.format_timestamp, "double") == [None, None]


def test_parse_timestamp(spark):
    cases = {"00:00:00.000": 0.0, "00:01:12.400": 72.4, "01:01:01.500": 3661.5, "invalid": None, "0:0:1": 1.0, "00:00:01.5": 1.5, "00:00:12.": None, " 0:0:1": None, "0:0:1d": None, "1:2": None, "0:0:1.25.9": 1.25, "0:0:nan": None, "1e1:0:0": 36000.0}
    got = column(spark, list(cases), C.parse_timestamp)
    assert got == [None if v is None else pytest.approx(v) for v in cases.values()]


def test_round_trip(spark):
    values = [0.0, 1.234, 72.4, 3661.5, 7200.0]
    back = column(spark, values, lambda c: C.parse_timestamp(C.format_timestamp(c)), "double")
    assert all(abs(a - b) < 0.001 for a, b in zip(values, back, strict=True))


def test_offsets_in_every_notation(spark):
    for given in ("00:01:02.345", "00:01:02,345", "62.345", "1:02.345", "62.345s", "0h01m02.345s", " 00:01:02.345 "):
        assert column(spark, [given], C.parse_offset_ms) == [62345], given
    for none in (None, "", "unknown", "--:--:--.---", "00:xx:12.000", "N/A", "NaN", "invalid", "1:2:3:4", "-5", "999999999999999999999:00:00"):
        assert column(spark, [none], C.parse_offset_ms) == [None], none
    assert column(spark, ["00:00:07", "5", "100:00:00.5"], C.parse_offset_ms) == [7000, 5000, 360_000_500]


def test_names(spark):
    assert column(spark, [3, 1234], C.chunk_name, "int") == ["chunk_003", "chunk_1234"]
    assert column(spark, ["a.mp4", "b.mp4.mp4", "c.mov", None], T.title_of) == ["a", "b", "c.mov", None]
    assert column(spark, ["/x/.mp4", "/x/a.mp4", "/x/A.MP4", "a.mp4\n", "b.mp4"], T.is_mp4_path) == [False, True, False, False, True]
    assert column(spark, [".mp4", "a.mp4", "a"], T.is_mp4_upload) == [True, True, False]
    assert column(spark, ["deadBEEF", "deadbee", "deadbeefx", "zzzzzzzz"], T.is_hash) == [True, False, False, False]
    assert column(spark, ["/in/v.mp4", "v"], T.json_output_path) == ["/in/v.json", "v.json"]
    assert column(spark, ["/in/v.mp4"], lambda c: T.json_output_path(c, "/out")) == ["/out/v.json"]
    assert column(spark, ["/c/cache/ab/timeline.json", "/in/t.json"], lambda c: T.formatted_output_path(c, "/cache/")) == ["/c/cache/ab/formatted.md", "/in/t_formatted.md"]
    assert column(spark, [None, "/a/b.mp4"], lambda c: T.source_name(c, F.lit("/x/y.mp4"))) == ["y.mp4", "/a/b.mp4"]


def test_hash_is_stable(spark):
    a, b = column(spark, ["one", "two"], T.source_hash)
    assert len(a) == len(b) == 8 and a != b


def test_trim_and_thinking(spark):
    assert column(spark, ["  x　\t", "   ", None], T.utrim) == ["x", "", None]
    assert column(spark, ["<think>a</think> b ", "no tag ", "a</think>b</think>c"], T.strip_thinking) == ["b", "no tag", "b</think>c"]


def test_byte_cuts(spark):
    assert column(spark, ["aé" * 3, "ab", None, "🎬🎬"], lambda c: T.byte_prefix(c, 5)) == ["aéa", "ab", None, "🎬"]
    assert column(spark, ["x" * 300], lambda c: T.ellipsize_bytes(c, 200, 200)) == ["x" * 200 + "..."]


def test_header_and_selector(spark):
    assert column(spark, ["sum\n## Scene 1", "sum\n### Scene 1", "y" * 3000], T.header_context) == ["sum\n", "sum\n#", "y" * 2000]
    df = spark.createDataFrame([("720", 60), ("480", 24), (None, None), ("720", None)], "r string, f int")
    got = [r.s for r in df.select(T.format_selector(F.col("r"), F.col("f")).alias("s")).collect()]
    want = [("720", 60), ("480", 24), ("1080", 30), ("720", 30)]
    assert got == [f"bestvideo[height<={r}][fps<={f}]+bestaudio/best[height<={r}]" for r, f in want]


def test_errors(spark):
    assert column(spark, ["vision", "cancelled", "other"], lambda c: T.error_text(c, F.lit("x"))) == ["vision model error: x", "job cancelled", None]


def test_offset_of_one_text_agrees(spark):
    from segloom.functions.timecode import offset_ms, parse_offset_ms

    texts = ["00:01:02.345", "1:02,5", "62.3455s", "0h01m02.000s", " 5 ", "5.", "x", "", None, "1:2:3:4", "-1", "9999999:00:00", "0:00:0.0005", "1h"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_offset_ms(F.col("t")).alias("ms")).collect()
    assert [r.ms for r in rows] == [offset_ms(t) for t in texts]
