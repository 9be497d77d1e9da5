import io
import json
import wave

import pytest

from segloom.config import Downloader, Media, Vision
from segloom.errors import DownloadError, MediaError
from segloom.sources import media


def wav(samples, channels=1, rate=16000, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setframerate(rate), w.setsampwidth(width)
        w.writeframes(b"".join(int(s).to_bytes(width, "little", signed=True) for s in samples))
    return out.getvalue()


def test_wav():
    assert media.decode_wav(wav([32767, -32768, 0])).tolist() == pytest.approx([1.0, -1.00003, 0.0], abs=1e-4)
    for bad in (wav([1, 2], channels=2), wav([1], rate=8000), wav([1], width=4)):
        with pytest.raises(MediaError):
            media.decode_wav(bad)


def test_listing(spark, tmp_path):
    assert media.recordings(spark, str(tmp_path)).count() == 0
    for name in ("z.mp4", "a.mp4", "b.txt", "m.mp4", "X.MP4", ".mp4"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.mp4").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in media.recordings(spark, str(tmp_path)).collect()] == ["a.mp4", "m.mp4", "z.mp4"]


def test_commands():
    a = media.audio_command(Media(), "v.mp4", 0.0, 180.0, "o.wav")
    assert a == ["ffmpeg", "-y", "-ss", "0", "-to", "180", "-i", "v.mp4", "-vn", "-acodec", "pcm_s16le", "-ar", "16000", "-ac", "1", "o.wav"]
    f = media.frames_command(Media(frame_format="png"), Vision(fps=0.5), "v.mp4", 1.5, 2.0, "/d")
    assert f[-5:] == ["-vf", "fps=0.5", "-q:v", "2", "/d/frame_%06d.png"] and f[3] == "1.5"
    assert media.probe_command(Media(), "v")[0] == "ffprobe"
    assert media.selector_of(Downloader(), "720", 60) == "bestvideo[height<=720][fps<=60]+bestaudio/best[height<=720]"
    with pytest.raises(MediaError, match="not found"):
        media.run_tool(["/no/such/tool"])
    with pytest.raises(MediaError):
        media.run_tool(["false"])


def test_probe(spark):
    def run(command):
        if "bad" in command[-1]:
            raise MediaError("no")
        return json.dumps({"format": {"duration": "12.5"} if "a" in command[-1] else {}})

    rows = media.probe_durations(spark.createDataFrame([("a",), ("bad",), ("e",)], "path string"), Media(), run).collect()
    assert {(r.path, r.duration_seconds, r.error is None) for r in rows} == {("a", 12.5, True), ("bad", None, False), ("e", None, False)}


def test_download(tmp_path):
    def run(command, timeout):
        if "--print" in command:
            return f"{tmp_path}/A title.webm\n"
        if command[-1] == "ok":
            (tmp_path / "A title.mp4").write_bytes(b"x")
        return ""

    with pytest.raises(DownloadError):
        media.download_video(Downloader(), "lost", str(tmp_path), run=run)
    assert media.download_video(Downloader(), "ok", str(tmp_path), run=run) == (f"{tmp_path}/A title.mp4", "A title")
