import json

import pytest

from segloom.errors import ApiError, JsonError
from segloom.sources import store

SEG = {"type": "speech", "start": "00:00:00.000", "end": "00:00:01.000", "content": "hé"}
TIMELINE = {"source": "a.mp4", "duration_seconds": 1.5, "segments": [SEG]}


def test_checkpoints(spark, tmp_path):
    assert store.load_checkpoints(spark, tmp_path, "j").count() == 0
    for i in range(3):
        store.save_checkpoint(tmp_path, "j", i, [SEG | {"content": str(i)}, SEG])
    where = store.checkpoint_dir(tmp_path, "j")
    assert sorted(p.name for p in where.iterdir()) == ["chunk_000.json", "chunk_001.json", "chunk_002.json"]
    (where / "chunk_009.json.tmp").write_text("{")
    (where / "chunk_008.json").write_text(json.dumps({"version": 2, "chunk_index": 8, "segments": [SEG]}))
    rows = store.load_checkpoints(spark, tmp_path, "j").orderBy("chunk_index", "ord").collect()
    assert [(r.chunk_index, r.ord, r.content) for r in rows] == [(0, 0, "0"), (0, 1, "hé"), (1, 0, "1"), (1, 1, "hé"), (2, 0, "2"), (2, 1, "hé")]
    store.save_checkpoint(tmp_path, "j", 3, [])
    assert {r.chunk_index for r in store.checkpoints(spark, tmp_path, "j").collect()} == {0, 1, 2, 3}  # done, though it holds no row
    assert store.read_checkpoint(tmp_path, "j", 3) == [] and store.read_checkpoint(tmp_path, "j", 8) is None and store.read_checkpoint(tmp_path, "j", 4) is None
    (where / "chunk_007.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        store.load_checkpoints(spark, tmp_path, "j").collect()
    store.clear_checkpoints(tmp_path, "j")
    store.clear_checkpoints(tmp_path, "j")
    assert not where.exists()
    assert store.checkpoint_key("a", "b") == store.checkpoint_key("a", "b") != store.checkpoint_key("a", "c")


def test_results(spark, tmp_path):
    assert store.persisted_results(spark, tmp_path).count() == 0
    store.persist_result(tmp_path, "one", "a.mp4", TIMELINE)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "job.json").write_text(json.dumps({"id": "two", "source": "b", "status": "completed"}))
    store.persist_result(tmp_path, "three", "c.mp4", TIMELINE)
    (tmp_path / "three" / "timeline.json").write_text("{nope")
    store.persist_result(tmp_path, "four", "d.mp4", TIMELINE)
    (tmp_path / "four" / "job.json").write_text(json.dumps({"id": "four", "source": "d", "status": "failed"}))
    rows = store.persisted_results(spark, tmp_path).collect()
    assert [(r.id, r.source, r.duration_seconds, r.segments[0].content) for r in rows] == [("one", "a.mp4", 1.5, "hé")]
    assert store.stored_result(tmp_path, "one") == TIMELINE and store.stored_result(tmp_path, "none") is None


def test_cache(spark, tmp_path):
    assert store.cache_entries(spark, tmp_path).count() == 0
    path = store.cache_store(tmp_path, "/v/a.mp4", None, TIMELINE)
    store.cache_store(tmp_path, "https://x.invalid/b", "https://x.invalid/b", TIMELINE | {"source": "b.mp4.mp4"})
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "meta.json").write_text("{")
    rows = store.cache_entries(spark, tmp_path).collect()
    assert [r.title for r in rows] == ["b", "a"] and rows[0].segment_count == 1
    assert store.cache_lookup(tmp_path, "/v/a.mp4") == path and store.cache_lookup(tmp_path, "no") is None
    assert store.cache_load(tmp_path, "/v/a.mp4") == TIMELINE
    assert store.resolve_input(tmp_path, store.cache_hash("/v/a.mp4")) == path == store.resolve_input(tmp_path, str(path))
    for unknown in ("00000000", "/no/file"):
        with pytest.raises(ApiError):
            store.resolve_input(tmp_path, unknown)


def test_timeline_files_are_strict(spark, tmp_path):
    bad = [{}, TIMELINE | {"segments": [SEG | {"type": "smell"}]}, TIMELINE | {"segments": [{"type": "speech"}]}, TIMELINE | {"duration_seconds": None}, TIMELINE | {"segments": [SEG | {"content": 3}]}]
    for value in bad:
        with pytest.raises(JsonError):
            store.checked_timeline(value)
    assert store.checked_timeline(TIMELINE | {"extra": 1}) == TIMELINE
    (tmp_path / "a.json").write_text(json.dumps(TIMELINE, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(bad[1]))
    assert sorted(r.accepted for r in store.read_timelines(spark, str(tmp_path)).collect()) == [False, True]
