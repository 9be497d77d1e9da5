from segloom.streaming import live


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_status_is_absorbing(spark, tmp_path):
    rows = [(1, 1, 10, "queued"), (1, 2, 20, "queued"), (1, 3, 30, "failed"), (1, 4, 40, "completed"), (2, 5, 5, "processing")]
    got = drain(live.live_status(stream(spark, tmp_path, rows, "job_id bigint, event_id bigint, ts bigint, status string")), "changes")
    assert {tuple(r) for r in got} == {(1, 1, "queued", None), (1, 3, "failed", "queued"), (2, 5, "processing", None)}


def test_chunks_and_deliveries(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2025, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    rows = [("j", 1, at(0), "aé"), ("j", 1, at(1), "aé"), ("j", 2, at(200), "b")]
    schema = "job_id string, seg_id bigint, received_at timestamp, content string"
    df = stream(spark, tmp_path, rows, schema)
    assert {(r.segments, r.bytes) for r in drain(live.live_chunks(df), "windows", "complete")} == {(2, 6), (1, 1)}
    assert len(drain(live.once(df), "deliveries")) == 2
