from larkspur.streaming import metrics


def test_stream_equals_batch(spark, data, tmp_path):
    import shutil

    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{data}/events.parquet", src / "events.parquet")
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = metrics.read_stream(spark, str(src), events)
    metrics.run_once(metrics.tumbling(stream, "1 day"), "days", str(tmp_path / "c1"), mode="complete", fmt="memory")
    got = {tuple(r) for r in spark.sql("select start, event_type, n, total from days").collect()}
    assert got == {tuple(r) for r in metrics.tumbling(events, "1 day").collect()}
    out = str(tmp_path / "out")
    metrics.run_once(metrics.sessions(metrics.read_stream(spark, str(src), events), "30 minutes"), out, str(tmp_path / "c2"))
    appended = {tuple(r) for r in spark.read.parquet(out).select("user_id", "start", "n").collect()}
    assert appended and appended <= {tuple(r) for r in metrics.sessions(events, "30 minutes").collect()}
    seen = str(tmp_path / "seen")
    metrics.run_once(metrics.first_seen(metrics.read_stream(spark, str(src), events), "user_id"), seen, str(tmp_path / "c3"))
    assert spark.read.parquet(seen).count() >= events.select("user_id").distinct().count()
