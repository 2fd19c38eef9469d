from pyspark.sql import functions as F

from stillwater.operators import compare as C
from stillwater.operators import temporal as T
from stillwater.sources import frames as S
from stillwater.streaming import observer, replay

OPTIONS, SCHEDULE = C.CompareOptions("rgb", 40, 0.1), T.Schedule(100, 2000, 300)


def samples(spark, sf_dir):
    lines = S.embedding_scanlines(spark, sf_dir)
    s = S.scripted_samples(S.embedding_frames(spark, sf_dir), SCHEDULE.samples)
    return (
        T.sampled(s, C.compare_to_baseline(lines, OPTIONS, "lines")),
        T.sampled(s, C.compare_consecutive(lines, OPTIONS, "lines")),
    )


def streamed(spark, tmp_path, rows, run):
    """Rows written as three files, read one a micro-batch."""
    folder = str(tmp_path / "in")
    for low in (0, 7, 14):
        rows.filter((F.col("i") >= low) & (F.col("i") < low + 7)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = run(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("out").collect()


def test_stable_equals_batch(spark, sf_dir, tmp_path):
    consecutive = samples(spark, sf_dir)[1]
    rows = consecutive.select("session_id", "i", "frame_id", (F.col("changed") & ~F.col("again")).alias("changed"))
    got = streamed(spark, tmp_path, rows, lambda s: observer.stream_wait_stable(s, SCHEDULE))
    batch = T.wait_stable(consecutive, SCHEDULE).collect()
    assert {(r.session_id, r.outcome, r.final_i, r.stable_ms) for r in got} == {(r.session_id, r.outcome, r.comparisons, r.stable_ms) for r in batch}


def test_change_equals_batch(spark, sf_dir, tmp_path):
    baseline = samples(spark, sf_dir)[0]
    rows = baseline.select("session_id", "i", "frame_id", "changed")
    got = streamed(spark, tmp_path, rows, lambda s: observer.stream_wait_change(s, SCHEDULE))
    batch = T.wait_change(baseline, SCHEDULE).collect()
    assert {(r.session_id, r.outcome, r.final_i, r.final_frame_id) for r in got} == {(r.session_id, r.outcome, r.comparisons, r.final_frame_id) for r in batch}


def test_observe_equals_batch(spark, sf_dir, tmp_path):
    baseline, consecutive = samples(spark, sf_dir)
    b = baseline.select("session_id", "i", F.col("changed").alias("from_baseline"))
    rows = consecutive.join(b, ["session_id", "i"]).select(
        "session_id", "i", "frame_id", "from_baseline", (F.col("changed") & ~F.col("again")).alias("changed"))
    got = streamed(spark, tmp_path, rows, lambda s: observer.stream_observe(s, SCHEDULE))
    batch = T.observe(baseline, consecutive, SCHEDULE).collect()
    kept = lambda r, i: (r.session_id, r.outcome, r.change_detected_ms, r.first_change_frame_id, i, r.final_frame_id, r.stable_ms)
    assert batch and {kept(r, r.final_i) for r in got} == {kept(r, r.comparisons) for r in batch}


def timed(spark, tmp_path, rows, run):
    """Rows (sample, changed, from_baseline) of sessions with the times they were taken at, a file a second."""
    folder = str(tmp_path / "timed")
    df = spark.createDataFrame(rows, "session_id long, i long, frame_id long, from_baseline boolean, changed boolean")
    df = df.withColumn("at", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("i") * 100))
    for low in range(0, 60, 10):
        df.filter((F.col("i") >= low) & (F.col("i") < low + 10)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("at", "0 seconds")
    q = run(stream).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "t")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted(map(tuple, spark.table("timed").collect()))


def test_silent_sessions_time_out(spark, tmp_path):
    """Session 1 goes on for long, and its clock ends the others: 2 falls silent before any change, 3 after one, 4 settles."""
    rows = [(1, i, i + 1, False, True) for i in range(60)]
    rows += [(2, i, i + 1, False, False) for i in range(5)]
    rows += [(3, i, i + 1, i >= 2, i >= 2) for i in range(5)]
    rows += [(4, i, i + 1, i >= 2, i == 2) for i in range(9)]
    got = timed(spark, tmp_path / "a", rows, lambda s: observer.stream_observe(s, SCHEDULE, "at"))
    last = SCHEDULE.samples - 1
    assert got == [(1, "timeout", None, None, last, last + 1, None), (2, "timeout", None, None, 4, 5, None), (3, "timeout", 200, 3, 4, 5, None), (4, "observed", 200, 3, 5, 6, 300)]
    got = timed(spark, tmp_path / "b", rows, lambda s: observer.stream_wait_stable(s, SCHEDULE, "at"))
    assert [r[:2] for r in got] == [(1, "timeout"), (2, "stable"), (3, "timeout"), (4, "stable")]
    assert got[2] == (3, "timeout", 4, 5, 1_600)


def test_replay_source(spark):
    replay.register(spark)
    lines = spark.read.format("replay").option("frames", 3).option("width", 8).option("height", 6).load()
    expected = S.to_scanlines(S.texture(spark, 8, 6, [0, 40, 80]), ["session_id", "frame_id"])
    key = lambda r: (r.frame_id, r.y, r.r, r.g, r.b)
    assert sorted(map(key, lines.collect())) == sorted(map(key, expected.collect()))
