import datetime as dt

from shelfmark.operators import folds as batch
from shelfmark.streaming import folds


def events(spark, path, rows):
    spark.createDataFrame(rows, "user_id long, line long, event string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(path)


def test_live_folds_equal_batch_folds(spark, tmp_path):
    path, t0 = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    all_rows = [(k % 5, k, ["start", "note", "done", "failed"][(k * 7) % 4], t0 + dt.timedelta(minutes=k), float(k)) for k in range(60)]
    events(spark, path, all_rows[:25])
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    df = folds.job_states(stream, "user_id", "line", "event", ["done", "failed"])
    q = df.writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    events(spark, path, all_rows[25:])
    q.processAllAvailable()
    q.stop()
    live = {(r.user_id, r.status, r.updated_line, r.n_events) for r in spark.sql("SELECT user_id, max_by(struct(*), n_events) x FROM jobs GROUP BY user_id").select("x.*").collect()}
    want = batch.job_fold(spark.read.parquet(path), "user_id", "line", "ts", "event", ["done", "failed"])
    assert live == {(r.user_id, r.status, r.updated_line, r.n_events) for r in want.collect()}


def test_late_rows_and_windows(spark, tmp_path):
    path, t0 = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    stream_rows = [(1, 1, "a", t0, 1.0), (1, 2, "a", t0 + dt.timedelta(hours=9), 2.0)]
    events(spark, path, stream_rows)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    df = folds.counts(stream, "ts", "event", "value", "1 hour", None, "2 hours")
    q = df.writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    events(spark, path, [(1, 3, "a", t0 + dt.timedelta(minutes=5), 10.0), (1, 4, "a", t0 + dt.timedelta(hours=20), 1.0)])
    q.processAllAvailable()
    q.stop()
    rows = {(r.from_at, r.n, r.total) for r in spark.table("hours").collect()}
    assert (t0, 1, 1.0) in rows and (t0 + dt.timedelta(hours=9), 1, 2.0) in rows  # the late row is left out


def test_stream_to_table(spark, tmp_path):
    path = str(tmp_path / "in")
    events(spark, path, [(k, k, "a", dt.datetime(2024, 1, 1), 0.0) for k in range(20)] * 2)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    folds.to_table(folds.deduplicated(stream, "line", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
