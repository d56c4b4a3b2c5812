"""Streaming queries, run over the whole events table until it is drained."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import checkpoint_dir, table
from shelfmark.streaming import folds


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = table(spark, sf_dir, name).schema
    source = path if os.path.isdir(path) else sf_dir
    pattern = "*.parquet" if os.path.isdir(path) else os.path.basename(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)


def _drain(df: DataFrame, mode: str) -> DataFrame:
    """What a stream writes in all, as a table in the shared folder."""
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(part: DataFrame, epoch: int) -> None:
        part.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(base)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(f"{base}/out")


def _latest_epoch(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, "epoch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(key, "x.*")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, followed live."""
    s = _stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return _latest_epoch(_drain(folds.latest(s, "user_id", "event_id"), "update"), "user_id")


def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job journal, followed live: purchase and error stick."""
    s = _stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return _latest_epoch(_drain(folds.job_states(s, "user_id", "event_id", "event_type", ["purchase", "error"]), "update"), "user_id")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values by hour and type, under a watermark, with what a drained stream has closed so far."""
    s = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = _drain(folds.counts(s, "ts", "event_type", "value"), "update")
    last = out.groupBy("from_at", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return last.select(F.col("from_at").cast("timestamp_ntz").alias("from_at"), "event_type", "x.n", F.round("x.total", 2).alias("total"))


QUERIES = {f.__name__: f for f in (stream_latest, stream_jobs, stream_hourly)}
SQL = {
    "stream_latest": "SELECT user_id, min(event_id) AS first_line, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "stream_jobs": "WITH d AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id) AS fd, max(event_id) OVER (PARTITION BY user_id) AS l, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) SELECT user_id, event_type AS status, event_id AS updated_line, n_events FROM d WHERE event_id = coalesce(fd, l)",
    "stream_hourly": "SELECT date_trunc('hour', ts) AS from_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
