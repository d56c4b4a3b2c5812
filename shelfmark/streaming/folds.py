"""Live folds of logs with Structured Streaming.

``latest`` and ``counts`` use built-in state. ``job_states`` needs the rule
that a terminal event sticks, so it keeps one small state for each key.
The batch forms in ``shelfmark.operators.folds`` give the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def latest(stream: DataFrame, key: str, line: str) -> DataFrame:
    """The last line of each key so far (update or complete mode): one aggregation state for each key."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(line)).alias("x"), F.min(line).alias("first_line")).select(key, "first_line", *[f"x.{c}" for c in rest])


def counts(stream: DataFrame, at: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Windowed counts and sums; events later than ``late`` behind the newest are left out by the watermark."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    g = stream.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), key, "n", "total")


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def job_states(stream: DataFrame, key: str, line: str, event: str, terminal: list[str]) -> DataFrame:
    """Status of each job after each batch: the first terminal event sticks. Lines may come in any order.

    A job's state, five values, is kept as long as the query runs, since a late line may always change it.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, status string, updated_line long, n_events long"
    final = set(terminal)

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done_line, done_event, last_line, last_event, n = state.get if state.exists else (-1, "", -1, "", 0)
        for pdf in pdfs:
            n += len(pdf)
            for at, e in zip(pdf[line].tolist(), pdf[event].tolist()):
                if e in final and (done_line < 0 or at < done_line):
                    done_line, done_event = at, e
                if at > last_line:
                    last_line, last_event = at, e
        state.update((done_line, done_event, last_line, last_event, n))
        status: tuple[Any, Any] = (done_event, done_line) if done_line >= 0 else (last_event, last_line)
        yield pd.DataFrame({key: [k[0]], "status": [status[0]], "updated_line": [status[1]], "n_events": [n]})

    state = "done_line long, done_event string, last_line long, last_event string, n long"
    return stream.groupBy(key).applyInPandasWithState(step, out, state, "update", "NoTimeout")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream to a Parquet table partitioned by ``epoch``, until its source is drained.

    Each batch has its own partition, which is overwritten: a batch that is replayed after a failure stands there once.
    """

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
