"""Overlapping and gapped intervals: continuous periods of each entity and the gaps between them.

Method: Spark's ``session_window`` with a row-specific duration merges the
overlapping intervals of an entity natively (one unit of the bounds is one
microsecond of the window's time line). Touching sessions are then read as one:
a period starts where nothing before reaches, its end is what had been reached
when the next one starts, and ``lead`` gives that next start, hence the gap.

Skew: rows are first reduced to one row per (entity, start), so repeated rows
cost nothing. They are then cut into slices of about equally many rows by
quantiles of (entity, start), so that neither a hot entity nor an outlying
start fills a task. Sessions are merged inside each slice; what earlier slices
of the entity reach, and what the first later slice with a start of a period
begins with, are taken from a table of one row per slice and entity.

Defined results: a row with a null entity, a null bound or an end not above
its start counts for nothing; repeated, nested, touching and unordered rows
give the same periods as any other cover of the same points; an empty table
gives no rows. Bounds may be any long within ``±2**62``; columns besides the
named ones are neither read nor kept, so extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut, width

#: Longest session that Spark's window is asked for: its seconds have 18 digits, six of them after the point.
LONGEST = 10**17
#: Distinct starts that one slice is meant to hold at most.
SLICE_ROWS = 200_000


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping rows of each key merged by session windows; ``s`` and ``e`` are the bounds.

    What begins more than ``LONGEST`` units after the start of a longer row may come out beside it; the furthest end before it joins it.
    """
    at = df.select(*keys, "s", "e", F.timestamp_micros("s").alias("at"))
    gap = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, CAST(least(CAST(e AS DECIMAL(20, 0)) - s, {LONGEST}) / 1000000 AS DECIMAL(18, 6)))")
    merged = at.groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select(*keys, "s", "e")


def _starts(rows: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """Where periods start: ``keys, s, seen`` (what was reached before, null at the first) and the same of the next start, ``next_s, next_seen``.

    After the last start ``next_s`` is null and ``next_seen`` the furthest end of the entity.
    """
    part = [*keys, "slice"]
    distinct = cut(rows.groupBy(*keys, "s").agg(F.max("e").alias("e")))
    n = max(width(rows.sparkSession), -(-distinct.count() // slice_rows))
    sliced = cut(distinct.repartitionByRange(n, *keys, "s").withColumn("slice", F.spark_partition_id()))
    local = cut(_merge(sliced, part))
    # one row for each slice of an entity: what it reaches, what all slices before it reach
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = local.groupBy(*part).agg(F.max("e").alias("far"))
    reach = cut(reach.select(*part, F.max("far").over(before).alias("carried"), F.max("far").over(Window.partitionBy(*keys)).alias("end")))
    own = Window.partitionBy(*part).orderBy("s")
    seen = F.greatest(F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    starts = local.join(reach, part).withColumn("seen", seen).filter("seen IS NULL OR seen < s")
    starts = cut(starts.select(*part, "s", "seen", "end"))
    after = Window.partitionBy(*keys).orderBy("slice").rowsBetween(1, 1)
    first = starts.groupBy(*part).agg(F.min(F.struct("s", "seen")).alias("first"))
    first = first.select(*part, F.first("first").over(after).alias("later"))
    here = F.lead(F.struct("s", "seen")).over(own)
    both = starts.join(first, part).withColumn("next", F.coalesce(here, F.col("later")))
    return both.select(*keys, "s", "seen", F.col("next.s").alias("next_s"), F.coalesce("next.seen", "end").alias("next_seen"))


def _valid(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    rows = df.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    return rows.filter(f"{known} AND s IS NOT NULL AND e IS NOT NULL AND e > s")


def periods(df: DataFrame, entity: str | list[str], start: str, end: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Longest stretches covered without break: the columns ``entity``, ``from_at, to_at`` (half-open)."""
    keys = [entity] if isinstance(entity, str) else entity
    own = [f"k{i}" for i in range(len(keys))]
    named = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(start).alias("s"), F.col(end).alias("e"))
    got = _starts(_valid(named, own, "s", "e"), own, slice_rows)
    return got.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("s").alias("from_at"), F.col("next_seen").alias("to_at"))


def periods_and_gaps(df: DataFrame, entity: str | list[str], start: str, end: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Periods and the gaps between them: the columns ``entity``, ``found ('period' | 'gap'), from_at, to_at``."""
    keys = [entity] if isinstance(entity, str) else entity
    own = [f"k{i}" for i in range(len(keys))]
    named = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(start).alias("s"), F.col(end).alias("e"))
    got = _starts(_valid(named, own, "s", "e"), own, slice_rows)
    found = F.array(
        F.struct(F.lit("period").alias("found"), F.col("s").alias("from_at"), F.col("next_seen").alias("to_at")),
        F.struct(F.lit("gap").alias("found"), F.col("next_seen").alias("from_at"), F.col("next_s").alias("to_at")))
    out = got.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.explode(found).alias("x")).select(*keys, "x.*")
    return out.filter(F.col("to_at").isNotNull())
