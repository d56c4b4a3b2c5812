"""Queries of the general data problems: packed fields (p1) and intervals (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.intervals import periods_and_gaps
from shelfmark.operators.packed import split_packed
from shelfmark.session import table

PACKED = ["authors", "subjects", "bookshelves"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields of the catalogue, one row each, with its place."""
    return split_packed(table(spark, sf_dir, "gutenberg_catalog"), "row_id", PACKED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of the chapters and the regions of each file, and the gaps between them."""
    chapters = table(spark, sf_dir, "audio_chapters").select(F.lit("chapter").alias("span_of"), "track_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    regions = table(spark, sf_dir, "audio_regions").select(F.lit("region").alias("span_of"), "track_id", F.col("region_start").alias("s"), F.col("region_end").alias("e"))
    return periods_and_gaps(chapters.unionByName(regions), ["span_of", "track_id"], "s", "e")


_P4_PART = """
SELECT '{what}' AS span_of, track_id, s, e FROM (
  SELECT track_id, CAST({s} AS BIGINT) AS s, CAST({e} AS BIGINT) AS e FROM {table})
WHERE track_id IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e > s"""

P4_SQL = f"""
WITH v AS ({_P4_PART.format(what="chapter", s="start_ms", e="end_ms", table="audio_chapters")}
  UNION ALL {_P4_PART.format(what="region", s="region_start", e="region_end", table="audio_regions")}),
m AS (SELECT *, max(e) OVER (PARTITION BY span_of, track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM v),
g AS (SELECT *, sum(CASE WHEN far >= s THEN 0 ELSE 1 END) OVER (PARTITION BY span_of, track_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT span_of, track_id, min(s) AS from_at, max(e) AS to_at FROM g GROUP BY span_of, track_id, g),
n AS (SELECT *, lead(from_at) OVER (PARTITION BY span_of, track_id ORDER BY from_at) AS nxt FROM p)
SELECT span_of, track_id, 'period' AS found, from_at, to_at FROM p
UNION ALL SELECT span_of, track_id, 'gap', to_at, nxt FROM n WHERE nxt IS NOT NULL"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found}
SQL = {"p4_found": P4_SQL}
