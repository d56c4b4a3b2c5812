"""Ranked, filtered and paged search. Parameters are checked before any job starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scalars import col


def check_page(limit: int, offset: int, most: int = 50, furthest: int = 10_000) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie in 1..{most}")
    if not 0 <= offset <= furthest:
        raise ValueError(f"offset must lie in 0..{furthest}")


def has(c: Column | str, needle: str) -> Column:
    """Case-folded substring test; false for null."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lit(needle.lower())), F.lit(False))


def any_has(array: Column | str, needle: str) -> Column:
    return F.coalesce(F.exists(col(array), lambda x: has(x, needle)), F.lit(False))


def match_rank(needle: str, ident: Column | str, title: Column | str, authors: Column | str, topics: Column | str) -> Column:
    """0: the id or the title, 1: an author, 2: a topic, null: no match."""
    same = F.coalesce(col(ident).cast("string") == needle, F.lit(False))
    return F.when(same | has(title, needle), 0).when(any_has(authors, needle), 1).when(any_has(topics, needle), 2)


def ranked(df: DataFrame, needle: str, ident: str, title: str, authors: Column | str, topics: Column | str) -> DataFrame:
    """Matching rows with their ``rank``."""
    if not needle.strip():
        raise ValueError("the search text is empty")
    return df.withColumn("rank", match_rank(needle.strip(), ident, title, authors, topics)).filter("rank IS NOT NULL")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 50, furthest: int = 10_000) -> DataFrame:
    """One page in a total order: planned as one top-k, never as a full sort."""
    check_page(limit, offset, most, furthest)
    return df.orderBy(*order).offset(offset).limit(limit)


def with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 50) -> DataFrame:
    """A page whose rows also carry the exact number of matches."""
    return page(df, order, limit, offset, most).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def first_per_source(sources: dict[str, DataFrame], order: str, limit: int) -> DataFrame:
    """The first rows of each source, kept apart and not ranked against each other: ``source, pos`` and the columns."""
    out = None
    for name, df in sources.items():
        top = df.orderBy(order).limit(limit)  # at most `limit` rows are numbered
        part = top.withColumn("pos", F.row_number().over(Window.orderBy(order))).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def source_status(sources: dict[str, DataFrame | None], limit: int) -> DataFrame:
    """How each source answered: ``source, status, n``; failed (there is none), empty, complete, or more than ``limit`` rows."""
    out = None
    for name, df in sources.items():
        if df is None:
            part = next(x for x in sources.values() if x is not None).sparkSession.createDataFrame([(name, "failed", None)], "source string, status string, n long")
        else:
            n = F.col("n")
            part = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), F.when(n == 0, "empty").when(n <= limit, "complete").otherwise("more").alias("status"), F.least(n, F.lit(limit).cast("long")).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def first_seen(df: DataFrame, key: list[str], line: str, limit: int, offset: int = 0, most: int = 50) -> DataFrame:
    """A page of distinct keys in the order in which they first appear, with their first line and the number of keys in all."""
    keys = df.groupBy(*key).agg(F.min(line).alias("first_line"))
    return with_total(keys, [F.col("first_line"), *map(F.col, key)], limit, offset, most)


def first_hits(found: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first matches in order, and whether there are more: ``matches_truncated``."""
    top = found.orderBy(*order).limit(limit + 1)  # at most limit + 1 rows are numbered
    n = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("_n", n).withColumn("matches_truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > limit).filter(F.col("_n") <= limit).drop("_n")


def newest(df: DataFrame, at: str, ident: str, limit: int = 100) -> DataFrame:
    """The newest rows, ties by id; ``truncated`` tells whether there were more."""
    more = df.orderBy(F.col(at).desc(), ident).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(F.col(at).desc(), ident))
    numbered = more.withColumn("pos", rank).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit)
    return numbered.filter(F.col("pos") <= limit)


def custom_order(c: Column | str, values: list[str]) -> Column:
    """Place of a value in a list; values outside it come last."""
    at = F.array_position(F.array(*map(F.lit, values)), col(c))
    return F.when(at > 0, at).otherwise(len(values) + 1)
