"""Groupings with evidence: exact copies, stated relations, ordered sets, candidates, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows with the same bytes: ``sha256, copies, first_key``. Only digests are shuffled."""
    d = df.filter(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))


def exact_members(df: DataFrame, key: str, content: str) -> DataFrame:
    """Every location of the contents that stand more than once: ``sha256, key``. Only digests and keys are shuffled."""
    d = df.filter(F.col(content).isNotNull()).select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    several = d.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha256")
    return d.join(several, "sha256").select("sha256", key)


def related_members(df: DataFrame, member: str, relations: dict[str, Column]) -> DataFrame:
    """The evidence behind ``related_groups``: each member with each key that it shares with another, ``relation, key, member``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), k.cast("string").alias("key")) for n, k in relations.items()])).alias("r")
    rows = df.select(each, F.col(member).alias("member")).select("r.relation", "r.key", "member").filter("key IS NOT NULL").distinct()
    several = rows.groupBy("relation", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(several, ["relation", "key"]).select("relation", "key", "member")


def related_groups(df: DataFrame, member: str, relations: dict[str, Column], version: Column | None = None) -> DataFrame:
    """Members that share a stated key under a relation, groups of two or more: ``relation, key, members, latest``."""
    out = None
    for name, key in relations.items():
        part = df.select(F.lit(name).alias("relation"), key.cast("string").alias("key"), F.col(member).alias("member"), (version if version is not None else F.lit(0)).alias("version"))
        out = part if out is None else out.unionByName(part)
    per = out.filter("key IS NOT NULL").groupBy("relation", "key", "member").agg(F.max("version").alias("version"))
    return per.groupBy("relation", "key").agg(F.count(F.lit(1)).alias("members"), F.max("version").alias("latest"), F.min("member").alias("first_member")).filter("members >= 2")


def manifests(df: DataFrame, key: str, pos: str, asset: str, declared: str | None = None) -> DataFrame:
    """Completeness of ordered sets: declared, held, missing, conflicting positions.

    What a set declares is the largest ``declared`` count of its rows, or its highest position where that is larger or none is stated.
    """
    stated = F.max(declared) if declared else F.lit(None).cast("int")
    per = df.filter(F.col(pos).isNotNull()).groupBy(key, pos).agg(F.count_distinct(asset).alias("claims"), stated.alias("stated"))
    m = per.groupBy(key).agg(F.greatest(F.max(pos), F.max("stated")).cast("int").alias("declared"), F.count(F.lit(1)).alias("held"), F.sum(F.when(F.col("claims") > 1, 1).otherwise(0)).alias("conflicts"))
    missing = F.col("declared") - F.col("held")
    return m.select(key, "declared", "held", missing.alias("missing"), "conflicts", ((missing == 0) & (F.col("conflicts") == 0)).alias("complete"))


def missing_positions(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Each position from 1 to the highest that is not held, from the gaps between neighbours: nothing is collected by key."""
    d = df.filter(F.col(pos) >= 1).select(key, F.col(pos).cast("int").alias("p")).distinct()
    before = F.coalesce(F.lag("p").over(Window.partitionBy(key).orderBy("p")), F.lit(0))
    g = d.withColumn("before", before).filter("p > before + 1")
    return g.select(key, F.explode(F.sequence(F.col("before") + 1, F.col("p") - 1)).alias("position"))


def ordered_identity(df: DataFrame, key: str, order: list[str], asset: str) -> DataFrame:
    """Digest of the ordered asset list of each key, and how many keys share it; ``order`` begins with the integer position.

    A key's list is hashed in buckets of positions (``structure.ordered_digest``), so no task lists a whole hot key.
    """
    from shelfmark.operators.structure import ordered_digest

    first, *ties = order
    ids = ordered_digest(df, [key], first, F.col(asset), [*ties, asset]).select(key, F.col("digest").alias("identity"))
    n = ids.groupBy("identity").agg(F.count(F.lit(1)).alias("sharing"))
    return ids.join(n, "identity").select(key, "identity", "sharing")


def conflicting_claims(df: DataFrame, key: list[str], claim: str) -> DataFrame:
    """Keys claimed by more than one value."""
    return df.groupBy(*key).agg(F.count_distinct(claim).alias("claims")).filter("claims > 1")


def decided(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value, unknown or ambiguous: by the distinct candidates of each key."""
    g = df.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    status = F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "value").otherwise("ambiguous")
    return g.select(key, status.alias("status"), F.when(F.col("n") == 1, F.col("v")).alias("value"))


def capped(df: DataFrame, key: str, value: str, priority: Column, cap: int) -> DataFrame:
    """The first ``cap`` distinct values of each key by priority, and how many were left out.

    The cap is the reported feature; the number left out is exact.
    """
    d = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(priority).alias("prio"))
    r = d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("prio", value)))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return r.withColumn("omitted", F.greatest(n - cap, F.lit(0))).filter(F.col("rank") <= cap).select(key, value, "rank", "omitted")


def merged_values(df: DataFrame, key: str, value: str, flag: Column) -> DataFrame:
    """Distinct values of each key, with whether any statement of one carries the flag: ``key, value, flagged``."""
    return df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("flagged"))


def capped_fields(df: DataFrame, key: str, field: str, value: str, line: str, per_field: int = 16, in_all: int = 64) -> DataFrame:
    """Distinct (field, value) pairs of each key in the order of their first statement, capped by field and in all.

    The caps are the reported feature; ``omitted`` is the exact number of pairs of the key that they leave out.
    """
    first = df.filter(F.col(field).isNotNull() & F.col(value).isNotNull()).groupBy(key, field, value).agg(F.min(line).alias("first_line"))
    own = F.row_number().over(Window.partitionBy(key, field).orderBy("first_line", value))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    r = first.withColumns({"_own": own, "_all": total}).filter(F.col("_own") <= per_field)
    r = r.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first_line", field, value))).withColumn("_in", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return r.filter(F.col("place") <= in_all).select(key, field, value, "place", (F.col("_all") - F.least("_in", F.lit(in_all))).alias("omitted"))


def tallies(df: DataFrame, column: str, buckets: dict[str, Column]) -> DataFrame:
    """How many rows fall into the first bucket that fits: ``bucket, n``."""
    name = F.lit("other")
    for b, test in reversed(buckets.items()):
        name = F.when(test, b).otherwise(name)
    return df.select(name.alias("bucket"), column).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def complete_sets(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Whether numbered parts are 1..n without gaps or repeats, and the first reason why not."""
    g = df.groupBy(key).agg(F.max(pos).cast("long").alias("top"), F.count_distinct(pos).alias("distinct_n"), F.count(F.lit(1)).alias("n"), F.min(pos).cast("long").alias("low"))
    reason = F.when(F.col("low") < 1, "bad_number").when(F.col("n") > F.col("distinct_n"), "repeated").when(F.col("top") > F.col("distinct_n"), "missing").otherwise("")
    return g.select(key, "n", reason.alias("reason"), (reason == "").alias("complete"))


def weighted_coverage(df: DataFrame, block: str, weight: str, hit: Column) -> DataFrame:
    """Share of the weight of distinct blocks that any record covers."""
    b = df.groupBy(block).agg(F.max(weight).alias("w"), F.bool_or(F.coalesce(hit, F.lit(False))).alias("h"))
    return b.agg(F.sum("w").alias("total"), F.sum(F.when(F.col("h"), F.col("w")).otherwise(0)).alias("covered"))
