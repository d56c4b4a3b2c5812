"""Comparisons of two relations: status, difference, audit, reconciliation, upsert plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same for each key of two selections."""
    b = before.select(key, F.col(value).alias("before"), F.lit(1).alias("b"))
    a = after.select(key, F.col(value).alias("after"), F.lit(1).alias("a"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return j.select(key, change.alias("change"))


def retained_order(before: DataFrame, after: DataFrame, group: str, key: str, pos: str) -> DataFrame:
    """Keys of both selections of a group whose place among the retained ones differs."""
    both = before.select(group, key, F.col(pos).alias("p1")).join(after.select(group, key, F.col(pos).alias("p2")), [group, key])
    n = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(c, key))
    return both.select(group, key, n("p1").alias("before_at"), n("p2").alias("after_at")).filter("before_at != after_at")


def audit(baseline: DataFrame, current: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """A snapshot against what is there now: missing, unverified, changed, added or unchanged."""
    b = baseline.select(key, F.col(size).alias("s1"), F.col(digest).alias("d1"), F.lit(1).alias("b"))
    c = current.select(key, F.col(size).alias("s2"), F.col(digest).alias("d2"), F.lit(1).alias("c"))
    j = b.join(c, key, "full_outer")
    status = (F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "added").when(F.col("s1") != F.col("s2"), "changed")
              .when(F.col("d1").isNull() | F.col("d2").isNull(), "unverified").when(F.col("d1") != F.col("d2"), "changed").otherwise("unchanged"))
    return j.select(key, status.alias("status"))


def key_check(declared: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Declared keys that are not stored, stored keys that are not declared: ``kind, key``."""
    d, s = declared.select(key).distinct(), stored.select(key).distinct()
    missing = d.join(s, key, "left_anti").select(F.lit("missing").alias("kind"), key)
    return missing.unionByName(s.join(d, key, "left_anti").select(F.lit("untracked").alias("kind"), key))


def item_status(items: DataFrame, held: DataFrame, key: str, declared: str, part: str) -> DataFrame:
    """Status of each item by the parts held for it: complete, partial or missing."""
    h = held.groupBy(key).agg(F.count_distinct(part).alias("held"))
    j = items.join(h, key, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    status = F.when(F.col("held") == 0, "missing").when(F.col("held") < F.col(declared), "partial").otherwise("complete")
    return j.select(key, declared, "held", status.alias("status"))


def ordered_band(left: DataFrame, right: DataFrame, key: str, order: list[str], value: str, band: float) -> DataFrame:
    """Whether two ordered lists of a key agree: equal length and each pair within ``band``. All or nothing for a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    a = left.select(key, n.alias("n"), F.col(value).alias("x"))
    b = right.select(key, n.alias("n"), F.col(value).alias("y"))
    keys = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
    j = a.join(b, [key, "n"], "full_outer").join(keys, key, "left_semi")
    ok = F.coalesce(F.abs(F.col("x") - F.col("y")) <= band, F.lit(False))
    return j.groupBy(key).agg(F.bool_and(ok).alias("matched"), F.count(F.lit(1)).alias("pairs"))


def reconcile(events: DataFrame, current: DataFrame, key: str, line: str, value: str) -> DataFrame:
    """The latest event of each key against the current record: consistent, stale, no_record or no_event."""
    e = events.groupBy(key).agg(F.max_by(value, line).alias("v1"), F.lit(1).alias("e"))
    c = current.select(key, F.col(value).alias("v2"), F.lit(1).alias("c"))
    status = F.when(F.col("c").isNull(), "no_record").when(F.col("e").isNull(), "no_event").when(F.col("v1").eqNullSafe(F.col("v2")), "consistent").otherwise("stale")
    return e.join(c, key, "full_outer").select(key, status.alias("status"))


def all_held(members: DataFrame, held: DataFrame, group: str, key: str) -> DataFrame:
    """Groups whose every member is held (relational division)."""
    h = held.select(key).distinct().withColumn("h", F.lit(True))
    j = members.join(h, key, "left")
    return j.groupBy(group).agg(F.bool_and(F.coalesce("h", F.lit(False))).alias("all_held"), F.count(F.lit(1)).alias("members"))


def upsert_plan(current: DataFrame, incoming: DataFrame, key: str, place: str, note: str, replace: bool) -> DataFrame:
    """What an import does with each key: add, keep, same, note_only, replace or conflict."""
    c = current.select(key, F.col(place).alias("p1"), F.col(note).alias("n1"), F.lit(1).alias("c"))
    i = incoming.select(key, F.col(place).alias("p2"), F.col(note).alias("n2"), F.lit(1).alias("i"))
    same_place = F.col("p1").eqNullSafe(F.col("p2"))
    action = (F.when(F.col("i").isNull(), "keep").when(F.col("c").isNull(), "add").when(same_place & F.col("n1").eqNullSafe(F.col("n2")), "same")
              .when(same_place, "note_only").otherwise("replace" if replace else "conflict"))
    return c.join(i, key, "full_outer").select(key, action.alias("action"))


def positional_conflicts(a: DataFrame, b: DataFrame, group: str, pos: str, cols: list[str]) -> DataFrame:
    """Whether two ordered lists of a group differ in any place."""
    x = a.select(group, pos, F.struct(*cols).alias("x"))
    y = b.select(group, pos, F.struct(*cols).alias("y"))
    return x.join(y, [group, pos], "full_outer").groupBy(group).agg(F.bool_or(~F.col("x").eqNullSafe(F.col("y"))).alias("conflict"))


def decide(held: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """Held state by target state: restore, already_there, occupied, or unknown to the held side."""
    h = held.select(key, F.col(digest).alias("h"))
    t = target.select(key, F.col(digest).alias("t"))
    d = F.when(F.col("h").isNull(), "not_held").when(F.col("t").isNull(), "restore").when(F.col("h") == F.col("t"), "already_there").otherwise("occupied")
    return h.join(t, key, "full_outer").select(key, d.alias("disposition"))


def folder_plan(entries: DataFrame, holdings: DataFrame, path: str, digest: str, size: str) -> DataFrame:
    """What is done with each entry of a folder, by the first reason that applies: keep or move, and why."""
    held = holdings.select(digest).distinct().withColumn("h", F.lit(True))
    clash = F.count(F.lit(1)).over(Window.partitionBy(F.lower(path))) > 1
    j = entries.withColumn("clash", clash).join(held, digest, "left")
    reason = (F.when(F.col(digest).isNull(), "no_digest").when(F.col(size) == 0, "empty").when(F.col("clash"), "name_clash")
              .when(F.col("h").isNull(), "not_held").otherwise("held"))
    return j.select(path, reason.alias("reason"), F.when(reason == "held", "move").otherwise("keep").alias("action"))


def inherit(df: DataFrame, key: str, name: str, original: str, value: str) -> DataFrame:
    """Rows derived from another row of their key inherit its value where they have none."""
    o = df.select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(value).alias("inherited"))
    j = df.join(o, (df[key] == o["_k"]) & (df[original] == o["_n"]), "left")
    return j.withColumn(value, F.coalesce(F.col(value), F.col("inherited"))).drop("_k", "_n", "inherited")


def domain_check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break (an empty array: valid)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", broken)
