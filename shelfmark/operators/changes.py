"""Changes as plans: what would be done, bound to a digest, applied by appending new rows only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import col, detected_format
from shelfmark.session import cut

#: Review reasons that another look can settle (fixed values).
RESCANNABLE = ("scanner_unavailable", "scanner_failed", "scan_incomplete")


def scan_reason(status: Column | str) -> Column:
    """Reason of a review by the scanner's status; null where the file is clean."""
    s = col(status)
    return F.when(s == "clean", F.lit(None).cast("string")).when(s == "unavailable", "scanner_unavailable").when(s == "failed", "scanner_failed").when(s == "found", "threat_found").otherwise("scan_incomplete")


def classify(report: DataFrame, checks: Column, scan: Column) -> DataFrame:
    """Status and reason of each assessed file: checks first, then the scanner; ``checks`` is a status, ``scan`` the scanner's."""
    reason = (F.when(checks == "incomplete", "checks_incomplete").when(checks == "invalid_or_unsupported", "invalid_or_unsupported")
              .when(checks == "needs_review", "findings").otherwise(scan_reason(scan)))
    return report.withColumns({"reason": reason, "status": F.when(reason.isNull(), "checked").otherwise("review")})


def assess(files: DataFrame, expected_bytes: str, expected_sha256: str, expected_format: str) -> DataFrame:
    """Size, digest and format of ``content`` against what was stated, with every finding and a status."""
    fmt = detected_format("content")
    tests = {
        "empty": F.octet_length("content") == 0, "size_differs": F.octet_length("content") != F.col(expected_bytes),
        "digest_differs": F.sha2("content", 256) != F.col(expected_sha256), "format_differs": fmt != F.col(expected_format), "format_unknown": fmt == "unknown",
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    status = (F.when(F.col("content").isNull(), "incomplete").when(F.arrays_overlap(found, F.array(F.lit("format_unknown"), F.lit("empty"))), "invalid_or_unsupported")
              .when(F.size(found) > 0, "needs_review").otherwise("limited_checks_passed"))
    return files.withColumns({"detected_format": fmt, "findings": found, "status": status})


def stored_agrees(content: str, size: str, digest: str) -> Column:
    return (F.octet_length(content) == F.col(size)) & (F.sha2(F.col(content), 256) == F.col(digest))


def scanner_statuses(lines: DataFrame, line: str) -> DataFrame:
    """Per-file statuses of a scanner's text output: ``file, status, threat``."""
    name, rest = F.regexp_extract(line, r"^(.*): ([^:]*)$", 1), F.regexp_extract(line, r"^(.*): ([^:]*)$", 2)
    status = F.when(rest == "OK", "clean").when(rest.endswith(" FOUND"), "found").when(rest.endswith("ERROR"), "failed").otherwise("incomplete")
    threat = F.when(status == "found", F.regexp_replace(rest, " FOUND$", ""))
    return lines.filter(name != "").select(name.alias("file"), status.alias("status"), threat.alias("threat"))


def eligible(files: DataFrame, item: str, order: str, rule: Column, most: int = 10) -> DataFrame:
    """The first ``most`` offered files of each item that the rule lets through, in source order (the number is the feature)."""
    from pyspark.sql import Window

    ok = files.filter(rule)
    return ok.withColumn("choice", F.row_number().over(Window.partitionBy(item).orderBy(order))).filter(F.col("choice") <= most)


def rescan_plan(holdings: DataFrame, key: str) -> DataFrame:
    """Holdings under review for a reason that another look can settle."""
    return holdings.filter((F.col("status") == "review") & F.col("reason").isin(*RESCANNABLE)).select(key, "reason")


def purge_plan(held_files: DataFrame, holdings: DataFrame, entry: str, digest: str) -> DataFrame:
    """Entries of a cleanup all of whose files are still held and verified: ``entry, files, purge``."""
    h = holdings.groupBy(digest).agg(F.bool_and("verified").alias("ok"))
    j = held_files.join(h, digest, "left")
    return j.groupBy(entry).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("purge"))


#: Digests that one task sorts and hashes, on average at most.
DIGESTS_A_BUCKET = 2_048


def plan_digest(plan: DataFrame) -> Column:
    """SHA-256 of each row of a plan as JSON with sorted keys, nulls written out; rows are hashed where they lie."""
    return F.sha2(F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"}), 256)


def digest_of(plan: DataFrame) -> str:
    """SHA-256 of a whole plan, whatever the order of its rows; a row that stands n times is named once with n.

    The sorted digests of the rows are hashed in buckets by their first digits, then the buckets' digests in order; how many
    digits depends on the number of different rows alone. No task gets all of them.
    """
    rows = cut(plan.select(plan_digest(plan).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")))
    digits, left = 0, rows.count()
    while left > DIGESTS_A_BUCKET:
        digits, left = digits + 1, left // 16
    level = rows.select("d", F.concat("d", F.lit(" "), F.col("n").cast("string")).alias("line"))
    while True:
        lines = F.concat_ws("\n", F.array_sort(F.collect_list("line")))
        level = level.groupBy(F.substring("d", 1, digits).alias("d")).agg(F.sha2(lines, 256).alias("h"))
        if digits == 0:
            found = level.first()
            return found["h"] if found else hashlib.sha256(b"").hexdigest()
        level = level.select("d", F.concat("d", F.lit(" "), "h").alias("line"))
        digits = max(0, digits - 2)


def apply_events(log: DataFrame, planned: DataFrame, expected: str) -> DataFrame:
    """Rows to append for a plan: refused if the plan isn't the one that was confirmed; already present rows are left out."""
    if digest_of(planned) != expected:
        raise ValueError("the plan has changed since it was confirmed")
    return planned.exceptAll(log.select(*planned.columns).intersectAll(planned))


def append_absent(log: DataFrame, planned: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows whose key the log does not hold, each key once (the least row), as they would be appended."""
    rest = [c for c in planned.columns if c not in key]
    new = planned.join(log.select(*key).distinct(), key, "left_anti")
    return new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x")).select(*key, "x.*") if rest else new.distinct()


def roll_forward(log: DataFrame, operation: str, line: str, event: str, start: str, finish: str, payload: list[str]) -> DataFrame:
    """Rows that finish what an interruption left open: for each operation whose last start has no finish after it, a finish
    with the payload of that start. ``operation, line (that of the start), event, payload``."""
    last = log.filter(F.col(event).isin(start, finish)).groupBy(operation).agg(F.max_by(F.struct(line, event, *payload), F.col(line)).alias("x"))
    return last.filter(F.col(f"x.{event}") == start).select(operation, f"x.{line}", F.lit(finish).alias(event), *[f"x.{p}" for p in payload])


def merge_sources(current: DataFrame, incoming: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """Union of provenance by key where what is missing is filled in and nothing is replaced."""
    i = incoming.select(*key, *[F.col(c).alias(f"_{c}") for c in fill])
    return current.join(i, key, "full_outer").select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in fill])


def retention(jobs: DataFrame, updated: str, now: Column, days: int = 30) -> DataFrame:
    """Jobs with whether they are past the age at which finished ones are removed."""
    return jobs.withColumn("past_retention_age", F.col(updated) < now - F.make_dt_interval(F.lit(days)))
