"""Folds of append-only logs, and lookups along an order. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

#: Lines of a log that one task puts in order to follow its state.
BLOCK = 1 << 16


def latest_per_key(df: DataFrame, key: str, line: str) -> DataFrame:
    """The last line of each key with ``first_line``, its place of first appearance. One partial aggregation, no window."""
    rest = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(line)).alias("x"), F.min(line).alias("first_line"))
    return agg.select(key, "first_line", *[F.col(f"x.{c}").alias(c) for c in rest])


def mark_fold(df: DataFrame, key: str, line: str, event: str, save: str, note: str, delete: str) -> DataFrame:
    """The current mark of each key: the last save not deleted since, with the last note after it.

    Columns: ``key, saved_line, note_line`` (null without a note).
    """
    at = lambda e: F.max(F.when(F.col(event) == e, F.col(line)))
    last = df.groupBy(key).agg(at(save).alias("saved_line"), at(note).alias("n"), at(delete).alias("d"))
    live = last.filter("saved_line IS NOT NULL AND (d IS NULL OR d < saved_line)")
    return live.select(key, "saved_line", F.when(F.col("n") > F.col("saved_line"), F.col("n")).alias("note_line"))


def mark_log_fold(df: DataFrame, log: str, line: str, event: str, asset: str, mark: str) -> DataFrame:
    """Current marks of whole logs under their rules: ``log, asset, mark, saved_line, note_line, enabled, valid``.

    Events are enabled, disabled, save, note and delete. A log is valid if it begins with enabled, saves only while
    enabled, and notes and deletes only the mark that its asset has then. An asset has at most one mark: a save replaces
    it. ``enabled`` is the log's last state. A log that breaks a rule anywhere comes out as one row with nothing but
    ``valid`` false; a valid log without marks as one row without an asset.

    The rows are written once, so whatever makes them runs once, and no task sorts a whole log: the state that saves need is
    followed in blocks of lines, from block to block by one row for each, and the marks asset by asset.
    """
    rows = cut(df.select(log, line, event, asset, mark))
    e = F.col(event)
    on = F.when(e == "enabled", True).when(e == "disabled", False)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lines = rows.select(log, line, event, F.expr(f"`{line}` div {BLOCK}").alias("_block"))
    lines = lines.withColumn("_on", F.last(on, True).over(before(Window.partitionBy(log, "_block").orderBy(line))))
    # a save before the first change of its block needs the state with which the block begins
    rule = F.when(e == "save", F.coalesce("_on", F.lit(True))).otherwise(F.coalesce(e.isin("enabled", "disabled", "note", "delete"), F.lit(False)))
    blocks = lines.groupBy(log, "_block").agg(F.bool_and(rule).alias("_ok"), F.bool_or((e == "save") & F.col("_on").isNull()).alias("_open"), F.min_by(F.coalesce(e == "enabled", F.lit(False)), line).alias("_first"),
                                              F.max_by(on, F.when(on.isNotNull(), F.col(line))).alias("_last"))
    in_log = Window.partitionBy(log).orderBy("_block")
    begins = F.coalesce(F.last("_last", True).over(before(in_log)), F.lit(False))
    ok = F.col("_ok") & (~F.coalesce("_open", F.lit(False)) | begins) & ((F.row_number().over(in_log) > 1) | F.col("_first"))
    of_blocks = blocks.select(log, ok.alias("_ok"), F.when(F.col("_last").isNotNull(), F.col("_block")).alias("_block"), "_last")
    # the mark an asset has before an event: that of the last save or delete before it, a delete leaving none
    last = F.last(F.when(e.isin("save", "delete"), F.struct(F.when(e == "save", F.col(mark)).alias("m"))), True).over(before(Window.partitionBy(log, asset).orderBy(line)))
    at = lambda *names: F.max(F.when(e.isin(*names), F.col(line)))
    per = rows.filter(e.isin("save", "note", "delete")).withColumn("_has", (e == "save") | F.coalesce(last["m"] == F.col(mark), F.lit(False))).groupBy(log, asset).agg(
        F.bool_and("_has").alias("_ok"), at("save").alias("saved_line"), at("note").alias("_n"), at("delete").alias("_d"), F.max_by(mark, F.when(e == "save", F.col(line))).alias(mark))
    per = cut(per)
    of_assets = per.select(log, "_ok", F.lit(None).cast("long").alias("_block"), F.lit(None).cast("boolean").alias("_last"))
    logs = of_blocks.unionByName(of_assets).groupBy(log).agg(F.bool_and("_ok").alias("valid"), F.max_by("_last", "_block").alias("_last"))
    logs = logs.select(F.col(log).alias("_log"), F.when(F.col("valid"), F.col("_last")).alias("enabled"), "valid")
    live = per.filter("_d IS NULL OR _d < saved_line").select(log, asset, mark, "saved_line", F.when(F.col("_n") > F.col("saved_line"), F.col("_n")).alias("note_line"))
    joined = logs.join(live, F.col("valid") & (F.col("_log") == F.col(log)), "left")
    return joined.select(F.col("_log").alias(log), asset, mark, "saved_line", "note_line", "enabled", "valid")


def job_fold(df: DataFrame, key: str, line: str, at: str, event: str, terminal: list[str]) -> DataFrame:
    """State of each job: the first terminal event sticks, else the last event. ``key, status, updated_line, n_events``."""
    done = F.col(event).isin(*terminal)
    first_done = F.min(F.when(done, F.struct(F.col(line), F.col(event), F.col(at))))
    last = F.max(F.struct(F.col(line), F.col(event), F.col(at)))
    s = df.groupBy(key).agg(F.coalesce(first_done, last).alias("x"), F.count(F.lit(1)).alias("n_events"), F.min(at).alias("created"))
    return s.select(key, F.col(f"x.{event}").alias("status"), F.col(f"x.{line}").alias("updated_line"), F.col(f"x.{at}").alias("updated"), "created", "n_events")


def active_declarations(df: DataFrame, key: str, line: str, event: str, declared: str, retracted: str) -> DataFrame:
    """Whether each declaration stands: by its last declared or retracted event."""
    e = df.filter(F.col(event).isin(declared, retracted))
    return e.groupBy(key).agg((F.max_by(event, line) == declared).alias("active"), F.count(F.lit(1)).alias("n_events"))


def declaration_digests(df: DataFrame, key: str, line: str, event: str, declared: str, retracted: str) -> DataFrame:
    """Digest of each declaration's events in the order of their lines, which an append must name: ``key, digest, n``."""
    from shelfmark.operators.structure import ordered_digest

    e = df.filter(F.col(event).isin(declared, retracted))
    return ordered_digest(e, [key], line, F.concat_ws(" ", F.col(line).cast("string"), F.col(event)))


def open_operations(df: DataFrame, key: str, line: str, event: str, start: str, finish: str) -> DataFrame:
    """Keys whose last start has no finish after it: ``key, open_line``."""
    at = lambda e: F.max(F.when(F.col(event) == e, F.col(line)))
    s = df.groupBy(key).agg(at(start).alias("open_line"), at(finish).alias("f"))
    return s.filter("open_line IS NOT NULL AND (f IS NULL OR f < open_line)").select(key, "open_line")


def pair_check(df: DataFrame, key: str, line: str, value: Column) -> DataFrame:
    """Each line beside the one before it of its key: ``line, same`` (null on the first)."""
    w = Window.partitionBy(key).orderBy(line)
    return df.select(key, line, (F.lag(value).over(w) == value).alias("same"))


def running_start(df: DataFrame, key: str, pos: str, size: str) -> DataFrame:
    """Start of each part: the sizes before it, null from the first unknown size or missing position on."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    ok = F.coalesce(F.min(F.when(F.col(size).isNull(), 0).otherwise(1)).over(before), F.lit(1)) == 1
    return df.withColumn("start", F.when(ok & (n == F.col(pos)), F.coalesce(F.sum(size).over(before), F.lit(0))))


def next_starts(df: DataFrame, key: str, start: str, last_end: str, ties: str) -> DataFrame:
    """End of each section: the next start if it lies after the own one; of the last the declared end if later, else its own start."""
    w = Window.partitionBy(key).orderBy(start, ties)
    nxt = F.lead(start).over(w)
    status = F.when(nxt.isNull(), "end_of_source").when(nxt > F.col(start), "bounded").otherwise("not_after_start")
    end = F.when(nxt.isNull(), F.greatest(start, F.coalesce(last_end, start))).when(nxt > F.col(start), nxt)
    return df.withColumns({"status": status, "end": end})


def boundaries(df: DataFrame, key: str, pos: str, is_boundary: Column) -> DataFrame:
    """The boundary at or before each place and the one at or after it."""
    w = Window.partitionBy(key).orderBy(pos)
    mark = F.when(is_boundary, F.col(pos))
    return df.withColumns({
        "previous": F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first(mark, True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "second_previous": F.max(mark).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last mark of the key at or before each point: one window over both, no range join."""
    cols = [c for c in points.columns if c not in (key, at)]
    p = points.select(key, at, F.struct(*cols).alias("p"), F.lit(None).cast(marks.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    m = marks.select(key, at, F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.col(value).alias("v"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(m).withColumn("found", F.last(F.when(F.col("side") == 0, F.struct(F.col(at).alias("mark_at"), F.col("v").alias(value))), True).over(w))
    return both.filter("side = 1").select(key, at, "p.*", "found.mark_at", F.col(f"found.{value}").alias(value))


def covering(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """Spans that cover each point: joined on bins of the power of two above the length of the span, then compared exactly.

    A span lies in at most two bins of its level, however long it is; a point in one bin of each level there is (at most 64).
    """
    length = F.col(end).cast("long") - F.col(start).cast("long")
    s = spans.filter(F.col(end) > F.col(start)).withColumn("_level", (F.length(F.bin(length)) - 1).cast("int"))
    levels = [r[0] for r in s.select("_level").distinct().collect()]  # at most 64 numbers
    first, last = (F.expr(f"shiftright(CAST({c} AS BIGINT), _level + 1)") for c in (f"`{start}`", f"`{end}` - 1"))
    s = s.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", F.expr(f"shiftright(CAST(`{at}` AS BIGINT), _level + 1)"))
    j = p.join(s.select(key, "_level", "_bin", start, end, *keep), [key, "_level", "_bin"])
    return j.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")
