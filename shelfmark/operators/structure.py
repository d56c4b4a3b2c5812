"""Structure of documents: entries and their ranges, links and their targets, chains of parents, parts of a range."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

#: Rounds in which on_cycle sheds nodes without a way in or out, to save work; the result does not depend on it.
PRUNE_ROUNDS = 64


def _reach(edges: DataFrame) -> DataFrame:
    """Every way in a graph: ``doc, node, at, distance`` (the least number of edges, 1 or more), for edges ``doc, node, at``.

    The distances known double each round, until no way is new: a shortest way of up to ``2 * half`` edges leads over a node ``half`` edges away.
    """
    out, half = cut(edges.distinct().withColumn("distance", F.lit(1))), 1
    while True:
        far = out.filter(F.col("distance") == half).select("doc", "node", F.col("at").alias("via"))
        on = out.select("doc", F.col("node").alias("via"), "at", F.col("distance").alias("more"))
        new = far.join(on, ["doc", "via"]).groupBy("doc", "node", "at").agg((F.min("more") + half).cast("int").alias("distance"))
        new = cut(new.join(out, ["doc", "node", "at"], "left_anti"))
        if new.isEmpty():
            return out
        out, half = out.unionByName(new), 2 * half


def ancestors(df: DataFrame, doc: str, node: str, parent: str) -> DataFrame:
    """Every ancestor of every node, however deep: ``doc, node, ancestor, distance``."""
    edges = df.select(F.col(doc).alias("doc"), F.col(node).alias("node"), F.col(parent).alias("at")).filter("at IS NOT NULL AND at != 0")
    out = _reach(edges).filter("distance = 1 OR node != at")
    return out.select(F.col("doc").alias(doc), F.col("node").alias(node), F.col("at").alias("ancestor"), "distance")


def entry_ranges(df: DataFrame, doc: str, order: str, parent: str, place: list[str], resolved: Column) -> DataFrame:
    """End of each entry's range: the place of the next entry that is not below it.

    Entries are numbered 1..n in reading order, so the entries below one follow
    it directly; their number gives the next one. Statuses: bounded,
    end_of_source, unresolved (own or next target unknown), not_after_start.
    """
    below = ancestors(df, doc, order, parent).groupBy(doc, F.col("ancestor").alias(order)).agg(F.count(F.lit(1)).alias("below"))
    j = df.join(below, [doc, order], "left").withColumn("nxt", F.col(order) + F.coalesce("below", F.lit(0)) + 1)
    ends = df.select(F.col(doc).alias(doc), F.col(order).alias("nxt"), F.struct(*place).alias("end"), resolved.alias("end_ok"))
    r = j.withColumn("own_ok", resolved).join(ends, [doc, "nxt"], "left")
    start = F.struct(*place)
    status = (F.when(~F.col("own_ok"), "unresolved").when(F.col("end_ok").isNull(), "end_of_source").when(~F.col("end_ok"), "unresolved")
              .when(F.col("end") > start, "bounded").otherwise("not_after_start"))
    return r.select(*df.columns, status.alias("status"), F.when(status == "bounded", F.col("end")).alias("end"))


def resolve_links(links: DataFrame, members: DataFrame, targets: DataFrame, doc: str) -> DataFrame:
    """Target of each link: ``links`` have ``member, fragment``; ``members`` have ``member, unit``; ``targets`` have ``unit, fragment, offset``.

    Statuses: resolved, missing_member, missing_fragment, ambiguous_fragment.
    """
    m = members.select(doc, "member", "unit")
    t = targets.groupBy(doc, "unit", "fragment").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n"))
    j = links.join(m, [doc, "member"], "left").join(t, [doc, "unit", "fragment"], "left")
    status = (F.when(F.col("unit").isNull(), "missing_member").when(F.col("fragment") == "", "resolved").when(F.col("n").isNull(), "missing_fragment")
              .when(F.col("n") > 1, "ambiguous_fragment").otherwise("resolved"))
    ok = status == "resolved"
    return j.select(*links.columns, F.when(ok, F.col("unit")).alias("unit"), F.when(ok, F.coalesce("offset", F.lit(0))).alias("offset"), status.alias("status"))


def resolve_hrefs(links: DataFrame, members: DataFrame, targets: DataFrame, doc: str) -> DataFrame:
    """Target of each link as written: ``links`` have ``base`` (the member it stands in) and ``href``; else as ``resolve_links``.

    Statuses besides those of ``resolve_links``: external, invalid, unlinked (no href at all).
    """
    from shelfmark.functions.codecs import resolve_href_udf

    r = links.withColumn("_r", resolve_href_udf("base", F.coalesce("href", F.lit(""))))
    own = F.when(F.col("href").isNull(), "unlinked").when(F.col("_r.status") != "internal", F.col("_r.status"))
    r = r.withColumns({"_own": own, "member": F.when(own.isNull(), F.col("_r.member")), "fragment": F.when(own.isNull(), F.col("_r.fragment"))}).drop("_r")
    j = resolve_links(r, members, targets, doc)
    status = F.coalesce("_own", "status")
    return j.select(*links.columns, "unit", "offset", status.alias("status"))


def entry_text(ranges: DataFrame, units: DataFrame, doc: str) -> DataFrame:
    """The text of each entry's range in every unit it touches: ``ranges`` have ``entry, unit, offset, end_unit, end_offset``
    (null: to the end of the source), ``units`` have ``unit, text``. One row for each entry and unit, in bytes cut at characters.

    Joined by document; a unit outside the range is dropped at once, so an entry costs the units it covers.
    """
    r = ranges.select(doc, "entry", F.col("unit").alias("from_unit"), F.col("offset").alias("from_at"), "end_unit", "end_offset")
    j = r.join(units.select(doc, "unit", F.encode("text", "UTF-8").alias("_raw")), doc).filter(
        (F.col("unit") >= F.col("from_unit")) & (F.col("end_unit").isNull() | (F.col("unit") < F.col("end_unit")) | ((F.col("unit") == F.col("end_unit")) & (F.col("end_offset") > 0))))
    start = F.when(F.col("unit") == F.col("from_unit"), F.col("from_at")).otherwise(0).cast("int")
    end = F.when(F.col("unit") == F.col("end_unit"), F.col("end_offset")).otherwise(F.octet_length("_raw")).cast("int")
    return j.select(doc, "entry", "unit", start.alias("start"), end.alias("end"), F.decode(F.substring("_raw", start + 1, F.greatest(end - start, F.lit(0))), "UTF-8").alias("text"))


def resolve_images(images: DataFrame, members: DataFrame, doc: str) -> DataFrame:
    """Images of documents beside the members they name: ``images`` have ``base`` (the member that shows them) and ``src``.

    Statuses: local_resource, missing_member, external, invalid.
    """
    from shelfmark.functions.codecs import resolve_href_udf

    r = images.withColumn("_r", resolve_href_udf("base", "src"))
    r = r.withColumn("_member", F.when(F.col("_r.status") == "internal", F.col("_r.member")))
    m = members.select(doc, F.col("member").alias("_member"), "bytes", "sha256", F.lit(True).alias("_there"))
    j = r.join(m, [doc, "_member"], "left")
    status = F.when(F.col("_r.status") != "internal", F.col("_r.status")).when(F.col("_there").isNull(), "missing_member").otherwise("local_resource")
    return j.select(*images.columns, status.alias("status"), F.when(F.col("_there"), F.col("_member")).alias("member"), F.col("bytes").alias("image_bytes"), F.col("sha256").alias("image_sha256"))


def bind_references(parts: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``parts`` with ``reference``, the position token of ``fields`` (sorted by name, nulls left out)."""
    from shelfmark.functions.codecs import encoded

    return parts.withColumn("reference", encoded(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))))


#: Units that one task lists to hash them.
UNITS_A_BUCKET = 4_096


def ordered_digest(df: DataFrame, keys: list[str], pos: str, value: Column, ties: list[str] | None = None) -> DataFrame:
    """SHA-256 of the values of each key in the order of the integer ``pos`` (from 0), then of ``ties`` and value: ``keys, digest, n``.

    Values are joined by line feeds and hashed; above ``UNITS_A_BUCKET`` positions, the digests of as many positions each are
    what is joined and hashed, and so on. Where positions repeat so often that a bucket would hold more values than that,
    equal values are named once with their number, and buckets are divided by the first digits of the values' digests; how
    far, depends on the data alone. So no task lists a hot key.
    """
    own = [f"_t{k}" for k in range(len(ties or []))]
    items = F.transform(F.array_sort(F.collect_list(F.struct("_p", *own, "_v"))), lambda x: x["_v"])
    rows = df.select(*keys, F.col(pos).cast("long").alias("_p"), *[F.col(t).alias(o) for t, o in zip(ties or [], own)], value.cast("string").alias("_v"))
    bucket = F.floor(F.col("_p") / UNITS_A_BUCKET)
    most = rows.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("c"), F.max("_b").alias("b")).first()
    digits, left = 0, most["c"] or 0
    while left > UNITS_A_BUCKET:
        digits, left = digits + 1, left // 16
    if not digits and not most["b"]:  # every key has one bucket
        hashed = rows.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", items), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
        return hashed.select(*keys, "digest", "n")
    rows = rows.withColumn("_n", F.lit(1).cast("long"))
    if digits:
        rows = rows.groupBy(*keys, "_p", *own, "_v").agg(F.sum("_n").alias("_n")).withColumn("_v", F.concat_ws("\t", "_v", F.col("_n").cast("string")))
        bucket = bucket * 16**digits + F.conv(F.substring(F.sha2("_v", 256), 1, digits), 16, 10).cast("long")
    level = cut(rows.groupBy(*keys, bucket.alias("_p")).agg(F.sha2(F.concat_ws("\n", items), 256).alias("_v"), F.sum("_n").alias("_n")))
    several = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*keys)
    # a key of one bucket has its digest; the bucket digests of the others are hashed in turn
    done = level.join(several, keys, "left_anti").select(*keys, F.col("_v").alias("digest"), F.col("_n").alias("n"))
    rest = level.join(several, keys, "left_semi")
    upper = ordered_digest(rest, keys, "_p", F.col("_v")).drop("n").join(rest.groupBy(*keys).agg(F.sum("_n").alias("n")), keys)
    return done.unionByName(upper)


def unit_views(units: DataFrame, doc: str, index: str, text: str, gaps: Column) -> DataFrame:
    """The identity of each document's text: ``doc, representation, units, bytes, with_gaps``.

    It is the digest of its units in order, each given by its place, the digest of its text and its number of gaps; texts
    are hashed where they lie. A unit without text (null) is unsupported and counts as such.
    """
    n = F.coalesce(gaps, F.lit(0))
    state = F.when(F.col(text).isNull(), "unsupported").when(n > 0, "text_with_gaps").otherwise("text")
    line = F.concat_ws(" ", F.col(index).cast("string"), state, F.coalesce(F.sha2(text, 256), F.lit("-")), n.cast("string"))
    rows = units.select(doc, index, line.alias("_line"), F.octet_length(text).cast("long").alias("_bytes"), (state == "text_with_gaps").cast("long").alias("_gaps"))
    sums = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"), F.sum("_gaps").alias("with_gaps"))
    return ordered_digest(rows, [doc], index, F.col("_line")).select(doc, F.col("digest").alias("representation")).join(sums, doc)


def frame_range(frames: DataFrame, requests: DataFrame, key: str, no: str, at: str, length: str, need: str, have: str, history: int = 1, most_preroll: int = 64) -> DataFrame:
    """Whole, contiguous frames from a requested one on, and the frames before it that a decoder needs.

    ``frames`` are numbered from 0 without gaps, with their place, length, the bytes they borrow from earlier frames
    (``need``) and those they lend (``have``). ``requests`` have ``key, first, max_bytes``. A range stops before a gap and
    within the bytes allowed, the preroll counted; it holds the first frame in any case (``status`` too_small if that is too
    much). Preroll: the frames that lend what the first frame and its ``history`` frames before borrow, at most
    ``most_preroll`` each; incomplete across a gap, except at the very beginning, where nothing more exists.

    Columns: ``key, first, preroll, last, byte_start, byte_end, complete, stopped_at_gap, end_of_track, status``.
    """
    w = Window.partitionBy(key).orderBy(no)
    gap = F.coalesce((F.lag(F.col(at) + F.col(length)).over(w) != F.col(at)).cast("int"), F.lit(0))
    f = frames.select(key, F.col(no).alias("no"), F.col(at).alias("at"), F.col(length).alias("len"), F.col(need).alias("need"), F.col(have).alias("have"), gap.alias("gap"))
    f = f.withColumns({"run": F.sum("gap").over(w), "lent": F.sum("have").over(w), "size": F.sum("len").over(w), "count": F.count(F.lit(1)).over(Window.partitionBy(key))})
    r = requests.select(key, "first", "max_bytes")
    start = r.join(f.select(key, F.col("no").alias("first"), F.col("run").alias("own_run"), F.col("size").alias("own_size"), F.col("len").alias("own_len"), "count"), [key, "first"])
    # what the first frame and each of its history borrow: frames of the run before them, nearest first, until it is covered
    back = start.withColumn("k_", F.explode(F.array(*map(F.lit, range(history + 1))))).withColumn("no", F.col("first") - F.col("k_")).filter("no >= 0")
    back = back.select(key, "first", "k_", "own_run", "no").join(f.select(key, "no", "run", "need", "lent", "have"), [key, "no"])
    target = back.select(key, "first", "k_", "own_run", F.col("run").alias("t_run"), F.col("no").alias("t_no"), F.col("need").alias("t_need"), (F.col("lent") - F.col("have")).alias("t_before"))
    lenders = f.select(key, F.col("no").alias("j"), F.col("run").alias("j_run"), (F.col("lent") - F.col("have")).alias("j_before"), F.col("lent").alias("j_lent"))
    near = (F.col("j") < F.col("t_no")) & (F.col("j") >= F.col("t_no") - most_preroll)
    j = target.join(lenders.withColumnRenamed("j_run", "t_run"), [key, "t_run"])
    used = F.sum(F.when(near & (F.col("t_before") - F.col("j_lent") < F.col("t_need")), 1).otherwise(0))
    depth = j.groupBy(key, "first", "k_", "own_run", "t_run", "t_no", "t_need").agg(
        used.alias("n"), F.coalesce(F.max(F.when(near, F.col("t_before") - F.col("j_before"))), F.lit(0)).alias("got"), F.min(F.when(near, F.col("j"))).alias("furthest"))
    # a frame of the history in another run is behind a gap; at the very beginning nothing more can be had
    same = F.col("t_run") == F.col("own_run")
    covered = (F.col("t_need") <= F.col("got")) | (F.coalesce(F.col("furthest"), F.col("t_no")) == 0)
    pre = depth.groupBy(key, "first").agg(F.max(F.when(same, F.col("n") + F.col("k_"))).cast("int").alias("preroll"), F.bool_and(same & covered).alias("complete"))
    s = start.join(pre, [key, "first"])
    begin = f.select(key, F.col("no").alias("p_no"), F.col("at").alias("byte_start"), (F.col("size") - F.col("len")).alias("before_size"))
    s = s.withColumn("p_no", F.col("first") - F.col("preroll")).join(begin, [key, "p_no"])
    on = f.select(key, F.col("no").alias("last"), F.col("run").alias("own_run"), F.col("size").alias("last_size"), (F.col("at") + F.col("len")).alias("byte_end"))
    fit = s.join(on, [key, "own_run"]).filter((F.col("last") >= F.col("first")) & ((F.col("last") == F.col("first")) | (F.col("last_size") - F.col("before_size") <= F.col("max_bytes"))))
    got = fit.groupBy(key, "first", "max_bytes", "preroll", "complete", "byte_start", "count", "own_run", "before_size").agg(F.max(F.struct("last", "byte_end", "last_size")).alias("x"))
    after = f.select(key, F.col("no").alias("n_no"), F.col("run").alias("n_run"))
    got = got.withColumn("n_no", F.col("x.last") + 1).join(after, [key, "n_no"], "left")
    return got.select(key, "first", "preroll", F.col("x.last").alias("last"), "byte_start", F.col("x.byte_end").alias("byte_end"), "complete",
                      F.coalesce(F.col("n_run") != F.col("own_run"), F.lit(False)).alias("stopped_at_gap"), (F.col("x.last") == F.col("count") - 1).alias("end_of_track"),
                      F.when(F.col("x.last_size") - F.col("before_size") > F.col("max_bytes"), "too_small").otherwise("ok").alias("status"))


def on_cycle(edges: DataFrame, doc: str, source: str, target: str) -> DataFrame:
    """Nodes that can reach themselves, over cycles of any length: ``doc, node``. Nodes without a way in or out are pruned first."""
    e = cut(edges.select(F.col(doc).alias("doc"), F.col(source).alias("a"), F.col(target).alias("b")).distinct())
    n = e.count()
    for _ in range(PRUNE_ROUNDS):
        heads, tails = e.select("doc", F.col("a").alias("b")).distinct(), e.select("doc", F.col("b").alias("a")).distinct()
        e = cut(e.join(heads, ["doc", "b"], "left_semi").join(tails, ["doc", "a"], "left_semi"))
        left = e.count()
        if left == n:
            break
        n = left
    # what is left lies on cycles or between them; a node is on one if a walk from it comes back
    back = _reach(e.select("doc", F.col("a").alias("node"), F.col("b").alias("at"))).filter("node = at")
    return back.select(F.col("doc").alias(doc), "node")


def parts_in_range(parts: DataFrame, doc: str, start: int, end: int) -> DataFrame:
    """Parts that meet ``[start, end)``, the bytes of them inside, and whether they are whole."""
    inside = parts.filter((F.col("start") < end) & (F.col("end") > start))
    return inside.withColumns({"from_at": F.greatest("start", F.lit(start)), "to_at": F.least("end", F.lit(end)), "whole": (F.col("start") >= start) & (F.col("end") <= end)})


def page_labels(pages: DataFrame, ranges: DataFrame, doc: str, index: str) -> DataFrame:
    """Printed label of each page by the nearest label range at or before it: prefix and number in the range's style."""
    from shelfmark.functions.scalars import letters_label, roman
    from shelfmark.operators.folds import as_of

    r = ranges.select(doc, F.col("first").alias(index), F.struct("style", "prefix", "number").alias("rule"))
    p = pages.withColumn("_page", F.col(index))
    j = as_of(p, r, doc, index, "rule")
    n = (F.col(index) - F.col("mark_at") + F.col("rule.number")).cast("int")
    style = F.col("rule.style")
    text = F.when(style == "decimal", n.cast("string")).when(style == "roman", roman(n)).when(style == "letters", letters_label(n)).otherwise("")
    return j.select(doc, index, F.concat(F.coalesce("rule.prefix", F.lit("")), text).alias("label"))


def printed_number(style: str, n: int) -> str:
    """A page number in a style of PDF labels: D decimal, R and r roman, A and a letters; empty for any other."""
    if style in ("R", "r"):
        out = ""
        rest = n
        for value, mark in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, rest = out + mark * (rest // value), rest % value
        out = out if 1 <= n <= 3999 else str(n)
        return out.upper() if style == "R" else out
    if style in ("A", "a"):
        return chr((65 if style == "A" else 97) + (n - 1) % 26) * ((n - 1) // 26 + 1) if 1 <= n <= 2600 else str(n)
    return str(n) if style == "D" else ""


def greedy_ranges(frames: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Consecutive items packed into ranges of at most ``limit`` bytes: ``key, range_no, first, last, bytes``.

    Every cut depends on the one before, so each key's items are read in order, as a stream of batches, by one task;
    an item above the limit stands alone. Only the open range is held in memory.
    """
    kind, order_kind = frames.schema[key].dataType.simpleString(), frames.schema[order].dataType.simpleString()
    rows = frames.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(size).cast("long").alias("_n"))
    rows = rows.repartition("_k").sortWithinPartitions("_k", "_o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, no, first, last, total = None, 0, None, None, 0
        for b in batches:
            out = []
            for k, at, n in zip(b["_k"].tolist(), b["_o"].tolist(), b["_n"].tolist()):
                if now is not None and (k != now or total + n > limit):
                    out.append((now, no, first, last, total))
                    total = 0
                if k != now:
                    now, no = k, 0
                if total == 0:
                    no, first = no + 1, at
                last, total = at, total + n
            if out:
                yield pd.DataFrame(out, columns=[key, "range_no", "first", "last", "bytes"])
        if now is not None:
            yield pd.DataFrame([(now, no, first, last, total)], columns=[key, "range_no", "first", "last", "bytes"])

    return rows.mapInPandas(run, f"{key} {kind}, range_no int, first {order_kind}, last {order_kind}, bytes long")


def checked_append(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges of a key in order, with whether each begins where the one before ends: ok, skip or repeat."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    status = F.when(before.isNull() | (before == F.col(start)), "ok").when(F.col(start) > before, "skip").otherwise("repeat")
    return ranges.withColumn("status", status)
