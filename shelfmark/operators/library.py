"""Holdings and recordings of a library: relations between them, projections of one of them, contents of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import FORMATS, STATUSES, col, file_kind, volume_of
from shelfmark.operators.groups import complete_sets
from shelfmark.operators.search import has


def one_of(c: Column | str, choice: str, allowed: tuple[str, ...]) -> Column:
    """Whether a value is the chosen one, ``all`` letting every value through; a choice outside ``allowed`` is refused at once."""
    if choice not in allowed:
        raise ValueError(f"{choice!r} is none of {', '.join(allowed)}")
    return F.lit(True) if choice == "all" else F.coalesce(col(c) == choice, F.lit(False))


def has_format(c: Column | str, choice: str) -> Column:
    """Filter by format: all, epub, pdf, mp3, m4b or m4a."""
    return one_of(c, choice, FORMATS)


def has_status(c: Column | str, choice: str) -> Column:
    """Filter by status: all, checked or review."""
    return one_of(c, choice, STATUSES)


def in_title_or_summary(title: Column | str, summary: Column | str, needle: str) -> Column:
    """Filter of a loaded page: a text within the title and the summary read as one line."""
    return has(F.concat_ws(" ", col(title), col(summary)), needle)


#: Kinds of offered files whose extension a provider uses otherwise (fixed values).
NOT_OFFERED = ("bz2", "xz", "par2")


def offered_kind(name: Column | str) -> Column:
    """Kind of an offered file by its extension: as ``file_kind``, without recovery data and two archive kinds."""
    ext = F.regexp_extract(F.lower(col(name)), r"\.([^./\\]*)$", 1)
    return F.when(ext.isin(*NOT_OFFERED), "other").otherwise(file_kind(name))


def in_scope(paths: Column | str, roots: list[str]) -> Column:
    """Whether all paths of an array lie in one of the folders; an empty array does not."""
    folders = [r.rstrip("/") for r in roots]
    one = lambda p: F.coalesce(F.array_contains(F.lit(folders), p) | F.exists(F.lit(folders), lambda r: p.startswith(F.concat(r, F.lit("/")))), F.lit(False))
    return F.coalesce((F.size(col(paths)) > 0) & F.forall(col(paths), one), F.lit(False))


def location_of(assets: DataFrame, asset: str, path: str, order: str) -> DataFrame:
    """The first location of each asset, in one partial aggregation: ``asset, path, locations`` (how many there are)."""
    return assets.filter(F.col(path).isNotNull()).groupBy(asset).agg(F.min_by(path, F.struct(order, path)).alias(path), F.count(F.lit(1)).alias("locations"))


def held_keys(holdings: DataFrame, sources: str, fields: list[str]) -> DataFrame:
    """Distinct keys of the sources in an array column of the holdings: the build side of semi-joins."""
    return holdings.select(F.explode(sources).alias("s")).select(*[F.col(f"s.{f}").alias(f) for f in fields]).na.drop("any").distinct()


def acquire_steps(items: DataFrame, holdings: DataFrame, packets: DataFrame, key: list[str], exact: str) -> DataFrame:
    """Items that are not held, beside the packet of their key: ``action`` is fetch, import (the same selection) or conflict.

    An anti-join with the holdings, then a left join with the packets whose selection is compared once more.
    """
    open_ = items.join(holdings.select(*key).distinct(), key, "left_anti")
    p = packets.groupBy(*key).agg(F.min(exact).alias("_exact"), F.count_distinct(exact).alias("_n"))
    j = open_.join(p, key, "left")
    same = (F.col("_n") == 1) & F.col("_exact").eqNullSafe(F.col(exact))
    return j.withColumn("action", F.when(F.col("_n").isNull(), "fetch").when(same, "import").otherwise("conflict")).drop("_exact", "_n")


def selection_status(declared: DataFrame, manifests: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Status of declared selections against the sets held: not_held, incomplete, changed, provider_evidence or matched.

    ``manifests`` have ``key, complete, identity, provider``; ``declared`` have ``key`` and the ``identity`` they were made for.
    """
    m = manifests.select(*key, "complete", F.col(identity).alias("_identity"), "provider", F.lit(True).alias("_held"))
    j = declared.join(m, key, "left")
    status = (F.when(F.col("_held").isNull(), "not_held").when(~F.col("complete"), "incomplete").when(~F.col("_identity").eqNullSafe(F.col(identity)), "changed")
              .when(F.col("provider"), "provider_evidence").otherwise("matched"))
    return j.select(*declared.columns, status.alias("status"))


def declaration_status(selections: DataFrame, active: str, declaration: str, key: list[str], claim: str) -> DataFrame:
    """Status of declarations by their selections' statuses: retracted, unresolved or matched; ``selections`` with conflicts named.

    Two active declarations that give one matched selection different claims are in conflict, and both unresolved.
    Columns: ``selections`` with ``status`` revised, and ``declaration_status``.
    """
    live = F.col(active) & (F.col("status") == "matched")
    rivals = selections.filter(live).groupBy(*key).agg(F.count_distinct(claim).alias("_claims"))
    j = selections.join(rivals, key, "left")
    j = j.withColumn("status", F.when(live & (F.col("_claims") > 1), "conflicting").otherwise(F.col("status"))).drop("_claims")
    whole = j.groupBy(declaration).agg(F.bool_and(F.col("status") == "matched").alias("_all"))
    named = j.join(whole, declaration)
    return named.withColumn("declaration_status", F.when(~F.col(active), "retracted").when(F.col("_all"), "matched").otherwise("unresolved")).drop("_all")


def narrowed(related: DataFrame, group: list[str], source: str, wanted: str | None) -> DataFrame:
    """Groups over all sources, narrowed afterwards to the members of one source, with how many members each had in all.

    The count comes from an aggregate below the filter, so the filter cannot be pushed under the relation.
    """
    n = related.groupBy(*group).agg(F.count(F.lit(1)).alias("members_in_all"))
    j = related.join(n, group)
    return j if not wanted else j.filter(F.col(source) == wanted)


def recordings_of_assets(tracks: DataFrame, manifests: DataFrame, key: str, pos: str, asset: str) -> DataFrame:
    """For each asset and each recording that holds it: its positions, and what the recording declares, holds and lacks.

    An asset's positions in one recording are as many as it has copies there.
    """
    own = tracks.filter(F.col(pos).isNotNull() & F.col(asset).isNotNull()).groupBy(asset, key).agg(F.array_sort(F.collect_set(pos)).alias("positions"))
    return own.join(manifests.select(key, "declared", "held", "missing", "complete"), key)


def portable(holdings: DataFrame, keep: list[str], sources: str, source_fields: list[str]) -> DataFrame:
    """Holdings as they may be shown elsewhere: the named columns and fields of sources only, and the digest of the whole record."""
    whole = F.sha2(F.to_json(F.struct(*sorted(holdings.columns)), {"ignoreNullFields": "false"}), 256)
    shown = F.transform(sources, lambda s: F.struct(*[s[f].alias(f) for f in source_fields]))
    return holdings.select(*keep, shown.alias(sources), whole.alias("holding_sha256"))


def citation_fields(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """For each key and field the one stated value, if there is just one: ``key, field, status, value, candidates``.

    ``fields`` are arrays of stated values. Statuses: recorded, ambiguous, unknown. Empty and null values state nothing.
    """
    each = [F.struct(F.lit(n).alias("field"), F.filter(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")).alias("c")) for n, c in fields.items()]
    one = df.select(key, F.explode(F.array(*each)).alias("f"))
    n = F.size("f.c")
    status = F.when(n == 1, "recorded").when(n > 1, "ambiguous").otherwise("unknown")
    return one.select(key, "f.field", status.alias("status"), F.when(n == 1, F.col("f.c")[0]).alias("value"), F.col("f.c").alias("candidates"))


def held_copies(files: DataFrame, stored: DataFrame, cleanup: str, path: str, size: str, digest: str) -> DataFrame:
    """Copies that cleanups hold: ``cleanup, files, bytes, changed`` (copies there with other bytes); moved back ones count nowhere."""
    s = stored.select(path, F.col(size).alias("_size"), F.col(digest).alias("_digest"), F.lit(True).alias("_there"))
    j = files.join(s, path, "left").filter("_there")
    ok = F.coalesce((F.col("_size") == F.col(size)) & (F.col("_digest") == F.col(digest)), F.lit(False))
    return j.groupBy(cleanup).agg(F.sum(ok.cast("long")).alias("files"), F.sum(F.when(ok, F.col(size)).otherwise(0)).alias("bytes"), F.sum((~ok).cast("long")).alias("changed"))


def recovery_sets(packets: DataFrame) -> DataFrame:
    """Recovery packets by set, ordered by its id: counts by kind and checksum, and what contradicts itself.

    ``packets`` as of ``containers.recovery_packets``. A set with several different main packets, or a file described in
    different ways under one id, is in conflict; the same packet in several files is not.
    """
    good = F.col("checksum_ok")
    n = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    p = packets.filter("set_id IS NOT NULL")
    of = lambda kind: F.when(good & (F.col("kind") == kind), F.col("body_sha256"))
    sets = p.groupBy("set_id").agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("packets"), n(good).alias("matching"), n(~good).alias("mismatched"),
        n(F.col("kind") == "recovery").alias("recovery"), n(F.col("kind") == "other").alias("unknown"), F.count_distinct(of("main")).alias("mains"),
        F.count_distinct(of("file")).alias("descriptions"), F.count_distinct(of("creator")).alias("creators"), F.count_distinct(F.when(good & (F.col("kind") == "file"), F.col("file_id"))).alias("file_ids"))
    conflicts = F.array_compact(F.array(F.when(F.col("mains") > 1, "main_packets"), F.when(F.col("descriptions") > F.col("file_ids"), "file_descriptions")))
    return sets.withColumn("conflicts", conflicts).orderBy("set_id")


#: Names of a packet's content, and what can be read (fixed values).
CONTENTS = ("content.epub", "content.pdf", "content.mp3", "content.m4b", "content.m4a")
ARCHIVES = ("zip", "rar", "7z")
READABLE = ("epub", "pdf", "mp3", "m4b", "m4a")


def folder_units(entries: DataFrame, path: str, kind: str) -> DataFrame:
    """What each entry of a folder is: ``path, unit, of``.

    packet_part (a receipt with content beside it; ``of`` the packet's folder), incomplete_packet (an intent and content
    without a receipt), archive and archive_volume (``of`` the first volume of a complete set), broken_set (``of`` the reason),
    file, not_a_file, directory or unsupported. Folders and sets are joined by equality; nothing is listed by folder.
    """
    e = entries.select(F.col(path).alias("path"), F.col(kind).alias("kind"))
    e = e.withColumns({"folder": F.regexp_replace("path", "/?[^/]*$", ""), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    is_ = lambda *names: F.bool_or(F.col("name").isin(*names))
    folders = e.filter(F.col("name").isin("receipt.json", "intent.json", *CONTENTS)).groupBy("folder").agg(is_("receipt.json").alias("receipt"), is_("intent.json").alias("intent"), is_(*CONTENTS).alias("content"))
    e = e.join(folders, "folder", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    record = F.col("name").isin("receipt.json", "intent.json", *CONTENTS)
    part = record & flag("receipt") & flag("content")
    left = record & ~flag("receipt") & flag("intent") & flag("content")
    plain = ~F.coalesce(F.col("kind").isin("link", "special", "unreadable", "directory"), F.lit(False))
    e = e.withColumns({"part": part, "left": left, "volume": F.when(plain & ~part, volume_of("path"))})
    v = e.filter("volume IS NOT NULL").select("path", F.concat_ws("|", "volume.scheme", "volume.set").alias("set"), F.col("volume.number").alias("number"))
    sets = complete_sets(v, "set", "number").join(v.groupBy("set").agg(F.min_by("path", "number").alias("first")), "set")
    e = e.join(v.select("path", "set"), "path", "left").join(sets.select("set", "complete", "reason", "first"), "set", "left")
    ext = F.regexp_extract(F.lower("name"), r"\.([^.]*)$", 1)
    unit = (F.when(F.col("complete") & (F.col("path") == F.col("first")), "archive").when(F.col("complete"), "archive_volume").when(F.col("set").isNotNull(), "broken_set")
            .when(F.col("kind") == "directory", "directory").when(~plain, "not_a_file").when(F.col("part"), "packet_part").when(F.col("left"), "incomplete_packet")
            .when(ext.isin(*ARCHIVES), "archive").when(ext.isin(*READABLE), "file").otherwise("unsupported"))
    of = F.when(unit.isin("archive", "archive_volume") & F.col("set").isNotNull(), F.col("first")).when(unit == "broken_set", F.col("reason")).when(unit == "packet_part", F.col("folder"))
    return e.select(F.col("path").alias(path), unit.alias("unit"), of.alias("of"))


def overview(holdings: DataFrame, status: str, counts: dict[str, DataFrame]) -> DataFrame:
    """Counts of an overview as one row for each: holdings by status, and the rows of other relations. ``name, n``."""
    out = holdings.groupBy(F.col(status).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in counts.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out
