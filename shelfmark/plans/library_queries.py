"""Queries over logs, holdings, recordings and texts: folds, comparisons, groupings, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import compare, folds, groups, search, text
from shelfmark.session import table


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, with the place of the first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return folds.latest_per_key(e, "user_id", "event_id")


def mark_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as marks: view saves, click notes, error deletes."""
    return folds.mark_fold(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "view", "click", "error")


def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a job journal: purchase and error end a job and stick."""
    j = folds.job_fold(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_type", ["purchase", "error"])
    return j.select("user_id", "status", "updated_line", "n_events")


def active_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as declarations: signup declares, error retracts."""
    return folds.active_declarations(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "signup", "error")


def open_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as operations: click starts, purchase finishes."""
    return folds.open_operations(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "click", "purchase")


def pair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event beside the one before it: whether the type is the same."""
    return folds.pair_check(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"))


def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 purchases, filtered before the limit, with a truncation flag."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return search.newest(e, "ts", "event_id").select("event_id", "user_id", "pos", "truncated")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each track in its recording by the durations before it, on the unbroken prefix only."""
    t = table(spark, sf_dir, "audio_tracks").filter("recording_id IS NOT NULL AND track_no IS NOT NULL")
    t = t.groupBy("recording_id", "track_no").agg(F.min_by("encoded_duration_ms", "track_id").alias("ms"))
    return folds.running_start(t, "recording_id", "track_no", "ms").select("recording_id", "track_no", "start")


def chapter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of each chapter by the start of the next one."""
    c = table(spark, sf_dir, "audio_chapters").filter("track_id IS NOT NULL AND start_ms IS NOT NULL").select("chapter_row", "track_id", "start_ms", "end_ms")
    return folds.next_starts(c, "track_id", "start_ms", "end_ms", "chapter_row").select("chapter_row", "status", F.col("end").alias("ends_at"))


def event_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signup before, at and after each event of a user."""
    b = folds.boundaries(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup")
    return b.select("event_id", "previous", "next", "second_previous")


def as_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last view at or before each purchase of the user."""
    e = table(spark, sf_dir, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return folds.as_of(p, e.filter("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


def covering_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that cover the middle of the file, for each track with a duration."""
    t = table(spark, sf_dir, "audio_tracks").filter("encoded_duration_ms IS NOT NULL").select("track_id", F.expr("encoded_duration_ms div 2").alias("at"))
    c = table(spark, sf_dir, "audio_chapters").select("track_id", "chapter_row", "start_ms", "end_ms")
    return folds.covering(t, c, "track_id", "at", "start_ms", "end_ms", ["chapter_row"]).select("track_id", "chapter_row")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same bytes."""
    return groups.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def related_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents related by text, by text number and by source and language."""
    d = table(spark, sf_dir, "documents")
    rel = {"same_text": F.sha2("text", 256), "same_work": F.col("text_num"), "same_source": F.concat_ws("/", "source", "lang")}
    out = groups.related_groups(d, "doc_id", rel, F.coalesce(F.col("unit"), F.lit(0)))
    return out.withColumn("place", search.custom_order("relation", list(rel)))


def recording_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as recordings: positions held, missing and in conflict."""
    return groups.manifests(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


def track_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of the recordings by their track numbers."""
    return groups.manifests(table(spark, sf_dir, "audio_tracks").filter("recording_id IS NOT NULL"), "recording_id", "track_no", "track_id")


def missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers below the highest that an order lacks."""
    return groups.missing_positions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def byte_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ordered parts of each order, and how many orders share it."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return groups.ordered_identity(l, "l_orderkey", ["l_linenumber", "l_partkey"], "l_suppkey")


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of orders claimed by more than one part."""
    return groups.conflicting_claims(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One return flag, none or several for each order."""
    return groups.decided(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def capped_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 parts of each supplier by line number, and how many were left out."""
    return groups.capped(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_linenumber"), 16)


def outcome_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the first outcome that fits."""
    o = table(spark, sf_dir, "orders")
    tests = {"large": F.col("o_totalprice") > 400_000, "finished": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O"}
    return groups.tallies(o, "o_orderkey", tests)


def complete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers are 1..n, or the first reason why not."""
    return groups.complete_sets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the weight of distinct part and supplier blocks that a returned line covers."""
    l = table(spark, sf_dir, "lineitem").withColumn("block", F.concat_ws("/", "l_partkey", "l_suppkey")).withColumn("w", F.col("l_quantity").cast("long"))
    return groups.weighted_coverage(l, "block", "w", F.col("l_returnflag") == "R")


def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of documents against a later state, both derived from whole tables."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"), "unit")
    base = d.filter("unit IS NULL OR unit % 7 != 3").withColumn("sha", F.when(F.col("doc_id") % 11 != 0, F.col("sha")))
    cur = d.filter("unit IS NULL OR unit % 5 != 2").withColumn("bytes", F.when(F.col("doc_id") % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return compare.audit(base, cur, "doc_id", "bytes", "sha")


def library_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines and lines without orders, by kind."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return compare.key_check(o, l, "k")


def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings as items, chapters as parts: complete, partial or missing."""
    items = table(spark, sf_dir, "audio_tracks").filter("recording_id IS NOT NULL AND track_no IS NOT NULL").groupBy("recording_id").agg(F.max("track_no").cast("long").alias("declared"))
    held = table(spark, sf_dir, "audio_chapters").select("recording_id", F.col("track_id").alias("part"))
    return compare.item_status(items, held, "recording_id", "declared", "part")


def collection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections of parts with notes: added, removed, changed, same."""
    p = table(spark, sf_dir, "part")
    before = p.filter("p_size % 3 != 0").select("p_partkey", F.col("p_brand").alias("note"))
    after = p.filter("p_size % 4 != 0").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit("new")).otherwise(F.col("p_brand")).alias("note"))
    return compare.full_diff(before, after, "p_partkey", "note")


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lines of the two halves of each order that agree within three units."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")
    a = l.filter("l_linestatus = 'O'")
    b = l.filter("l_linestatus != 'O'")
    return compare.ordered_band(a, b, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 3.0)


def reconcile_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of each user against the user's last event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    current = folds.latest_per_key(e, "user_id", "event_id").select("user_id", "value")
    return compare.reconcile(e.filter("event_type = 'purchase'"), current, "user_id", "event_id", "value")


def all_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose parts are parts of brand 1 to 20 (relational division)."""
    held = table(spark, sf_dir, "part").filter("length(p_brand) < 8 OR p_brand < 'Brand#2'").select(F.col("p_partkey").alias("l_partkey"))
    return compare.all_held(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), held, "l_orderkey", "l_partkey")


def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of customers does with the current ones."""
    c = table(spark, sf_dir, "customer")
    cur = c.filter("c_nationkey % 5 != 0").select("c_custkey", F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("note"))
    inc = c.filter("c_nationkey % 3 != 0").select("c_custkey", (F.col("c_nationkey") + F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("place"),
                                                  F.when(F.col("c_acctbal") > 9000, "rich").otherwise(F.col("c_mktsegment")).alias("note"))
    return compare.upsert_plan(cur, inc, "c_custkey", "place", "note", False)


def positional_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings whose chapters, ordered, differ from those declared with an end."""
    c = table(spark, sf_dir, "audio_chapters").filter("track_id IS NOT NULL AND start_ms IS NOT NULL").groupBy("track_id", "start_ms").agg(F.min("chapter_id").alias("cid"))
    d = table(spark, sf_dir, "audio_chapters").filter("track_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms").groupBy("track_id", "start_ms").agg(F.min("chapter_id").alias("cid"))
    return compare.positional_conflicts(c, d, "track_id", "start_ms", ["cid"])


def folder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan for a folder of files: kept or moved, and the first reason."""
    e = table(spark, sf_dir, "discovery_validation").select(F.concat(F.lit("in/"), "res_id").alias("path"), F.sha2("title", 256).alias("sha"), F.length("title").alias("bytes"))
    h = table(spark, sf_dir, "gutenberg_catalog").filter("title IS NOT NULL").select(F.sha2("title", 256).alias("sha"))
    return compare.folder_plan(e, h, "path", "sha", "bytes").groupBy("reason", "action").agg(F.count(F.lit(1)).alias("n"))


def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held states against target states: restore, already there, occupied or not held."""
    p = table(spark, sf_dir, "part")
    h = p.filter("p_size % 2 = 0").select("p_partkey", F.col("p_name").alias("d"))
    t = p.filter("p_size % 3 = 0").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("d"))
    return compare.decide(h, t, "p_partkey", "d")


def held_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line of the same key and priority class (semi-join on a composite key)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderstatus", 1, 1).alias("s"))
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("s")).distinct()
    return o.join(keys, ["o_orderkey", "s"], "left_semi").select("o_orderkey")


def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that rows of the chapters break, counted."""
    c = compare.domain_check(table(spark, sf_dir, "audio_chapters"), {
        "track": F.col("track_id").isNotNull(), "bounds": F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull(), "order": F.col("end_ms") > F.col("start_ms"),
        "title": F.length("title") > 0})
    return c.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two selections: only in one, only in the other, in both."""
    p = table(spark, sf_dir, "part")
    a, b = p.filter("p_size < 30").select("p_partkey"), p.filter("p_size > 20").select("p_partkey")
    tag = lambda df, s: df.withColumn("side", F.lit(s))
    return tag(a.exceptAll(b), "before").unionByName(tag(b.exceptAll(a), "after")).unionByName(tag(a.intersect(b), "both"))


def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a literal in every document, by byte places."""
    return text.locate(table(spark, sf_dir, "documents"), "doc_id", "text", "the ")


def locate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 occurrences in order of document and place, and whether there are more."""
    found = text.locate(table(spark, sf_dir, "documents"), "doc_id", "text", "lamp")
    return search.first_hits(found, ["doc_id", "start_byte"])


def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line feeds in the first 4,096 bytes of every document."""
    return text.line_breaks(table(spark, sf_dir, "documents"), "doc_id", "text", 0, 4096)


def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, sentence ends and clause ends of every document."""
    return text.word_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


def document_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as markup: size of the text, parts, gaps and links."""
    m = text.read_markup(table(spark, sf_dir, "documents"), "doc_id", "text")
    return m.select("doc_id", "n_chars", F.size("parts").alias("n_parts"), F.size("gaps").alias("n_gaps"), F.size("links").alias("n_links"))


_NAMES = (latest_per_key, mark_fold, job_fold, active_declarations, open_operations, pair_check, jobs_newest, running_offsets, chapter_ends, event_boundaries, as_of_value,
          covering_chapters, exact_duplicates, related_groups, recording_manifest, track_manifest, missing_positions, byte_identity, claim_conflicts, citation_candidates,
          capped_identifiers, outcome_tallies, complete_sets, block_coverage, snapshot_audit, library_check, collection_status, collection_diff, band_join, reconcile_logs,
          all_held, upsert_plan, positional_conflicts, folder_plan, restore_plan, held_jobs, domain_check, set_ops, locate, locate_first, line_breaks, word_stats, document_markup)
QUERIES = {f.__name__: f for f in _NAMES}


def _occurrences(needle: str) -> str:
    n = len(needle.encode())
    return (f"SELECT doc_id, ord, CAST(start_byte AS BIGINT) AS start_byte, CAST(start_byte + {n} AS BIGINT) AS end_byte FROM (SELECT doc_id, i AS ord, "
            f"sum(strlen(p)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {n} AS start_byte, len_all FROM (SELECT doc_id, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS len_all "
            f"FROM (SELECT doc_id, string_split(text, '{needle}') AS parts FROM documents WHERE text IS NOT NULL))) WHERE ord < len_all")  # fmt: skip


_MANIFEST = """SELECT {k}, CAST(max(p) AS INTEGER) AS declared, count(*) AS held, CAST(max(p) AS INTEGER) - count(*) AS missing, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts,
 max(p) = count(*) AND sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) = 0 AS complete FROM (SELECT {k}, {p} AS p, count(DISTINCT {a}) AS c FROM {t} WHERE {p} IS NOT NULL AND {k} IS NOT NULL GROUP BY ALL) GROUP BY {k}"""
_LAST = "max(CASE WHEN event_type = '{e}' THEN event_id END)"
SQL = {
    "latest_per_key": "SELECT user_id, min(event_id) AS first_line, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "mark_fold": f"WITH s AS (SELECT user_id, {_LAST.format(e='view')} AS v, {_LAST.format(e='click')} AS n, {_LAST.format(e='error')} AS d FROM events GROUP BY user_id) SELECT user_id, v AS saved_line, CASE WHEN n > v THEN n END AS note_line FROM s WHERE v IS NOT NULL AND (d IS NULL OR d < v)",
    "job_fold": "WITH d AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id) AS fd, max(event_id) OVER (PARTITION BY user_id) AS l, count(*) OVER (PARTITION BY user_id) AS n_events FROM events) SELECT user_id, event_type AS status, event_id AS updated_line, n_events FROM d WHERE event_id = coalesce(fd, l)",
    "active_declarations": "SELECT user_id, arg_max(event_type, event_id) = 'signup' AS active, count(*) AS n_events FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id",
    "open_operations": f"WITH s AS (SELECT user_id, {_LAST.format(e='click')} AS o, {_LAST.format(e='purchase')} AS f FROM events GROUP BY user_id) SELECT user_id, o AS open_line FROM s WHERE o IS NOT NULL AND (f IS NULL OR f < o)",
    "pair_check": "SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type AS same FROM events",
    "jobs_newest": "SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS pos, (SELECT count(*) FROM events WHERE event_type = 'purchase') > 100 AS truncated FROM events WHERE event_type = 'purchase' QUALIFY pos <= 100",
    "running_offsets": "WITH t AS (SELECT recording_id, track_no, arg_min(encoded_duration_ms, track_id) FILTER (WHERE true) AS ms0, (array_agg(encoded_duration_ms ORDER BY track_id))[1] AS ms FROM audio_tracks WHERE recording_id IS NOT NULL AND track_no IS NOT NULL GROUP BY ALL), "
                       "w AS (SELECT *, row_number() OVER o AS n, coalesce(sum(CASE WHEN ms IS NULL THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad, coalesce(sum(ms) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t WINDOW o AS (PARTITION BY recording_id ORDER BY track_no)) "
                       "SELECT recording_id, track_no, CAST(CASE WHEN bad = 0 AND n = track_no THEN st END AS BIGINT) AS start FROM w",
    "chapter_ends": "WITH w AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, chapter_row) AS nxt FROM audio_chapters WHERE track_id IS NOT NULL AND start_ms IS NOT NULL) SELECT chapter_row, CASE WHEN nxt IS NULL THEN 'end_of_source' WHEN nxt > start_ms THEN 'bounded' ELSE 'not_after_start' END AS status, CASE WHEN nxt IS NULL THEN greatest(start_ms, coalesce(end_ms, start_ms)) WHEN nxt > start_ms THEN nxt END AS ends_at FROM w",
    "event_boundaries": "SELECT event_id, max(m) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous, min(m) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next, max(m) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS second_previous FROM (SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS m FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY event_id)",
    "as_of_value": "SELECT p.event_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "covering_chapters": "SELECT t.track_id, chapter_row FROM audio_tracks t JOIN audio_chapters c ON t.track_id = c.track_id AND start_ms <= encoded_duration_ms // 2 AND encoded_duration_ms // 2 < end_ms",
    "exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "related_groups": "WITH r AS (SELECT 'same_text' AS relation, sha256(text) AS key, doc_id, coalesce(unit, 0) AS v, 1 AS place FROM documents UNION ALL SELECT 'same_work', CAST(text_num AS VARCHAR), doc_id, coalesce(unit, 0), 2 FROM documents UNION ALL SELECT 'same_source', concat_ws('/', source, lang), doc_id, coalesce(unit, 0), 3 FROM documents) "
                      "SELECT relation, key, count(DISTINCT doc_id) AS members, max(v) AS latest, min(doc_id) AS first_member, any_value(place) AS place FROM r WHERE key IS NOT NULL GROUP BY relation, key HAVING members >= 2",
    "recording_manifest": _MANIFEST.format(k="l_orderkey", p="l_linenumber", a="l_partkey", t="lineitem"),
    "track_manifest": _MANIFEST.format(k="recording_id", p="track_no", a="track_id", t="audio_tracks"),
    "missing_positions": "WITH m AS (SELECT l_orderkey, CAST(unnest(generate_series(1, max(l_linenumber))) AS INTEGER) AS position FROM lineitem GROUP BY 1) SELECT m.* FROM m ANTI JOIN lineitem l ON l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.position",
    "byte_identity": "WITH i AS (SELECT l_orderkey, sha256(string_agg(CAST(l_suppkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS identity FROM lineitem GROUP BY 1) SELECT *, count(*) OVER (PARTITION BY identity) AS sharing FROM i",
    "claim_conflicts": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS claims FROM lineitem GROUP BY 1, 2 HAVING claims > 1",
    "citation_candidates": "SELECT l_orderkey, CASE count(DISTINCT l_returnflag) WHEN 0 THEN 'unknown' WHEN 1 THEN 'value' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM lineitem GROUP BY 1",
    "capped_identifiers": "WITH d AS (SELECT l_suppkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY p, l_partkey) AS INTEGER) AS rank, greatest(count(*) OVER (PARTITION BY l_suppkey) - 16, 0) AS omitted FROM d) SELECT l_suppkey, l_partkey, rank, omitted FROM r WHERE rank <= 16",
    "outcome_tallies": "SELECT CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "complete_sets": "WITH g AS (SELECT l_orderkey, max(l_linenumber) AS t, count(DISTINCT l_linenumber) AS d, count(*) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY 1) SELECT l_orderkey, n, CASE WHEN lo < 1 THEN 'bad_number' WHEN n > d THEN 'repeated' WHEN t > d THEN 'missing' ELSE '' END AS reason, NOT (lo < 1 OR n > d OR t > d) AS complete FROM g",
    "block_coverage": "SELECT CAST(sum(w) AS BIGINT) AS total, CAST(sum(CASE WHEN h THEN w ELSE 0 END) AS BIGINT) AS covered FROM (SELECT l_partkey, l_suppkey, max(CAST(trunc(l_quantity) AS BIGINT)) AS w, bool_or(l_returnflag = 'R') AS h FROM lineitem GROUP BY 1, 2)",
    "snapshot_audit": "WITH d AS (SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha, unit FROM documents), b AS (SELECT doc_id, bytes AS s1, CASE WHEN doc_id % 11 <> 0 THEN sha END AS d1, 1 AS b FROM d WHERE unit IS NULL OR unit % 7 <> 3), c AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN bytes + 1 ELSE bytes END AS s2, sha AS d2, 1 AS c FROM d WHERE unit IS NULL OR unit % 5 <> 2) "
                      "SELECT doc_id, CASE WHEN c IS NULL THEN 'missing' WHEN b IS NULL THEN 'added' WHEN s1 <> s2 THEN 'changed' WHEN d1 IS NULL OR d2 IS NULL THEN 'unverified' WHEN d1 <> d2 THEN 'changed' ELSE 'unchanged' END AS status FROM b FULL JOIN c USING (doc_id)",
    "library_check": "SELECT 'missing' AS kind, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'untracked', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "collection_status": "WITH i AS (SELECT recording_id, CAST(max(track_no) AS BIGINT) AS declared FROM audio_tracks WHERE recording_id IS NOT NULL AND track_no IS NOT NULL GROUP BY 1), h AS (SELECT recording_id, count(DISTINCT track_id) AS held FROM audio_chapters GROUP BY 1) SELECT recording_id, declared, coalesce(held, 0) AS held, CASE WHEN coalesce(held, 0) = 0 THEN 'missing' WHEN held < declared THEN 'partial' ELSE 'complete' END AS status FROM i LEFT JOIN h USING (recording_id)",
    "collection_diff": "WITH b AS (SELECT p_partkey, p_brand AS n1, 1 AS b FROM part WHERE p_size % 3 <> 0), a AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'new' ELSE p_brand END AS n2, 1 AS a FROM part WHERE p_size % 4 <> 0) SELECT p_partkey, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN n1 IS DISTINCT FROM n2 THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a USING (p_partkey)",
    "band_join": "WITH n AS (SELECT l_orderkey, l_linestatus = 'O' AS o, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'O' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem), j AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(abs(a.q - b.q) <= 3, false) AS ok FROM (SELECT * FROM n WHERE o) a FULL JOIN (SELECT * FROM n WHERE NOT o) b ON a.l_orderkey = b.l_orderkey AND a.n = b.n) "
                 "SELECT l_orderkey, bool_and(ok) AS matched, count(*) AS pairs FROM j WHERE l_orderkey IN (SELECT l_orderkey FROM n WHERE o) AND l_orderkey IN (SELECT l_orderkey FROM n WHERE NOT o) GROUP BY 1",
    "reconcile_logs": "WITH e AS (SELECT user_id, arg_max(value, event_id) AS v1, 1 AS e FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id, arg_max(value, event_id) AS v2, 1 AS c FROM events GROUP BY 1) SELECT user_id, CASE WHEN c IS NULL THEN 'no_record' WHEN e IS NULL THEN 'no_event' WHEN v1 IS NOT DISTINCT FROM v2 THEN 'consistent' ELSE 'stale' END AS status FROM e FULL JOIN c USING (user_id)",
    "all_held": "SELECT l_orderkey, bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE length(p_brand) < 8 OR p_brand < 'Brand#2')) AS all_held, count(*) AS members FROM lineitem GROUP BY 1",
    "upsert_plan": "WITH c AS (SELECT c_custkey, c_nationkey AS p1, c_mktsegment AS n1, 1 AS c FROM customer WHERE c_nationkey % 5 <> 0), i AS (SELECT c_custkey, c_nationkey + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS p2, CASE WHEN c_acctbal > 9000 THEN 'rich' ELSE c_mktsegment END AS n2, 1 AS i FROM customer WHERE c_nationkey % 3 <> 0) "
                   "SELECT c_custkey, CASE WHEN i IS NULL THEN 'keep' WHEN c IS NULL THEN 'add' WHEN p1 = p2 AND n1 = n2 THEN 'same' WHEN p1 = p2 THEN 'note_only' ELSE 'conflict' END AS action FROM c FULL JOIN i USING (c_custkey)",
    "positional_conflicts": "WITH a AS (SELECT track_id, start_ms, min(chapter_id) AS x, 1 AS a FROM audio_chapters WHERE track_id IS NOT NULL AND start_ms IS NOT NULL GROUP BY 1, 2), b AS (SELECT track_id, start_ms, min(chapter_id) AS y, 1 AS b FROM audio_chapters WHERE track_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms > start_ms GROUP BY 1, 2) SELECT track_id, bool_or(a IS NULL OR b IS NULL OR x IS DISTINCT FROM y) AS conflict FROM a FULL JOIN b USING (track_id, start_ms) GROUP BY 1",
    "folder_plan": "WITH e AS (SELECT 'in/' || res_id AS path, sha256(title) AS sha, length(title) AS bytes, count(*) OVER (PARTITION BY lower('in/' || res_id)) > 1 AS clash FROM discovery_validation), r AS (SELECT CASE WHEN sha IS NULL THEN 'no_digest' WHEN bytes = 0 THEN 'empty' WHEN clash THEN 'name_clash' WHEN sha NOT IN (SELECT sha256(title) FROM gutenberg_catalog WHERE title IS NOT NULL) THEN 'not_held' ELSE 'held' END AS reason FROM e) SELECT reason, CASE WHEN reason = 'held' THEN 'move' ELSE 'keep' END AS action, count(*) AS n FROM r GROUP BY ALL",
    "restore_plan": "WITH h AS (SELECT p_partkey, p_name AS h FROM part WHERE p_size % 2 = 0), t AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_type END AS t FROM part WHERE p_size % 3 = 0) SELECT p_partkey, CASE WHEN h IS NULL THEN 'not_held' WHEN t IS NULL THEN 'restore' WHEN h = t THEN 'already_there' ELSE 'occupied' END AS disposition FROM h FULL JOIN t USING (p_partkey)",
    "held_jobs": "SELECT o_orderkey FROM orders WHERE (o_orderkey, o_orderstatus) IN (SELECT l_orderkey, l_linestatus FROM lineitem)",
    "domain_check": "WITH r AS (SELECT unnest(list_filter([CASE WHEN track_id IS NULL THEN 'track' END, CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'bounds' END, CASE WHEN NOT coalesce(end_ms > start_ms, false) THEN 'order' END, CASE WHEN NOT coalesce(length(title) > 0, false) THEN 'title' END], lambda x: x IS NOT NULL)) AS rule FROM audio_chapters) SELECT rule, count(*) AS n FROM r GROUP BY 1",
    "set_ops": "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'before' WHEN p_size >= 30 THEN 'after' ELSE 'both' END AS side FROM part",
    "locate": _occurrences("the "),
    "locate_first": f"WITH o AS ({_occurrences('lamp')}) SELECT *, (SELECT count(*) > 100 FROM o) AS matches_truncated FROM o ORDER BY doc_id, start_byte LIMIT 100",
    "line_breaks": f"SELECT doc_id, start_byte AS at FROM ({_occurrences(chr(10))}) WHERE start_byte < 4096",
    "word_stats": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '["'')\]}’”»」』）]+$', ''), '[.!?…。！？]$'))) AS BIGINT) AS sentences, CAST(len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '["'')\]}’”»」』）]+$', ''), '[,;:，、；：]$'))) AS BIGINT) AS clauses FROM w""",
}
