"""Queries over structure: chains of parents, ranges, links, packing; and plans of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import changes, compare, folds, groups, structure
from shelfmark.session import table


def parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and top of each part in the tree in which part n hangs below part n div 3."""
    p = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.lit(1).alias("doc"), F.col("p_partkey").alias("node"), F.expr("p_partkey div 3").alias("parent"))
    a = structure.ancestors(p, "doc", "node", "parent")
    return a.groupBy("node").agg(F.max("distance").cast("long").alias("depth"), F.min("ancestor").alias("top"))


def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each chapter in its file's order, every third one standing below the one before."""
    c = table(spark, sf_dir, "audio_chapters").filter("track_id IS NOT NULL AND start_ms IS NOT NULL").groupBy("track_id", "start_ms").agg(F.min("chapter_row").alias("row"), F.max("end_ms").alias("end_ms"))
    from pyspark.sql import Window

    n = c.withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms")))
    n = n.withColumn("parent", F.when(F.col("n") % 3 == 0, F.col("n") - 1).otherwise(0))
    r = structure.entry_ranges(n, "track_id", "n", "parent", ["start_ms"], F.col("end_ms").isNotNull())
    return r.select("row", "status", F.col("end.start_ms").alias("ends_at"))


def chapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as links into the tracks of their recording: resolved or the reason why not, counted."""
    c = table(spark, sf_dir, "audio_chapters").filter("recording_id IS NOT NULL")
    links = c.select(F.col("recording_id").alias("doc"), F.col("track_id").cast("string").alias("member"), F.when(F.col("start_ms") % 2 == 0, F.col("chapter_id")).otherwise("").alias("fragment"))
    links = links.withColumn("fragment", F.coalesce("fragment", F.lit("")))
    members = table(spark, sf_dir, "audio_tracks").filter("recording_id IS NOT NULL").select(F.col("recording_id").alias("doc"), F.col("track_id").cast("string").alias("member"), F.col("track_id").alias("unit"))
    targets = c.filter("track_id IS NOT NULL AND chapter_id IS NOT NULL AND end_ms > start_ms").select(F.col("recording_id").alias("doc"), F.col("track_id").alias("unit"), F.col("chapter_id").alias("fragment"), F.col("start_ms").alias("offset"))
    return structure.resolve_links(links, members, targets, "doc").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))


def link_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations on a cycle of the graph from each customer's nation to the nation of the same number of supplier, by region."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("a"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"))
    return structure.on_cycle(c.join(s, "k").withColumn("doc", F.lit(0)), "doc", "a", "b").select(F.col("node").alias("nation"))


def packed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each file packed in order into ranges of at most four megabytes."""
    r = table(spark, sf_dir, "audio_regions").filter("track_id IS NOT NULL AND region_end > region_start")
    r = r.select("track_id", "region_row", (F.col("region_end") - F.col("region_start")).alias("size"))
    return structure.greedy_ranges(r, "track_id", "region_row", "size", 4_000_000)


def appended_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of each file in order: whether each begins where the one before ends, counted."""
    c = table(spark, sf_dir, "audio_chapters").filter("track_id IS NOT NULL AND end_ms > start_ms").select("track_id", "start_ms", "end_ms").distinct()
    return structure.checked_append(c, "track_id", "start_ms", "end_ms").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def parts_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of every file that meet its first megabyte, and how much of them lies inside."""
    r = table(spark, sf_dir, "audio_regions").filter("region_end > region_start").select("region_row", "track_id", F.col("region_start").alias("start"), F.col("region_end").alias("end"))
    return structure.parts_in_range(r, "track_id", 0, 1_000_000).select("region_row", "from_at", "to_at", "whole")


def format_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered files of the resources by kind and stated format."""
    a = table(spark, sf_dir, "discovery_validation").select(F.explode("assets").alias("a"))
    return a.groupBy(S.file_kind("a.name").alias("kind"), F.lower("a.format").alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a.name").alias("names"))


def eligible_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two offered books or texts of each resource, in source order."""
    a = table(spark, sf_dir, "discovery_validation").select("resource_no", F.posexplode("assets").alias("i", "a")).select("resource_no", "i", F.col("a.name").alias("name"))
    return changes.eligible(a, "resource_no", "i", S.file_kind("name").isin("ebook_candidate", "pdf_candidate"), 2).select("resource_no", "name", F.col("choice").cast("long").alias("choice"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks classified by their checks, with the reason of each review, counted."""
    t = table(spark, sf_dir, "audio_tracks")
    checks = F.when(F.col("encoded_duration_ms").isNull(), "incomplete").when(F.col("channels").isNull(), "needs_review").otherwise("limited_checks_passed")
    scan = F.element_at(F.array(*map(F.lit, ("clean", "failed", "unavailable", "found"))), (F.col("track_id") % 4 + 1).cast("int"))
    return changes.classify(t, checks, scan).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose parts are small in every listing: purgeable or not."""
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") < 35).alias("verified"))
    return changes.purge_plan(held, h, "l_orderkey", "l_partkey")


def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two partial provenance tables of customers; what is missing is filled in, nothing replaced."""
    c = table(spark, sf_dir, "customer")
    a = c.filter("c_nationkey % 3 != 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("m"), F.lit(None).cast("int").alias("n"))
    b = c.filter("c_nationkey % 4 != 0").select("c_custkey", F.lit("given").alias("m"), F.col("c_nationkey").alias("n"))
    return changes.merge_sources(a, b, ["c_custkey"], ["m", "n"])


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order whose place among the retained ones differs between line order and part order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("p1"), F.min("l_suppkey").alias("p2"))
    d = compare.retained_order(l.withColumnRenamed("p1", "p"), l.withColumnRenamed("p2", "p"), "l_orderkey", "l_partkey", "p")
    return d.select("l_orderkey", "l_partkey", F.col("before_at").cast("long").alias("before_at"), F.col("after_at").cast("long").alias("after_at"))


def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by job status and whether the job is past its retention at the newest event of all."""
    e = table(spark, sf_dir, "events")
    j = folds.job_fold(e, "user_id", "event_id", "ts", "event_type", ["purchase", "error"])
    now = e.agg(F.max("ts").alias("now"))
    aged = changes.retention(j.crossJoin(F.broadcast(now)), "updated", F.col("now"), 28)
    return aged.groupBy("status", "past_retention_age").agg(F.count(F.lit(1)).alias("n"))


def unresolved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without text number, language or text, and whether any source has all."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count_if(F.col("text_num").isNull()).alias("no_number"), F.count_if(F.col("lang").isNull()).alias("no_language"),
                                   F.bool_or(F.col("text_num").isNotNull() & F.col("lang").isNotNull()).alias("any_whole"))


def reader_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers of the recordings with the marks of their files merged: one value or several."""
    t = table(spark, sf_dir, "audio_tracks").filter("recording_id IS NOT NULL")
    return groups.decided(t, "recording_id", "file_format")


_NAMES = (parent_chains, nested_ranges, chapter_links, link_cycles, packed_ranges, appended_ranges, parts_in_range, format_tallies, eligible_assets, review_reasons, purge_plan,
          merged_sources, order_changes, finished_jobs, unresolved_summary, reader_claims)
QUERIES = {f.__name__: f for f in _NAMES}
_KIND = "CASE e WHEN 'epub' THEN 'ebook_candidate' WHEN 'pdf' THEN 'pdf_candidate' WHEN 'mp3' THEN 'audio_candidate' WHEN 'm4b' THEN 'audio_candidate' WHEN 'm4a' THEN 'audio_candidate' WHEN 'zip' THEN 'archive_candidate' ELSE 'other' END"
_ASSETS = "SELECT resource_no, i, a, regexp_extract(lower(a.name), '\\.([^./\\\\]*)$', 1) AS e FROM (SELECT resource_no, unnest(assets) AS a, unnest(range(len(assets))) AS i FROM discovery_validation)"
SQL = {
    "parent_chains": "WITH RECURSIVE a(node, anc, d) AS (SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey // 3 > 0 UNION ALL SELECT node, anc // 3, d + 1 FROM a WHERE anc // 3 > 0) SELECT node, CAST(max(d) AS BIGINT) AS depth, min(anc) AS top FROM a GROUP BY node",
    "nested_ranges": "WITH c AS (SELECT track_id, start_ms, min(chapter_row) AS row, max(end_ms) AS e FROM audio_chapters WHERE track_id IS NOT NULL AND start_ms IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms) AS n FROM c), "
                     "j AS (SELECT a.row, a.e AS own, a.start_ms, b.start_ms AS nxt, b.e AS nxt_e FROM n a LEFT JOIN n b ON a.track_id = b.track_id AND b.n = a.n + 1 + CASE WHEN (a.n + 1) % 3 = 0 AND EXISTS (SELECT 1 FROM n x WHERE x.track_id = a.track_id AND x.n = a.n + 1) THEN 1 ELSE 0 END) "
                     "SELECT row, CASE WHEN own IS NULL THEN 'unresolved' WHEN nxt IS NULL THEN 'end_of_source' WHEN nxt_e IS NULL THEN 'unresolved' ELSE 'bounded' END AS status, CASE WHEN own IS NOT NULL AND nxt_e IS NOT NULL THEN nxt END AS ends_at FROM j",
    "chapter_links": "WITH c AS (SELECT * FROM audio_chapters WHERE recording_id IS NOT NULL), l AS (SELECT recording_id, track_id, CASE WHEN start_ms % 2 = 0 THEN coalesce(chapter_id, '') ELSE '' END AS f FROM c), m AS (SELECT recording_id, track_id, 1 AS m FROM audio_tracks WHERE recording_id IS NOT NULL), "
                     "t AS (SELECT recording_id, track_id, chapter_id AS f, min(start_ms) AS o, count(*) AS n FROM c WHERE track_id IS NOT NULL AND chapter_id IS NOT NULL AND end_ms > start_ms GROUP BY ALL), "
                     "r AS (SELECT CASE WHEN m IS NULL THEN 'missing_member' WHEN f = '' THEN 'resolved' WHEN n IS NULL THEN 'missing_fragment' WHEN n > 1 THEN 'ambiguous_fragment' ELSE 'resolved' END AS status, o FROM l LEFT JOIN m USING (recording_id, track_id) LEFT JOIN t USING (recording_id, track_id, f)) "
                     "SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'resolved' THEN coalesce(o, 0) END) AS BIGINT) AS offsets FROM r GROUP BY 1",
    "link_cycles": "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey), w(s, t) AS (SELECT a, b FROM e UNION SELECT s, b FROM w JOIN e ON t = a) SELECT DISTINCT s AS nation FROM w WHERE s = t",
    "packed_ranges": "WITH RECURSIVE o AS (SELECT track_id, region_row, region_end - region_start AS size, row_number() OVER (PARTITION BY track_id ORDER BY region_row) AS n FROM audio_regions WHERE track_id IS NOT NULL AND region_end > region_start), "
                     "r AS (SELECT track_id, n, region_row, size AS total, 1 AS no FROM o WHERE n = 1 UNION ALL SELECT o.track_id, o.n, o.region_row, CASE WHEN r.total + o.size > 4000000 THEN o.size ELSE r.total + o.size END, CASE WHEN r.total + o.size > 4000000 THEN no + 1 ELSE no END FROM r JOIN o ON o.track_id = r.track_id AND o.n = r.n + 1) "
                     "SELECT track_id, no AS range_no, min(region_row) AS first, max(region_row) AS last, max(total) AS bytes FROM r GROUP BY track_id, no",
    "appended_ranges": "WITH c AS (SELECT DISTINCT track_id, start_ms, end_ms FROM audio_chapters WHERE track_id IS NOT NULL AND end_ms > start_ms), b AS (SELECT *, lag(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms) AS p FROM c) SELECT CASE WHEN p IS NULL OR p = start_ms THEN 'ok' WHEN start_ms > p THEN 'skip' ELSE 'repeat' END AS status, count(*) AS n FROM b GROUP BY 1",
    "parts_in_range": "SELECT region_row, greatest(region_start, 0) AS from_at, least(region_end, 1000000) AS to_at, region_start >= 0 AND region_end <= 1000000 AS whole FROM audio_regions WHERE region_end > region_start AND region_start < 1000000 AND region_end > 0",
    "format_tallies": f"SELECT {_KIND} AS kind, lower(a.format) AS format, count(*) AS n, count(DISTINCT a.name) AS names FROM ({_ASSETS}) GROUP BY 1, 2",
    "eligible_assets": f"SELECT resource_no, a.name AS name, row_number() OVER (PARTITION BY resource_no ORDER BY i) AS choice FROM ({_ASSETS}) WHERE {_KIND} IN ('ebook_candidate', 'pdf_candidate') QUALIFY choice <= 2",
    "review_reasons": "WITH c AS (SELECT CASE WHEN encoded_duration_ms IS NULL THEN 'checks_incomplete' WHEN channels IS NULL THEN 'findings' ELSE CASE track_id % 4 WHEN 1 THEN 'scanner_failed' WHEN 2 THEN 'scanner_unavailable' WHEN 3 THEN 'threat_found' END END AS reason FROM audio_tracks) SELECT CASE WHEN reason IS NULL THEN 'checked' ELSE 'review' END AS status, reason, count(*) AS n FROM c GROUP BY 1, 2",
    "purge_plan": "SELECT l_orderkey, count(*) AS files, bool_and(coalesce(p_size < 35, false)) AS purge FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "merged_sources": "WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS m FROM customer WHERE c_nationkey % 3 <> 0), b AS (SELECT c_custkey, 'given' AS g, c_nationkey AS n FROM customer WHERE c_nationkey % 4 <> 0) SELECT c_custkey, coalesce(m, g) AS m, n FROM a FULL JOIN b USING (c_custkey)",
    "order_changes": "WITH l AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p1, min(l_suppkey) AS p2 FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p1, l_partkey) AS before_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY p2, l_partkey) AS after_at FROM l) SELECT * FROM n WHERE before_at <> after_at",
    "finished_jobs": "WITH d AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) OVER (PARTITION BY user_id) AS fd, max(event_id) OVER (PARTITION BY user_id) AS l FROM events) SELECT event_type AS status, ts < (SELECT max(ts) FROM events) - INTERVAL 28 DAY AS past_retention_age, count(*) AS n FROM d WHERE event_id = coalesce(fd, l) GROUP BY 1, 2",
    "unresolved_summary": "SELECT source, count_if(text_num IS NULL) AS no_number, count_if(lang IS NULL) AS no_language, bool_or(text_num IS NOT NULL AND lang IS NOT NULL) AS any_whole FROM documents GROUP BY 1",
    "reader_claims": "SELECT recording_id, CASE count(DISTINCT file_format) WHEN 0 THEN 'unknown' WHEN 1 THEN 'value' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT file_format) = 1 THEN min(file_format) END AS value FROM audio_tracks WHERE recording_id IS NOT NULL GROUP BY 1",
}
