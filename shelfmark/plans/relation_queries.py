"""Queries over holdings, recordings and folders: filters, projections, relations between sets, and what a plan is bound to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import changes, folds, groups, library, structure
from shelfmark.session import checkpoint_dir, table
from shelfmark.sources import providers, sinks


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "discovery_validation").select("resource_no", "review_status", "title", "rationale", F.posexplode("assets").alias("pos", "a")).select("*", "a.name", "a.url", "a.format").drop("a")


def holdings_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of one format, whatever their status."""
    a = _assets(spark, sf_dir).withColumn("status", F.when(F.col("review_status") == "reviewed", "checked").otherwise("review"))
    return a.filter(library.has_format("format", "epub") & library.has_status("status", "all")).select("resource_no", "pos")


def holdings_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of one status, whatever their format."""
    a = _assets(spark, sf_dir).withColumn("status", F.when(F.col("review_status") == "reviewed", "checked").when(F.col("review_status") == "preprint", "review"))
    return a.filter(library.has_format("format", "all") & library.has_status("status", "checked")).select("resource_no", "pos")


def resources_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources whose title and rationale, read as one line, hold a text."""
    return table(spark, sf_dir, "discovery_validation").filter(library.in_title_or_summary("title", "rationale", "THE")).select("resource_no")


def offered_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every offered file, and of the same name with an extension that a provider does not count."""
    a = _assets(spark, sf_dir)
    return a.select("resource_no", "pos", library.offered_kind("name").alias("kind"), library.offered_kind(F.concat("name", F.lit(".TAR"))).alias("packed"), library.offered_kind(F.concat("name", F.lit(".xz"))).alias("other"))


def resources_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources all of whose files lie below two addresses."""
    d = table(spark, sf_dir, "discovery_validation")
    return d.filter(library.in_scope(F.transform("assets", lambda a: a["url"]), ["https://files.example/ia-202286", "https://files.example/arx-257519/"])).select("resource_no")


def asset_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of every text, and how many it has."""
    t = table(spark, sf_dir, "audio_tracks").filter("text_num IS NOT NULL").withColumn("place", F.concat_ws("/", "recording_id", F.lpad("track_id", 9, "0")))
    return library.location_of(t, "text_num", "place", "track_id")


def held_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names and formats of all files."""
    return library.held_keys(table(spark, sf_dir, "discovery_validation"), "assets", ["name", "format"])


def acquire_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts not held (never returned), beside packets, a fifth of which were made for another brand."""
    items = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("exact"), "p_size")
    held = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    packets = items.filter("p_size < 25").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "other").otherwise(F.col("exact")).alias("exact"))
    return library.acquire_steps(items, held, packets, ["p_partkey"], "exact").select("p_partkey", "action")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as ordered sets: their manifests with identity and evidence, and their lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    m = groups.manifests(lines, "l_orderkey", "l_linenumber", "l_partkey")
    ids = groups.ordered_identity(lines, "l_orderkey", ["l_linenumber", "l_partkey"], "l_suppkey").drop("sharing")
    evidence = lines.groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") == 1).alias("provider"))
    return m.join(ids, "l_orderkey").join(evidence, "l_orderkey"), lines


def selection_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared selections, one for each order, against the sets held: some are for another list, some for no set."""
    m, _ = _sets(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(m.select(F.col("l_orderkey").alias("o_orderkey"), F.col("identity").alias("now")), "o_orderkey", "left")
    declared = o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_custkey") % 3 == 0, "stale").otherwise(F.col("now")).alias("identity"))
    return library.selection_status(declared, m, ["l_orderkey"], "identity").select("l_orderkey", "status")


def declaration_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as selections of declarations (suppliers) with claims (flags) on parts: retracted, in conflict or matched."""
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("claim"), (F.col("l_suppkey") % 7 != 0).alias("active"), F.when(F.col("l_quantity") > 49, "changed").otherwise("matched").alias("status"))
    d = library.declaration_status(s, "active", "l_suppkey", ["l_partkey"], "claim")
    return d.groupBy("l_suppkey", "declaration_status", "status").agg(F.count(F.lit(1)).alias("n"))


def narrowed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text, related over all sources, then narrowed to one source."""
    d = table(spark, sf_dir, "documents").filter("text_num IS NOT NULL").select("doc_id", "text_num", "source")
    return library.narrowed(d, ["text_num"], "source", "verse").select("doc_id", "text_num", "members_in_all")


def asset_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier and order: the lines it holds, and how complete the order is."""
    m, lines = _sets(spark, sf_dir)
    r = library.recordings_of_assets(lines, m, "l_orderkey", "l_linenumber", "l_suppkey")
    return r.select("l_suppkey", "l_orderkey", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "declared", "missing", "complete")


def portable_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources as they may be shown elsewhere: no addresses, formats of files kept."""
    p = library.portable(table(spark, sf_dir, "discovery_validation"), ["resource_no", "title"], "assets", ["name", "format"])
    return p.select("resource_no", "title", F.array_join(F.transform("assets", lambda a: F.concat_ws(":", a["name"], a["format"])), "|").alias("files"), F.length("holding_sha256").alias("digest_length"))


def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and author of every resource: stated, ambiguous or unknown."""
    d = table(spark, sf_dir, "discovery_validation")
    c = library.citation_fields(d, "resource_no", {"title": F.array("title"), "language": F.col("languages"), "author": F.col("authors")})
    return c.select("resource_no", "field", "status", "value", F.size("candidates").alias("candidates"))


def held_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents held by cleanups (their sources): some moved back, some changed."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))
    stored = d.filter("doc_id % 5 != 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), "sha")
    return library.held_copies(d, stored, "source", "doc_id", "bytes", "sha")


def folder_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry of a folder is; six entries for every resource."""
    d = table(spark, sf_dir, "discovery_validation")
    n = F.col("resource_no")
    paths = F.array(F.concat(F.lit("p"), n, F.lit("/intent.json")), F.concat(F.lit("p"), n, F.when(n % 2 == 0, "/receipt.json").otherwise("/other.json")), F.concat(F.lit("p"), n, F.when(n % 3 == 0, "/content.xyz").otherwise("/content.epub")),
                    F.concat(F.lit("v"), n, F.lit(".part1.rar")), F.concat(F.lit("v"), n, F.when(n % 5 == 0, ".part3.rar").otherwise(".part2.rar")), F.concat(F.lit("f"), n, F.when(n % 4 == 0, ".zip").otherwise(".PDF")))
    e = d.select(F.explode(paths).alias("path"), F.when(n % 11 == 0, "link").otherwise("file").alias("kind"))
    return library.folder_units(e, "path", "kind")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an overview."""
    d = table(spark, sf_dir, "discovery_validation")
    return library.overview(d, "review_status", {"tracks": table(spark, sf_dir, "audio_tracks"), "jobs": table(spark, sf_dir, "events").filter("event_type = 'purchase'")})


def unit_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every text of the library from its units in order."""
    d = table(spark, sf_dir, "documents").filter("text_num IS NOT NULL")
    return structure.unit_views(d, "text_num", "unit", "text", F.when(F.contains("text", F.lit("[")), 1).otherwise(0))


def mark_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every user as a log of marks, checked against its rules."""
    first = "event_id = min(event_id) OVER (PARTITION BY user_id)"
    e = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "event_id % 2 AS asset", f"""CASE WHEN {first} THEN CASE WHEN user_id % 5 = 0 THEN 'save' ELSE 'enabled' END WHEN event_type = 'signup' THEN 'enabled' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'disabled'
        WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'note' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'delete' ELSE 'save' END AS event""")
    e = e.selectExpr("*", "CASE WHEN event = 'save' THEN event_id WHEN user_id % 4 = 0 THEN -1 ELSE last_value(CASE WHEN event = 'save' THEN event_id END, true) OVER (PARTITION BY user_id, asset ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS mark")
    return folds.mark_log_fold(e, "user_id", "event_id", "event", "asset", "mark")


def frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of contiguous lines from the third one of every order on, with the lines before it that it borrows from."""
    return structure.frame_range(_frames(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).cast("long").alias("first"), (F.col("o_custkey") % 120).cast("long").alias("max_bytes")),
                                 "k", "no", "at", "len", "need", "have")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1L AS no", "CAST(l_quantity AS BIGINT) AS len",
        "CAST(sum(CAST(l_quantity AS BIGINT) + CASE WHEN l_suppkey % 6 = 0 THEN 5 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) - CAST(l_quantity AS BIGINT) AS at",
        "CAST(l_partkey % 40 AS BIGINT) AS need", "CAST(l_suppkey % 25 AS BIGINT) AS have")


def stored_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all documents stored by content, twice over: every content stands there once."""
    import uuid

    root = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("content"))
    sinks.store_by_content(d, root)
    out = sinks.store_by_content(d, root)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that a plan is bound to, whatever the order and the number of its partitions, and of the plan without one row."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    same = changes.digest_of(p) == changes.digest_of(p.repartition(7).orderBy(F.desc("p_name")))
    other = changes.digest_of(p) == changes.digest_of(p.filter("p_partkey != 7"))
    return spark.createDataFrame([(same, other)], "same boolean, other boolean")


def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every resource from a provider's JSON record of it; a derived file takes its original's track."""
    d = table(spark, sf_dir, "discovery_validation").filter("assets IS NOT NULL")
    two = F.transform("assets", lambda a, i: F.struct(a["name"].alias("name"), a["format"].alias("format"), (F.col("resource_no") * 100 + i).cast("string").alias("size"), F.concat(i + 1, F.lit("/9")).alias("track"), F.lit("1:30").alias("length"), F.lit("true").alias("private")))
    more = F.transform("assets", lambda a: F.struct(F.concat(a["name"], F.lit(".txt")).alias("name"), F.lit("Text").alias("format"), F.lit("x").alias("size"), a["name"].alias("original")))
    record = F.to_json(F.struct(F.struct(F.col("res_id").alias("identifier"), F.lit("1").alias("access-restricted-item")).alias("metadata"), two.alias("files")))
    files = providers.item_files(d.select("resource_no", record.alias("r"), more.alias("m")).select("resource_no", F.concat(F.expr("left(r, length(r) - 2)"), F.lit(","), F.expr("substring(to_json(m), 2)"), F.lit("}")).alias("r")), "resource_no", "r")
    return files.select("resource_no", "name", "kind", "declared_bytes", "private", "restricted", "track", "seconds")


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a feed for every catalogue row."""
    x = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    feed = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><id>urn:'), F.col("row_id"), F.lit("</id><title> "), x(F.col("subjects")), F.lit("\n</title><author><name>A "), F.col("text_num"),
                    F.lit("</name></author><author><name>B</name></author><link href='u:1'/></entry></feed>"))
    d = table(spark, sf_dir, "gutenberg_catalog").filter("text_num IS NOT NULL AND NOT coalesce(subjects, '') RLIKE '[\\\\x00-\\\\x08\\\\x0b\\\\x0c\\\\x0e-\\\\x1f]'").select("row_id", feed.alias("xml"))
    e = providers.atom_entry(d, "row_id", "xml")
    return e.select("row_id", "id", F.length("title").alias("title_length"), F.array_join("authors", "|").alias("authors"), F.array_join("links", "|").alias("links"))


def rdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a bibliographic record for every resource."""
    one = lambda a, i: F.concat(F.lit('<pgterms:file rdf:about="'), a["url"], F.lit('"><dcterms:extent>'), (i + 5).cast("string"), F.lit("</dcterms:extent></pgterms:file>"))
    xml = F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:pgterms="p" xmlns:dcterms="d">'), F.array_join(F.transform("assets", one), ""), F.lit("</rdf:RDF>"))
    d = table(spark, sf_dir, "discovery_validation").filter("assets IS NOT NULL AND size(assets) > 0").select("resource_no", xml.alias("xml"))
    return providers.rdf_files(d, "resource_no", "xml").select("resource_no", "i", "url", "declared_bytes")


_NAMES = (holdings_by_format, holdings_by_status, resources_on_page, offered_kinds, resources_in_scope, asset_locations, held_source_keys, acquire_steps, selection_statuses, declaration_statuses,
          narrowed_relations, asset_recordings, portable_holdings, citation_fields, held_copies, folder_units, overview, unit_identities, mark_logs, frame_ranges, stored_contents, plan_lines, item_files,
          atom_entries, rdf_files)
QUERIES = {f.__name__: f for f in _NAMES}

_A = "WITH a AS (SELECT resource_no, review_status, title, rationale, unnest(assets) AS x, unnest(range(0, len(assets))) AS pos FROM discovery_validation)"
_SETS = """WITH p AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, max(l_linenumber) AS declared, max(l_linenumber) - count(*) AS missing, max(l_linenumber) = count(*) AND max(c) = 1 AS complete FROM p GROUP BY 1),
 i AS (SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS provider FROM lineitem GROUP BY 1)"""

SQL = {
    "holdings_by_format": f"{_A} SELECT resource_no, CAST(pos AS INTEGER) AS pos FROM a WHERE x.format = 'epub'",
    "holdings_by_status": f"{_A} SELECT resource_no, CAST(pos AS INTEGER) AS pos FROM a WHERE review_status = 'reviewed'",
    "resources_on_page": "SELECT resource_no FROM discovery_validation WHERE contains(lower(concat_ws(' ', title, rationale)), 'the')",
    "offered_kinds": f"""{_A}, e AS (SELECT *, lower(regexp_extract(x.name, '[^.]*$')) AS ext FROM a)
        SELECT resource_no, CAST(pos AS INTEGER) AS pos, CASE WHEN ext = 'epub' THEN 'ebook_candidate' WHEN ext = 'pdf' THEN 'pdf_candidate' WHEN ext IN ('mp3', 'm4b', 'm4a', 'ogg', 'flac') THEN 'audio_candidate' WHEN ext IN ('zip', 'rar', '7z', 'gz', 'tar') THEN 'archive_candidate' ELSE 'other' END AS kind,
        'archive_candidate' AS packed, 'other' AS other FROM e""",
    "resources_in_scope": """SELECT resource_no FROM discovery_validation WHERE len(assets) > 0 AND list_bool_and(list_transform(assets, lambda a: starts_with(a.url || '/', 'https://files.example/ia-202286/') OR starts_with(a.url || '/', 'https://files.example/arx-257519/')))""",
    "asset_locations": """SELECT text_num, arg_min(concat_ws('/', recording_id, lpad(CAST(track_id AS VARCHAR), 9, '0')), track_id) AS place, count(*) AS locations FROM audio_tracks WHERE text_num IS NOT NULL GROUP BY 1""",
    "held_source_keys": f"{_A} SELECT DISTINCT x.name AS name, x.format AS format FROM a WHERE x.name IS NOT NULL AND x.format IS NOT NULL",
    "acquire_steps": """SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'fetch' WHEN p_size % 5 = 0 THEN 'conflict' ELSE 'import' END AS action FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)""",
    "selection_statuses": f"""{_SETS} SELECT o_orderkey AS l_orderkey, CASE WHEN complete IS NULL THEN 'not_held' WHEN NOT complete THEN 'incomplete' WHEN o_custkey % 3 = 0 THEN 'changed' WHEN provider THEN 'provider_evidence' ELSE 'matched' END AS status
        FROM orders LEFT JOIN (SELECT * FROM m JOIN i USING (l_orderkey)) x ON o_orderkey = x.l_orderkey""",
    "declaration_statuses": """WITH s AS (SELECT l_suppkey, l_partkey, l_returnflag, l_suppkey % 7 <> 0 AS active, l_quantity <= 49 AS ok FROM lineitem), r AS (SELECT l_partkey FROM s WHERE active AND ok GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1),
        t AS (SELECT *, CASE WHEN NOT ok THEN 'changed' WHEN active AND l_partkey IN (FROM r) THEN 'conflicting' ELSE 'matched' END AS status FROM s), w AS (SELECT *, bool_and(status = 'matched') OVER (PARTITION BY l_suppkey) AS allm FROM t)
        SELECT l_suppkey, CASE WHEN NOT active THEN 'retracted' WHEN allm THEN 'matched' ELSE 'unresolved' END AS declaration_status, status, count(*) AS n FROM w GROUP BY ALL""",
    "narrowed_relations": "SELECT doc_id, text_num, n AS members_in_all FROM (SELECT *, count(*) OVER (PARTITION BY text_num) AS n FROM documents WHERE text_num IS NOT NULL) WHERE source = 'verse'",
    "asset_recordings": f"""{_SETS} SELECT l_suppkey, l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS positions, CAST(any_value(declared) AS INTEGER) AS declared, CAST(any_value(missing) AS BIGINT) AS missing, any_value(complete) AS complete
        FROM lineitem JOIN m USING (l_orderkey) GROUP BY 1, 2""",
    "portable_holdings": "SELECT resource_no, title, array_to_string(list_transform(assets, lambda a: concat_ws(':', a.name, a.format)), '|') AS files, 64 AS digest_length FROM discovery_validation",
    "citation_fields": """WITH f AS (SELECT resource_no, 'title' AS field, [title] AS c FROM discovery_validation UNION ALL SELECT resource_no, 'language', languages FROM discovery_validation UNION ALL SELECT resource_no, 'author', authors FROM discovery_validation),
        d AS (SELECT resource_no, field, list_distinct(list_filter(coalesce(c, []), lambda x: x IS NOT NULL AND x <> '')) AS c FROM f)
        SELECT resource_no, field, CASE len(c) WHEN 0 THEN 'unknown' WHEN 1 THEN 'recorded' ELSE 'ambiguous' END AS status, CASE WHEN len(c) = 1 THEN c[1] END AS value, CAST(len(c) AS INTEGER) AS candidates FROM d""",
    "held_copies": """SELECT source, CAST(sum(CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS files, CAST(sum(CASE WHEN doc_id % 7 <> 0 THEN strlen(text) ELSE 0 END) AS BIGINT) AS bytes, CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed
        FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1""",
    "folder_units": """WITH n AS (SELECT resource_no AS n, resource_no % 11 = 0 AS link, resource_no % 2 = 0 AND resource_no % 3 <> 0 AS packet, resource_no % 2 <> 0 AND resource_no % 3 <> 0 AS alone FROM discovery_validation),
        u AS (SELECT 'p' || n || '/intent.json' AS path, CASE WHEN link THEN 'not_a_file' WHEN packet THEN 'packet_part' WHEN alone THEN 'incomplete_packet' ELSE 'unsupported' END AS unit, CASE WHEN packet AND NOT link THEN 'p' || n END AS "of" FROM n
        UNION ALL SELECT 'p' || n || CASE WHEN n % 2 = 0 THEN '/receipt.json' ELSE '/other.json' END, CASE WHEN link THEN 'not_a_file' WHEN packet THEN 'packet_part' ELSE 'unsupported' END, CASE WHEN packet AND NOT link THEN 'p' || n END FROM n
        UNION ALL SELECT 'p' || n || CASE WHEN n % 3 = 0 THEN '/content.xyz' ELSE '/content.epub' END, CASE WHEN link THEN 'not_a_file' WHEN n % 3 = 0 THEN 'unsupported' WHEN packet THEN 'packet_part' ELSE 'incomplete_packet' END, CASE WHEN packet AND NOT link THEN 'p' || n END FROM n
        UNION ALL SELECT 'v' || n || '.part1.rar', CASE WHEN link THEN 'not_a_file' WHEN n % 5 = 0 THEN 'broken_set' ELSE 'archive' END, CASE WHEN link THEN NULL WHEN n % 5 = 0 THEN 'missing' ELSE 'v' || n || '.part1.rar' END FROM n
        UNION ALL SELECT 'v' || n || CASE WHEN n % 5 = 0 THEN '.part3.rar' ELSE '.part2.rar' END, CASE WHEN link THEN 'not_a_file' WHEN n % 5 = 0 THEN 'broken_set' ELSE 'archive_volume' END, CASE WHEN link THEN NULL WHEN n % 5 = 0 THEN 'missing' ELSE 'v' || n || '.part1.rar' END FROM n
        UNION ALL SELECT 'f' || n || CASE WHEN n % 4 = 0 THEN '.zip' ELSE '.PDF' END, CASE WHEN link THEN 'not_a_file' WHEN n % 4 = 0 THEN 'archive' ELSE 'file' END, NULL FROM n) SELECT * FROM u""",
    "overview": "SELECT review_status AS name, count(*) AS n FROM discovery_validation GROUP BY 1 UNION ALL SELECT 'tracks', count(*) FROM audio_tracks UNION ALL SELECT 'jobs', count(*) FROM events WHERE event_type = 'purchase'",
    "unit_identities": """WITH l AS (SELECT text_num, unit, text, CASE WHEN contains(text, '[') THEN 1 ELSE 0 END AS g FROM documents WHERE text_num IS NOT NULL),
        k AS (SELECT *, unit || ' ' || CASE WHEN text IS NULL THEN 'unsupported' WHEN g > 0 THEN 'text_with_gaps' ELSE 'text' END || ' ' || coalesce(sha256(text), '-') || ' ' || g AS line FROM l)
        SELECT text_num, sha256(string_agg(line, chr(10) ORDER BY unit, line)) AS representation, count(*) AS units, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, CAST(sum(CASE WHEN text IS NOT NULL AND g > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_gaps FROM k GROUP BY 1""",
    "mark_logs": """WITH e AS (SELECT user_id, event_id, event_id % 2 AS asset, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN CASE WHEN user_id % 5 = 0 THEN 'save' ELSE 'enabled' END WHEN event_type = 'signup' THEN 'enabled' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'disabled'
          WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'note' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'delete' ELSE 'save' END AS ev FROM events),
        x AS (SELECT *, (SELECT max(s.event_id) FROM e s WHERE s.user_id = e.user_id AND s.asset = e.asset AND s.ev = 'save' AND s.event_id < e.event_id) AS s, (SELECT max(s.event_id) FROM e s WHERE s.user_id = e.user_id AND s.asset = e.asset AND s.ev = 'delete' AND s.event_id < e.event_id) AS d,
          (SELECT arg_max(t.ev, t.event_id) FROM e t WHERE t.user_id = e.user_id AND t.ev IN ('enabled', 'disabled') AND t.event_id < e.event_id) AS was FROM e),
        y AS (SELECT *, CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN ev = 'enabled' WHEN ev = 'save' THEN coalesce(was = 'enabled', false) WHEN ev IN ('note', 'delete') THEN coalesce(s IS NOT NULL AND (d IS NULL OR d < s) AND user_id % 4 <> 0, false) ELSE true END AS ok FROM x),
        l AS (SELECT user_id, bool_and(ok) AS valid, arg_max(ev = 'enabled', event_id) FILTER (WHERE ev IN ('enabled', 'disabled')) AS enabled FROM y GROUP BY 1),
        m AS (SELECT user_id, asset, max(event_id) FILTER (WHERE ev = 'save') AS saved_line, max(event_id) FILTER (WHERE ev = 'note') AS n, max(event_id) FILTER (WHERE ev = 'delete') AS d FROM y GROUP BY 1, 2)
        SELECT l.user_id, CASE WHEN valid THEN asset END AS asset, CASE WHEN valid THEN saved_line END AS mark, CASE WHEN valid THEN saved_line END AS saved_line, CASE WHEN valid AND n > saved_line THEN n END AS note_line, CASE WHEN valid THEN enabled END AS enabled, valid
        FROM l LEFT JOIN (SELECT * FROM m WHERE saved_line IS NOT NULL AND (d IS NULL OR d < saved_line)) m ON l.user_id = m.user_id AND valid""",
    "frame_ranges": """WITH f AS (SELECT l_orderkey AS k, row_number() OVER o - 1 AS no, CAST(l_quantity AS BIGINT) AS len, CAST(sum(l_quantity + CASE WHEN l_suppkey % 6 = 0 THEN 5 ELSE 0 END) OVER o AS BIGINT) - CAST(l_quantity AS BIGINT) AS pl, l_partkey % 40 AS need, l_suppkey % 25 AS have FROM lineitem
          WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
        b AS (SELECT *, coalesce(lag(pl + len) OVER (PARTITION BY k ORDER BY no) <> pl, false) AS gap FROM f), r AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY no) AS run, count(*) OVER (PARTITION BY k) AS cnt FROM b),
        t AS (SELECT r.k, o_custkey % 120 AS mx, r.run, x.no AS tno, 2 - x.no AS h, x.need, x.run AS trun FROM r JOIN orders ON o_orderkey = r.k JOIN r x ON x.k = r.k AND x.no IN (1, 2) WHERE r.no = 2),
        d AS (SELECT t.k, t.h, t.run = t.trun AS same, (SELECT count(*) FROM r j WHERE j.k = t.k AND j.run = t.trun AND j.no < t.tno AND coalesce((SELECT sum(i.have) FROM r i WHERE i.k = t.k AND i.no > j.no AND i.no < t.tno), 0) < t.need) AS n,
          t.need <= coalesce((SELECT sum(i.have) FROM r i WHERE i.k = t.k AND i.run = t.trun AND i.no < t.tno), 0) OR t.trun = 0 AS covered FROM t),
        p AS (SELECT k, CAST(max(CASE WHEN same THEN n + h END) AS INTEGER) AS preroll, bool_and(same AND covered) AS complete FROM d GROUP BY 1),
        q AS (SELECT p.*, r.run, r.cnt, o_custkey % 120 AS mx, s.pl AS byte_start, s.no AS s_no FROM p JOIN r ON r.k = p.k AND r.no = 2 JOIN r s ON s.k = p.k AND s.no = 2 - p.preroll JOIN orders ON o_orderkey = p.k),
        z AS (SELECT q.*, l.no AS last, l.pl + l.len AS byte_end, (SELECT sum(i.len) FROM r i WHERE i.k = q.k AND i.no BETWEEN q.s_no AND l.no) AS size FROM q JOIN r l ON l.k = q.k AND l.no >= 2 AND l.run = q.run),
        y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY last DESC) AS rn FROM z WHERE last = 2 OR size <= mx)
        SELECT k, CAST(2 AS BIGINT) AS first, preroll, last, byte_start, byte_end, complete, EXISTS (SELECT 1 FROM r g WHERE g.k = y.k AND g.no = y.last + 1 AND g.gap) AS stopped_at_gap, last = cnt - 1 AS end_of_track, CASE WHEN size > mx THEN 'too_small' ELSE 'ok' END AS status FROM y WHERE rn = 1""",
    "stored_contents": "SELECT DISTINCT sha256(text) AS sha256, true AS verified FROM documents WHERE text IS NOT NULL",
    "plan_lines": "SELECT true AS same, false AS other",
    "item_files": f"""{_A} SELECT resource_no, x.name AS name, CASE regexp_extract(x.name, '[^.]*$') WHEN 'epub' THEN 'ebook_candidate' WHEN 'pdf' THEN 'pdf_candidate' ELSE 'audio_candidate' END AS kind, resource_no * 100 + pos AS declared_bytes, 'true' AS private, 'true' AS restricted, CAST(pos + 1 AS INTEGER) AS track, CAST(90 AS DOUBLE) AS seconds FROM a
        UNION ALL SELECT resource_no, x.name || '.txt', 'other', NULL, 'not_declared', 'true', CAST(pos + 1 AS INTEGER), 0 FROM a""",
    "atom_entries": r"""SELECT row_id, 'urn:' || row_id AS id, CAST(length(trim(regexp_replace(coalesce(subjects, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS INTEGER) AS title_length, 'A ' || text_num || '|B' AS authors, 'u:1' AS links FROM gutenberg_catalog WHERE text_num IS NOT NULL AND NOT regexp_matches(coalesce(subjects, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]')""",
    "rdf_files": f"{_A} SELECT resource_no, CAST(pos + 1 AS INTEGER) AS i, x.url AS url, pos + 5 AS declared_bytes FROM a",
}
