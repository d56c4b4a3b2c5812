"""Queries over stored records of outside services, made from the rows of a table in the form each service has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import table
from shelfmark.sources import providers


def _edition(n: Column) -> Column:
    return F.struct(F.concat(F.lit("/books/OL"), n, F.lit("M")).alias("key"), F.concat(F.lit("T"), n).alias("title"), F.array(F.struct(F.lit("/languages/eng").alias("key"))).alias("languages"), F.concat(F.lit("19"), n % 90 + 10).alias("publish_date"),
                    F.array(F.lit("0306406152")).alias("isbn_10"), F.when(n % 2 == 0, F.concat(F.lit("item"), n)).alias("ocaid"), F.array(F.concat(F.lit("ia:item"), n), F.lit("marc:x"), F.lit("ia:other")).alias("source_records"))


def work_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of every order read as a work: its lines, on one page."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))  # the lines of one order
    page = F.to_json(F.struct(F.size("x").alias("size"), F.transform("x", lambda x: _edition(x["l_partkey"])).alias("entries")))
    e = providers.editions(l.select("l_orderkey", page.alias("t")), "l_orderkey", "t", F.lit(0), 50)
    return e.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "id", "title", F.array_join("languages", "|").alias("languages"), "date", "archive_id", F.array_join("other_archive_ids", "|").alias("others"))


def single_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single edition for every part."""
    e = providers.edition(table(spark, sf_dir, "part").select("p_partkey", F.to_json(_edition(F.col("p_partkey"))).alias("t")), "p_partkey", "t")
    return e.select("p_partkey", "id", F.array_join("isbns", "|").alias("isbns"), "archive_id", F.size("publishers").alias("publishers"))


def result_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page of two works for every resource."""
    n = F.col("resource_no")
    w = lambda k: F.struct(F.concat(F.lit("https://openalex.org/W"), n * 10 + k).alias("id"), F.col("title").alias("display_name"), F.concat(F.lit("https://doi.org/10.1234/AB."), n).alias("doi"), (n % 100 + 1900).alias("publication_year"), F.lit("article").alias("type"), F.when(n % 3 == 0, F.lit(True)).alias("is_retracted"))
    d = table(spark, sf_dir, "discovery_validation").select("resource_no", F.to_json(F.struct(F.struct(F.lit(7).alias("count")).alias("meta"), F.array(w(0), w(1)).alias("results"))).alias("t"))
    return providers.works(d, "resource_no", "t")


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version in a listing for every part; cut off or repeating listings have none."""
    n = F.col("p_partkey")
    prefix = lambda v: F.concat(F.lit("<CommonPrefixes><Prefix>PMC"), n, F.lit("."), v, F.lit("/</Prefix></CommonPrefixes>"))
    xml = F.concat(F.lit('<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>'), F.when(n % 7 == 0, "true").otherwise("false"), F.lit("</IsTruncated>"), prefix(F.lit(1)), prefix(n % 5 + 1), F.lit("</ListBucketResult>"))
    return providers.latest_version(table(spark, sf_dir, "part").filter("p_partkey > 0").select("p_partkey", xml.alias("x")), "p_partkey", "x")


def original_bitstreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitstreams of a repository item for every resource: its files, originals and thumbnails by turns."""
    one = lambda a, i: F.struct(F.concat(F.lit("u"), i).alias("uuid"), a["name"].alias("name"), F.when(i % 2 == 0, "ORIGINAL").otherwise("THUMBNAIL").alias("bundleName"), F.lit("application/pdf").alias("mimeType"), (i + 10).alias("sizeBytes"), F.struct(F.lit("ABC").alias("value"), F.lit("MD5").alias("checkSumAlgorithm")).alias("checkSum"))
    d = table(spark, sf_dir, "discovery_validation").filter("assets IS NOT NULL").select("resource_no", F.to_json(F.struct(F.lit("20.500.12657/1").alias("handle"), F.when(F.col("resource_no") % 5 == 0, "true").otherwise("false").alias("withdrawn"), F.transform("assets", one).alias("bitstreams"))).alias("t"))
    return providers.bitstreams(d, "resource_no", "t")


def project_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and readers of a project for every part."""
    n = F.col("p_partkey")
    reader = lambda k: F.struct((n * 10 + k).cast("string").alias("reader_id"), F.concat(F.lit("R"), F.lit(k)).alias("display_name"))
    section = lambda k, readers: F.struct(F.lit(str(k)).alias("section_number"), F.concat(F.lit("S"), n).alias("title"), F.lit("1:40").alias("playtime"), readers.alias("readers"))
    none = F.array().cast("array<struct<reader_id:string,display_name:string>>")
    text = F.to_json(F.struct(F.array(F.struct(n.cast("string").alias("id"), F.array(section(1, F.array(reader(1), reader(2))), section(2, none)).alias("sections"))).alias("books")))
    return providers.project_sections(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


def declared_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that the lines of every order declare, read as audio files in one format."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("audio_candidate").alias("kind"), F.col("l_linenumber").alias("track"), F.lit("MP3").alias("format"), F.col("l_partkey").alias("declared_bytes"), F.lit(2.0).alias("seconds"))
    return providers.declared_recordings(l, "l_orderkey")


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version in an OAI record for every part."""
    n = F.col("p_partkey")
    xml = F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><GetRecord><record><metadata><a:raw xmlns:a="u"><a:id>2101.'), n, F.lit("</a:id><a:title> T  "), n, F.lit('\n</a:title><a:version version="v1"/><a:version version="v'), n % 12 + 1,
                   F.lit('"/><a:version version="x"/><a:authors><a:author><a:keyname>K</a:keyname></a:author></a:authors></a:raw></metadata></record></GetRecord></OAI-PMH>'))
    r = providers.repository_record(table(spark, sf_dir, "part").select("p_partkey", xml.alias("x")), "p_partkey", "x")
    return r.select("p_partkey", "id", "title", F.array_join("authors", "|").alias("authors"), "version")


def bounded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and creators of a bibliographic record for every part, within bounds that some break."""
    n = F.col("p_partkey")
    xml = F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:d="d"><d:title>'), F.repeat(F.lit("t"), (n % 20 + 1).cast("int")), F.lit("</d:title>"), F.repeat(F.lit("<d:creator>c</d:creator>"), (n % 4).cast("int")), F.lit("</rdf:RDF>"))
    r = providers.bounded_fields(table(spark, sf_dir, "part").select("p_partkey", xml.alias("x")), "p_partkey", "x", {"title": 15, "creator": 5}, 2)
    return r.select("p_partkey", "field", F.array_join("values", "|").alias("text"), "refused")


def open_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open locations of a work record for every resource: its files."""
    at = lambda a: F.struct(F.lit(True).alias("is_oa"), a["url"].alias("landing_page_url"), F.when(a["format"] == "pdf", a["url"]).alias("pdf_url"), F.lit("cc-by").alias("license"))
    d = table(spark, sf_dir, "discovery_validation").filter("size(assets) > 0").select("resource_no", F.to_json(F.struct(F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status")).alias("open_access"), F.transform("assets", at).alias("locations"))).alias("t"))
    return providers.open_locations(d, "resource_no", "t").select("resource_no", "pos", "open", "status", "landing_page", "pdf", "license")


_NAMES = (work_editions, single_editions, result_works, newest_versions, original_bitstreams, project_readers, declared_recordings, paper_records, bounded_records, open_locations)
QUERIES = {f.__name__: f for f in _NAMES}

_A = "WITH a AS (SELECT resource_no, unnest(assets) AS x, CAST(unnest(range(0, len(assets))) AS INTEGER) AS pos FROM discovery_validation)"
SQL = {
    "work_editions": """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, CASE WHEN l_partkey > 0 THEN 'OL' || l_partkey || 'M' END AS id, 'T' || l_partkey AS title, 'eng' AS languages, '19' || (l_partkey % 90 + 10) AS date,
        CASE WHEN l_partkey % 2 = 0 THEN 'item' || l_partkey END AS archive_id, CASE WHEN l_partkey % 2 = 0 THEN 'other' ELSE 'item' || l_partkey || '|other' END AS others FROM lineitem""",
    "single_editions": "SELECT p_partkey, CASE WHEN p_partkey > 0 THEN 'OL' || p_partkey || 'M' END AS id, '0306406152' AS isbns, CASE WHEN p_partkey % 2 = 0 THEN 'item' || p_partkey END AS archive_id, 0 AS publishers FROM part",
    "result_works": """SELECT resource_no, CAST(7 AS BIGINT) AS total, CAST(k AS INTEGER) AS pos, 'W' || (resource_no * 10 + k) AS id, title, '10.1234/ab.' || resource_no AS doi, CAST(resource_no % 100 + 1900 AS INTEGER) AS year, 'article' AS type, resource_no % 3 = 0 AS retracted
        FROM discovery_validation, (SELECT unnest([0, 1]) AS k)""",
    "newest_versions": "SELECT p_partkey, 'PMC' || p_partkey AS paper, CAST(p_partkey % 5 + 1 AS INTEGER) AS version, 2 AS versions FROM part WHERE p_partkey > 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0",
    "original_bitstreams": f"{_A} SELECT resource_no, pos, 'u' || pos AS uuid, x.name AS name, 'application/pdf' AS media, CAST(pos + 10 AS BIGINT) AS bytes, 'abc' AS md5 FROM a WHERE pos % 2 = 0 AND resource_no % 5 <> 0",
    "project_readers": """SELECT p_partkey, 1 AS number, 'S' || p_partkey AS title, CAST(100 AS DOUBLE) AS seconds, CAST(p_partkey * 10 + k AS VARCHAR) AS reader_id, 'R' || k AS reader FROM part, (SELECT unnest([1, 2]) AS k) UNION ALL SELECT p_partkey, 2, 'S' || p_partkey, 100, NULL, NULL FROM part""",
    "declared_recordings": """SELECT l_orderkey, 'MP3' AS format, max(l_linenumber) AS tracks, CAST(sum(l_partkey) AS BIGINT) AS bytes, CAST(2 * count(*) AS DOUBLE) AS seconds FROM lineitem GROUP BY 1 HAVING count(*) = count(DISTINCT l_linenumber) AND count(*) = max(l_linenumber)""",
    "paper_records": "SELECT p_partkey, '2101.' || p_partkey AS id, 'T ' || p_partkey AS title, 'K' AS authors, CAST(p_partkey % 12 + 1 AS INTEGER) AS version FROM part",
    "bounded_records": """SELECT p_partkey, 'title' AS field, CASE WHEN p_partkey % 20 + 1 <= 15 THEN repeat('t', p_partkey % 20 + 1) END AS text, p_partkey % 20 + 1 > 15 AS refused FROM part
        UNION ALL SELECT p_partkey, 'creator', CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'c' WHEN 2 THEN 'c|c' END, p_partkey % 4 > 2 FROM part""",
    "open_locations": f"{_A} SELECT resource_no, pos, true AS open, 'gold' AS status, x.url AS landing_page, CASE WHEN x.format = 'pdf' THEN x.url END AS pdf, 'cc-by' AS license FROM a",
}
