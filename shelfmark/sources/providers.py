"""Records of outside services: paged results as a data source, and readers of their JSON and XML.

The library itself opens no connection. ``PageSource`` reads stored pages
(``page-<n>.json`` with ``total`` and ``results``); another transport is a
subclass with its own ``fetch``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark.functions.codecs import json_size
from shelfmark.functions.identifiers import accession_parts
from shelfmark.functions.scalars import canonical_doi, declared_seconds, file_kind, flag_state, open_library_key, track_number
from shelfmark.operators.compare import inherit
from shelfmark.operators.search import check_page


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PageReader(DataSourceReader):
    """Pages of ``page_size`` rows; offsets need not be aligned: then two pages are read."""

    def __init__(self, options: dict) -> None:
        self.root, self.size = options["path"], int(options.get("pageSize", 50))
        self.offset, self.limit = int(options.get("offset", 0)), int(options.get("limit", 50))
        check_page(self.limit, self.offset)

    def fetch(self, number: int) -> dict:
        path = os.path.join(self.root, f"page-{number}.json")
        if not os.path.exists(path):
            return {"total": None, "results": []}
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def partitions(self) -> list[_Page]:
        return [_Page(n) for n in range(self.offset // self.size, (self.offset + self.limit - 1) // self.size + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = self.fetch(partition.number)
        for k, r in enumerate(page["results"]):
            at = partition.number * self.size + k
            if self.offset <= at < self.offset + self.limit:
                yield at, page["total"], str(r.get("id")), json.dumps(r)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shelfmark_pages"

    def schema(self) -> str:
        return "pos long, total long, id string, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PageReader(self.options)


def read_pages(spark: SparkSession, path: str, limit: int, offset: int = 0, page_size: int = 50) -> DataFrame:
    """Rows ``offset .. offset + limit`` of stored pages; a changed total or a repeated id means the order moved, and is refused."""
    check_page(limit, offset)
    spark.dataSource.register(PageSource)
    df = spark.read.format("shelfmark_pages").option("limit", limit).option("offset", offset).option("pageSize", page_size).load(path)
    c = df.agg(F.count_distinct("total").alias("totals"), F.count("id").alias("n"), F.count_distinct("id").alias("ids")).first()
    if c["totals"] > 1 or c["n"] != c["ids"]:
        raise ValueError("the results moved between two pages")
    return df


_FILE = "array<struct<name:string,format:string,original:string,source:string,size:string,length:string,track:string,title:string,md5:string,sha1:string,private:string>>"
ITEM = f"struct<metadata:struct<identifier:string,title:string,creator:string,language:string,mediatype:string,`access-restricted-item`:string>,files:{_FILE}>"


def item_files(items: DataFrame, key: str, text: str) -> DataFrame:
    """Offered files of item records: kind, declared bytes, access flag, track (a derived file takes its original's)."""
    r = items.select(key, F.from_json(text, ITEM).alias("r"))
    f = r.select(key, F.col("r.metadata.`access-restricted-item`").alias("restricted"), F.posexplode("r.files").alias("pos", "f"))
    f = f.select(key, "pos", F.col("f.name").alias("name"), F.col("f.format").alias("format"), F.col("f.original").alias("original"), file_kind("f.name").alias("kind"),
                 F.col("f.size").try_cast("long").alias("declared_bytes"), flag_state("f.private").alias("private"), flag_state("restricted").alias("restricted"),
                 F.nullif(track_number("f.track"), F.lit(0)).alias("track"), declared_seconds("f.length").alias("seconds"), F.col("f.md5").alias("md5"), F.col("f.sha1").alias("sha1"))
    return inherit(f, key, "name", "original", "track")


def open_locations(works: DataFrame, key: str, text: str) -> DataFrame:
    """Open-access locations of work records."""
    r = works.select(key, F.from_json(text, "struct<open_access:struct<is_oa:boolean,oa_status:string>,locations:array<struct<is_oa:boolean,landing_page_url:string,pdf_url:string,license:string,version:string>>>").alias("r"))
    one = r.select(key, F.col("r.open_access.is_oa").alias("open"), F.col("r.open_access.oa_status").alias("status"), F.posexplode_outer("r.locations").alias("pos", "l"))
    return one.select(key, "open", "status", "pos", F.col("l.landing_page_url").alias("landing_page"), F.col("l.pdf_url").alias("pdf"), F.col("l.license").alias("license"), F.col("l.version").alias("version"))


def _texts(xml: Column, path: str) -> Column:
    return F.transform(F.xpath(xml, F.lit(path + "/text()")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def atom_entry(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """The first entry of Atom feeds: id, title, updated, authors, links."""
    x = F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', "")
    one = lambda p: F.element_at(F.concat(_texts(x, p), F.array(F.lit(None).cast("string"))), 1)
    return feeds.select(key, one("//entry/id").alias("id"), one("//entry/title").alias("title"), one("//entry/updated").alias("updated"), _texts(x, "//entry/author/name").alias("authors"),
                        F.xpath(x, F.lit("//entry/link/@href")).alias("links"))


def rdf_files(records: DataFrame, key: str, xml: str) -> DataFrame:
    """Files of RDF bibliographic records: url, declared bytes, media type."""
    x = F.regexp_replace(F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', ""), r"(</?|\s)\w+:(\w+)", "$1$2")
    n = F.xpath_int(x, F.lit("count(//file)"))
    at = records.select(key, x.alias("x"), F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("i"))
    # an xpath with a place needs a constant, so all values are read at once and taken by place
    urls, sizes = F.xpath(F.col("x"), F.lit("//file/@about")), F.xpath(F.col("x"), F.lit("//file/extent/text()"))
    return at.select(key, "i", F.try_element_at(urls, F.col("i")).alias("url"), F.try_element_at(sizes, F.col("i")).try_cast("long").alias("declared_bytes")).withColumn("kind", file_kind("url"))


EDITION = "key string, title string, languages array<struct<key:string>>, publishers array<string>, publish_date string, isbn_10 array<string>, isbn_13 array<string>, ocaid string, source_records array<string>"


def _edition(e: Column) -> list[Column]:
    others = F.filter(F.transform(F.coalesce(e["source_records"], F.array().cast("array<string>")), lambda s: F.regexp_extract(s, "^ia:(.+)$", 1)), lambda x: (x != "") & ~x.eqNullSafe(e["ocaid"]))
    return [open_library_key(e["key"]).alias("id"), F.coalesce(e["title"], F.lit("")).alias("title"), F.transform(F.coalesce(e["languages"], F.array().cast("array<struct<key:string>>")), lambda x: F.regexp_extract(x["key"], "([^/]*)$", 1)).alias("languages"),
            F.coalesce(e["publishers"], F.array().cast("array<string>")).alias("publishers"), e["publish_date"].alias("date"), F.concat(*[F.coalesce(e[k], F.array().cast("array<string>")) for k in ("isbn_13", "isbn_10")]).alias("isbns"),
            e["ocaid"].alias("archive_id"), F.array_distinct(others).alias("other_archive_ids")]


def editions(pages: DataFrame, key: str, text: str, offset: Column, limit: int) -> DataFrame:
    """Editions of works from stored pages: ``key, pos`` (in the whole list), the edition's fields.

    A page shorter than the stated number of editions allows is refused: the next one would skip entries.
    """
    r = pages.select(key, offset.alias("offset"), F.from_json(text, f"struct<size:bigint,entries:array<struct<{_colons(EDITION)}>>>").alias("r"))
    whole = F.coalesce(F.size("r.entries") == F.greatest(F.least(F.lit(limit), F.col("r.size") - F.col("offset")), F.lit(0)), F.lit(False))
    r = r.withColumn("_ok", whole).filter(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("the page is short")).cast("boolean")))
    e = r.select(key, "offset", F.posexplode("r.entries").alias("i", "e"))
    return e.select(key, (F.col("offset") + F.col("i")).alias("pos"), *_edition(F.col("e")))


def edition(records: DataFrame, key: str, text: str) -> DataFrame:
    """Single editions from stored records."""
    e = records.select(key, F.from_json(text, f"struct<{_colons(EDITION)}>").alias("e"))
    return e.select(key, *_edition(F.col("e")))


def _colons(fields: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in fields.split(", "))


def works(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Works of stored result pages: ``key, pos, id, title, doi, year, type, retracted`` and the stated total."""
    r = pages.select(key, F.from_json(text, "struct<meta:struct<count:bigint>,results:array<struct<id:string,display_name:string,doi:string,publication_year:int,type:string,is_retracted:boolean>>>").alias("r"))
    w = r.select(key, F.col("r.meta.count").alias("total"), F.posexplode("r.results").alias("pos", "w"))
    return w.select(key, "total", "pos", F.regexp_extract("w.id", "(W[0-9]+)$", 1).alias("id"), F.col("w.display_name").alias("title"), canonical_doi("w.doi").alias("doi"), F.col("w.publication_year").alias("year"),
                    F.col("w.type").alias("type"), F.coalesce("w.is_retracted", F.lit(False)).alias("retracted"))


def latest_version(listings: DataFrame, key: str, xml: str) -> DataFrame:
    """The newest version that an object listing distributes: ``key, paper, version, versions``; a listing that is cut off, or repeats a version, gives none."""
    x = F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', "")
    stems = F.transform(F.xpath(x, F.lit("//CommonPrefixes/Prefix/text()")), lambda p: F.concat(F.lit("pmc:"), F.regexp_replace(p, "/$", "")))
    r = listings.select(key, F.transform(stems, accession_parts).alias("v"), (F.xpath_string(x, F.lit("//IsTruncated")) == "false").alias("whole"))
    numbers = F.transform("v", lambda v: v["version"])
    good = F.col("whole") & (F.size("v") > 0) & F.forall("v", lambda v: v.isNotNull() & (v["version"] > 0)) & (F.size(F.array_distinct(numbers)) == F.size("v")) & (F.size(F.array_distinct(F.transform("v", lambda v: v["paper"]))) == 1)
    return r.filter(good).select(key, F.get("v", F.lit(0))["paper"].alias("paper"), F.array_max(numbers).alias("version"), F.size("v").alias("versions"))


def bitstreams(items: DataFrame, key: str, text: str) -> DataFrame:
    """Original bitstreams of repository items: ``key, pos, uuid, name, media, bytes, md5``; withdrawn items and other bundles have none."""
    r = items.select(key, F.from_json(text, "struct<handle:string,archived:string,withdrawn:string,bitstreams:array<struct<uuid:string,name:string,bundleName:string,mimeType:string,sizeBytes:string,checkSum:struct<value:string,checkSumAlgorithm:string>>>>").alias("r"))
    b = r.filter(~F.coalesce(flag_state("r.withdrawn") == "true", F.lit(False))).select(key, F.posexplode("r.bitstreams").alias("pos", "b")).filter("b.bundleName = 'ORIGINAL'")
    return b.select(key, "pos", F.col("b.uuid").alias("uuid"), F.col("b.name").alias("name"), F.col("b.mimeType").alias("media"), json_size("b.sizeBytes").alias("bytes"), F.when(F.col("b.checkSum.checkSumAlgorithm") == "MD5", F.lower("b.checkSum.value")).alias("md5"))


def project_sections(projects: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of audio projects with their readers: ``key, number, title, seconds, reader_id, reader``; one row for each reader of a section, one without where it has none."""
    r = projects.select(key, F.from_json(text, "struct<books:array<struct<id:string,title:string,sections:array<struct<section_number:string,title:string,playtime:string,readers:array<struct<reader_id:string,display_name:string>>>>>>>").alias("r"))
    s = r.filter(F.size("r.books") == 1).select(key, F.explode(F.get("r.books", F.lit(0))["sections"]).alias("s"))
    n = s.select(key, F.col("s.section_number").try_cast("int").alias("number"), F.col("s.title").alias("title"), declared_seconds("s.playtime").alias("seconds"), F.explode_outer("s.readers").alias("reader"))
    return n.select(key, "number", "title", "seconds", F.col("reader.reader_id").alias("reader_id"), F.col("reader.display_name").alias("reader"))


def declared_recordings(files: DataFrame, key: str) -> DataFrame:
    """Recordings that an item's files declare: audio files of one format with track numbers 1..n, each once.

    ``files`` as of ``item_files``. Columns: ``key, format, tracks, bytes, seconds``; a format with a gap or a repeated number declares none.
    """
    a = files.filter("kind = 'audio_candidate' AND track IS NOT NULL")
    g = a.groupBy(key, "format").agg(F.max("track").alias("tracks"), F.count(F.lit(1)).alias("n"), F.count_distinct("track").alias("d"), F.sum("declared_bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
    return g.filter("n = d AND n = tracks").select(key, "format", "tracks", "bytes", "seconds")


def repository_record(records: DataFrame, key: str, xml: str) -> DataFrame:
    """OAI records of papers: id, title, authors and versions; ``version`` is the newest stated, null where none is."""
    x = F.regexp_replace(F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', ""), r"(</?|\s)\w+:(\w+)", "$1$2")
    one = lambda p: F.element_at(F.concat(_texts(x, p), F.array(F.lit(None).cast("string"))), 1)
    numbers = F.transform(F.xpath(x, F.lit("//version/@version")), lambda v: F.regexp_extract(v, "^v([1-9][0-9]{0,3})$", 1).try_cast("int"))
    return records.select(key, one("//metadata//id").alias("id"), one("//metadata//title").alias("title"), _texts(x, "//metadata//author/keyname").alias("authors"), F.array_max(F.filter(numbers, lambda v: v.isNotNull())).alias("version"))


def bounded_fields(records: DataFrame, key: str, xml: str, bounds: dict[str, int], most_values: int = 100) -> DataFrame:
    """Texts of elements of bibliographic RDF with a bound for each: ``key, field, values, refused`` (too long or too many)."""
    x = F.regexp_replace(F.regexp_replace(F.col(xml), r'\sxmlns(?::\w+)?="[^"]*"', ""), r"(</?|\s)\w+:(\w+)", "$1$2")
    each = F.array(*[F.struct(F.lit(n).alias("field"), _texts(x, f"//{n}").alias("v"), F.lit(b).alias("b")) for n, b in bounds.items()])
    r = records.select(key, F.explode(each).alias("f"))
    bad = (F.size("f.v") > most_values) | F.exists("f.v", lambda v: F.octet_length(v) > F.col("f.b"))
    return r.select(key, "f.field", F.when(~bad, F.col("f.v")).alias("values"), bad.alias("refused"))
