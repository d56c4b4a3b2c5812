"""Queries over the catalogue: search, lookup, listing, identifiers, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import search
from shelfmark.session import table

#: White space in RE2 and in Spark patterns.
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _split(c: str, m: str) -> str:
    """A list in one string, split in DuckDB."""
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), '{m}'), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> '')"


_SQL_LISTS = ", ".join(f"{_split(c, ';')} AS {c}" for c in ("authors", "subjects", "bookshelves"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as typed records with list columns."""
    c = table(spark, sf_dir, "gutenberg_catalog")
    return c.withColumns({k: S.split_list(k) for k in ("authors", "subjects", "bookshelves")} | {"folded_title": S.fold_column("title")})


def _topics():
    return F.concat("subjects", "bookshelves")


def catalog_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a search text with their rank."""
    return search.ranked(catalog(spark, sf_dir), "lamp", "text_num", "title", F.col("authors"), _topics()).select("row_id", "rank")


_RANK = """CASE WHEN coalesce(CAST(text_num AS VARCHAR) = '{q}', false) OR coalesce(contains(lower(title), '{q}'), false) THEN 0
 WHEN len(list_filter(authors, lambda x: contains(lower(x), '{q}'))) > 0 THEN 1
 WHEN len(list_filter(list_concat(subjects, bookshelves), lambda x: contains(lower(x), '{q}'))) > 0 THEN 2 END"""
_CATALOG = f"SELECT row_id, text_num, title, languages, issued, {_SQL_LISTS} FROM gutenberg_catalog"


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the ranked search, with the exact total."""
    hits = search.ranked(catalog(spark, sf_dir), "harvest", "text_num", "title", F.col("authors"), _topics()).select("row_id", "text_num", "title", "rank")
    return search.with_total(hits, [F.col("rank"), F.col("text_num").asc_nulls_last(), F.col("row_id")], 10, 5)


def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup: every row of one text number."""
    c = table(spark, sf_dir, "gutenberg_catalog")
    return c.filter("text_num = 10035").select("row_id", "text_num", "title")


def catalog_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain lists by semicolon and code lists by semicolon or comma."""
    c = table(spark, sf_dir, "gutenberg_catalog")
    return c.select("row_id", F.size(S.split_list("subjects")).cast("long").alias("n_subjects"), F.array_join(S.split_codes("languages"), "+").alias("codes"),
                    F.array_join(S.split_list("locc"), "+").alias("classes"))


def catalog_language_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have each declared tag and what its base language is."""
    c = table(spark, sf_dir, "gutenberg_catalog").select(F.explode(S.split_codes("languages")).alias("tag"))
    return c.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("base", S.language_base("tag"))


def catalog_language_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued language filter of the catalogue, counted."""
    c = table(spark, sf_dir, "gutenberg_catalog").select(S.language_match(S.split_codes("languages"), "fr").alias("matched"))
    return c.groupBy("matched").agg(F.count(F.lit(1)).alias("n"))


_CODES = f"""CASE WHEN contains(x, ';') THEN {_split('x', ';')}
 WHEN len(list_filter({_split('x', ',')}, lambda v: NOT regexp_matches(v, '^[A-Za-z0-9-]+$'))) = 0 THEN {_split('x', ',')}
 ELSE list_filter([x], lambda v: v <> '') END"""
_LANG_X = f"SELECT *, trim(regexp_replace(coalesce(languages, ''), '{WS}+', ' ', 'g')) AS x FROM gutenberg_catalog"
#: The languages of the catalogue, each its own base.
_LANG_ROWS = "('cy','cy'),('da','da'),('de','de'),('en','en'),('eo','eo'),('es','es'),('fi','fi'),('fr','fr'),('is','is'),('ja','ja'),('la','la'),('myn','myn'),('nl','nl'),('oc','oc'),('pt','pt'),('ru','ru')"


def catalog_issue_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue dates by shape, for each kind."""
    c = table(spark, sf_dir, "gutenberg_catalog")
    shape = F.when(F.col("issued").isNull(), "none").when(S.date_shape("issued"), "date").otherwise("other")
    return c.groupBy("kind", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def holdings_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive filter over documents by source, language and text, newest state by id, one page."""
    d = table(spark, sf_dir, "documents").filter((F.col("source") == "verse") & (S.language_base("lang") == "en") & search.has("text", "lamp"))
    return search.page(d.select("doc_id", "lang", "n_chars"), [F.col("doc_id")], 20, 3, most=100, furthest=100_000)


def holdings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals beside a page: matches and rows of unknown language, for each source."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count_if(search.has("text", "lamp")).alias("matches"), F.count_if(S.language_base("lang").isNull()).alias("unknown_language"), F.count(F.lit(1)).alias("total"))


def resources_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring over scalar and nested array columns of the curated resources."""
    r = table(spark, sf_dir, "discovery_validation")
    q = "epub"
    hit = search.has("title", q) | search.has("rationale", q) | search.has("landing_url", q) | search.any_has("authors", q) | search.any_has(F.col("assets.name"), q) | search.any_has(F.col("assets.format"), q)
    return r.filter(hit).select("resource_no", F.size("assets").cast("long").alias("n_assets"))


def resource_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offered files of the resources with their kinds."""
    a = table(spark, sf_dir, "discovery_validation").select("resource_no", F.posexplode("assets").alias("i", "a"))
    return a.select("resource_no", F.col("i").cast("long").alias("ord"), F.col("a.name").alias("name"), S.file_kind("a.name").alias("kind"))


_EXT = "regexp_extract(lower(a.name), '\\.([^./\\\\]*)$', 1)"
_KIND_SQL = f"CASE {_EXT} WHEN 'epub' THEN 'ebook_candidate' WHEN 'pdf' THEN 'pdf_candidate' WHEN 'mp3' THEN 'audio_candidate' WHEN 'm4b' THEN 'audio_candidate' WHEN 'm4a' THEN 'audio_candidate' WHEN 'zip' THEN 'archive_candidate' ELSE 'other' END"


def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of several sources, kept apart."""
    parts = {
        "part": table(spark, sf_dir, "part").filter(search.has("p_name", "green")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")),
        "customer": table(spark, sf_dir, "customer").filter(search.has("c_mktsegment", "build")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")),
    }
    return search.first_per_source(parts, "id", 7)


def part_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search of parts: a name before a brand before a type."""
    p = table(spark, sf_dir, "part")
    hits = search.ranked(p, "bolt", "p_partkey", "p_name", F.array("p_brand"), F.array("p_type"))
    return search.page(hits.select("rank", "p_partkey", "p_name"), [F.col("rank"), F.col("p_partkey")], 15, 10)


def isbn_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits and the 13-digit form of numbers made from part keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.element_at(F.split(F.lit("0123456789X"), ""), (F.col("p_partkey") % 11 + 1).cast("int"))).alias("x"))
    return p.select("p_partkey", S.isbn10_ok("x").alias("ok10"), S.isbn13_of("x").alias("isbn13"), S.isbn13_ok(F.concat(F.lit("9780"), F.substring("x", 2, 9))).alias("ok13"))


_D10 = "list_sum(list_transform(range(1, 11), lambda i: (CASE WHEN x[i] = 'X' THEN 10 ELSE CAST(x[i] AS INTEGER) END) * (11 - i))) % 11 = 0"
_S12 = "list_sum(list_transform(range(1, 13), lambda i: CAST(('978' || x[1:9])[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))"
_S13 = "list_sum(list_transform(range(1, 14), lambda i: CAST(y[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0"


def identifier_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which grammar the identifiers of the resources follow."""
    r = table(spark, sf_dir, "discovery_validation")
    named = F.concat(F.lit("gutenberg:"), F.col("text_num").cast("string"))
    return r.select("resource_no", S.has_grammar("res_id", "resource").alias("resource_id"), S.has_grammar(named, "gutenberg").alias("text_id"),
                    S.canonical_doi(F.concat(F.lit("https://doi.org/10.1234/"), F.upper("res_id"))).alias("doi"), S.portable_path(F.concat(F.lit("a/"), "res_id")).alias("portable"))


def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels in roman and letter styles, packed and scaled numbers of the parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return p.select("p_partkey", S.roman("n").alias("roman"), S.letters_label("n").alias("letters"), S.scaled_ms("p_partkey", "n").alias("ms"),
                    S.packed_language(F.lit(1057) * (F.col("n") % 26 + 1)).alias("lang"), S.syncsafe(F.col("p_partkey") * 128).alias("syncsafe"))


def seconds_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations written as seconds, minutes or hours."""
    t = table(spark, sf_dir, "audio_tracks").select("track_id", (F.col("encoded_duration_ms") / 1000).cast("long").alias("s"))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(F.col("track_id") % 3 == 0, F.col("s").cast("string")).when(
        F.col("track_id") % 3 == 1, F.concat_ws(":", F.floor(F.col("s") / 60).cast("string"), pad(F.col("s") % 60))).otherwise(
        F.concat_ws(":", F.floor(F.col("s") / 3600).cast("string"), pad(F.floor(F.col("s") / 60) % 60), pad(F.col("s") % 60)))
    return t.select("track_id", F.when(F.col("s").isNotNull(), S.declared_seconds(text)).alias("seconds"))


def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable keys of ASCII titles, and whether each is one bounded line."""
    c = table(spark, sf_dir, "gutenberg_catalog").filter("title IS NOT NULL")
    return c.select("row_id", S.slug("title").alias("slug"), S.one_line("title", 200).alias("one_line"))


QUERIES = {f.__name__: f for f in (catalog_ranked, catalog_page, catalog_lookup, catalog_split_lists, catalog_language_base, catalog_language_match, catalog_issue_shape,
                                   holdings_filter, holdings_totals, resources_any_field, resource_assets, search_sources, part_search_page, isbn_forms,
                                   identifier_grammar, number_labels, seconds_parse, title_slugs)}
_Q = "contains(lower({c}), 'epub')"
SQL = {
    "catalog_ranked": f"SELECT * FROM (SELECT row_id, {_RANK.format(q='lamp')} AS rank FROM ({_CATALOG})) WHERE rank IS NOT NULL",
    "catalog_page": f"WITH h AS (SELECT * FROM (SELECT row_id, text_num, title, {_RANK.format(q='harvest')} AS rank FROM ({_CATALOG})) WHERE rank IS NOT NULL) "
                    "SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY rank, text_num NULLS LAST, row_id LIMIT 10 OFFSET 5",
    "catalog_lookup": "SELECT row_id, text_num, title FROM gutenberg_catalog WHERE text_num = 10035",
    "catalog_split_lists": f"SELECT row_id, CAST(len({_split('subjects', ';')}) AS BIGINT) AS n_subjects, array_to_string({_CODES}, '+') AS codes, "
                           f"array_to_string({_split('locc', ';')}, '+') AS classes FROM ({_LANG_X})",
    "catalog_language_base": f"WITH l(form, base) AS (VALUES {_LANG_ROWS}), t AS (SELECT unnest({_CODES}) AS tag FROM ({_LANG_X})), g AS (SELECT tag, count(*) AS n FROM t GROUP BY tag) "
                             "SELECT tag, n, base FROM g LEFT JOIN l ON form = regexp_extract(lower(tag), '^([a-z]{2,3})([-_][a-z0-9]{1,8})*$', 1)",
    "catalog_language_match": f"WITH l(form, base) AS (VALUES {_LANG_ROWS}), t AS (SELECT row_id, unnest({_CODES}) AS tag FROM ({_LANG_X})), "
                              "b AS (SELECT row_id, bool_or(base = 'fr') AS m FROM t LEFT JOIN l ON form = regexp_extract(lower(tag), '^([a-z]{2,3})([-_][a-z0-9]{1,8})*$', 1) WHERE base IS NOT NULL GROUP BY row_id) "
                              "SELECT m AS matched, count(*) AS n FROM gutenberg_catalog LEFT JOIN b USING (row_id) GROUP BY m",
    "catalog_issue_shape": "SELECT kind, CASE WHEN issued IS NULL THEN 'none' WHEN regexp_matches(issued, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' ELSE 'other' END AS shape, count(*) AS n FROM gutenberg_catalog GROUP BY ALL",
    "holdings_filter": "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'verse' AND lang = 'en' AND contains(lower(text), 'lamp') ORDER BY doc_id LIMIT 20 OFFSET 3",
    "holdings_totals": "SELECT source, count_if(coalesce(contains(lower(text), 'lamp'), false)) AS matches, count_if(lang IS NULL) AS unknown_language, count(*) AS total FROM documents GROUP BY source",
    "resources_any_field": "SELECT resource_no, CAST(len(assets) AS BIGINT) AS n_assets FROM discovery_validation WHERE coalesce(contains(lower(title), 'epub'), false) OR coalesce(contains(lower(rationale), 'epub'), false) "
                           "OR coalesce(contains(lower(landing_url), 'epub'), false) OR coalesce(len(list_filter(authors, lambda x: contains(lower(x), 'epub'))) > 0, false) "
                           "OR coalesce(len(list_filter(assets, lambda x: contains(lower(x.name), 'epub') OR contains(lower(x.format), 'epub'))) > 0, false)",
    "resource_assets": f"SELECT resource_no, ord, a.name AS name, {_KIND_SQL} AS kind FROM (SELECT resource_no, unnest(assets) AS a, unnest(range(len(assets))) AS ord FROM discovery_validation)",
    "search_sources": "SELECT 'part' AS source, row_number() OVER (ORDER BY p_partkey) AS pos, p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'green') QUALIFY pos <= 7 "
                      "UNION ALL SELECT 'supplier', row_number() OVER (ORDER BY s_suppkey) AS pos, s_suppkey, s_name FROM supplier QUALIFY pos <= 7 "
                      "UNION ALL SELECT 'customer', row_number() OVER (ORDER BY c_custkey) AS pos, c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'build') QUALIFY pos <= 7",
    "part_search_page": "SELECT * FROM (SELECT CASE WHEN contains(lower(p_name), 'bolt') THEN 0 WHEN contains(lower(p_brand), 'bolt') THEN 1 WHEN contains(lower(p_type), 'bolt') THEN 2 END AS rank, p_partkey, p_name FROM part) WHERE rank IS NOT NULL ORDER BY rank, p_partkey LIMIT 15 OFFSET 10",
    "isbn_forms": f"SELECT p_partkey, {_D10} AS ok10, CASE WHEN {_D10} THEN '978' || x[1:9] || CAST((10 - {_S12} % 10) % 10 AS VARCHAR) END AS isbn13, "
                  f"CASE WHEN y LIKE '%X%' THEN false ELSE {_S13.replace('CAST(y[i] AS INTEGER)', 'TRY_CAST(y[i] AS INTEGER)')} END AS ok13 "
                  "FROM (SELECT *, '9780' || x[2:10] AS y FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '0123456789X'[CAST(p_partkey % 11 + 1 AS INTEGER)] AS x FROM part))",
    "identifier_grammar": "SELECT resource_no, regexp_matches(res_id, '^[a-z0-9][a-z0-9._-]{0,100}$') AS resource_id, regexp_matches('gutenberg:' || CAST(text_num AS VARCHAR), '^gutenberg:[1-9][0-9]{0,7}$') AS text_id, "
                          "'10.1234/' || lower(res_id) AS doi, NOT regexp_matches(res_id, '[<>:\"\\\\|?*/]|[. ]$') AS portable FROM discovery_validation",
    "number_labels": "SELECT p_partkey, repeat('m', CAST(n // 1000 AS INTEGER)) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][CAST(n // 100 % 10 AS INTEGER) + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(n // 10 % 10 AS INTEGER) + 1] "
                     "|| ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 AS INTEGER) + 1] AS roman, repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), CAST((n - 1) // 26 + 1 AS INTEGER)) AS letters, CAST(p_partkey * 1000 // n AS BIGINT) AS ms, "
                     "repeat(chr(CAST(97 + n % 26 AS INTEGER)), 3) AS lang, CAST((p_partkey * 128 & 127) + ((p_partkey * 128 >> 8) & 127) * 128 + ((p_partkey * 128 >> 16) & 127) * 16384 + ((p_partkey * 128 >> 24) & 127) * 2097152 AS BIGINT) AS syncsafe FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n FROM part)",
    "seconds_parse": "SELECT track_id, CAST(encoded_duration_ms // 1000 AS DOUBLE) AS seconds FROM audio_tracks",
    "title_slugs": "SELECT row_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] || '-' || sha256(title)[1:8] AS slug, "
                   "strlen(title) BETWEEN 1 AND 200 AND NOT regexp_matches(title, '[\\x00\\r\\n]') AS one_line FROM gutenberg_catalog WHERE title IS NOT NULL",
}
