"""Queries over identifiers, tokens, JSON values, reading times and ranges of text, with SQL that states the rule on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import codecs, identifiers, scalars
from shelfmark.operators import text
from shelfmark.session import table
from shelfmark.sources import sinks

#: What stands as a stated identifier in each row of the catalogue, in SQL that both engines read: eight kinds by turns.
_RAW = """CASE row_id % 8 WHEN 0 THEN concat('urn:isbn:978', lpad(CAST(text_num AS VARCHAR(20)), 9, '0'), CAST(row_id % 10 AS VARCHAR(20))) WHEN 1 THEN concat('https://doi.org/10.1234/', CAST(text_num AS VARCHAR(20)))
 WHEN 2 THEN concat('doi:10.12/a b', CAST(text_num AS VARCHAR(20))) WHEN 3 THEN concat('https://openlibrary.org/works/OL', CAST(text_num AS VARCHAR(20)), 'W') WHEN 4 THEN concat('https://openlibrary.org/books/ol', CAST(text_num AS VARCHAR(20)), 'm/')
 WHEN 5 THEN concat('urn:uuid:', CAST(row_id AS VARCHAR(20))) WHEN 6 THEN '   ' ELSE concat(' 0-306-40615-', CAST(row_id % 10 AS VARCHAR(20)), ' ') END"""


def package_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, id and confidence of an identifier stated by every row."""
    d = table(spark, sf_dir, "gutenberg_catalog").select("row_id", F.expr(_RAW).alias("raw"), F.when(F.col("row_id") % 8 == 7, "ISBN").otherwise("").alias("scheme"))
    i = d.select("row_id", identifiers.package_identity("raw", "scheme").alias("i"))
    return i.select("row_id", "i.role", "i.id", "i.confidence")


def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and id of a declared field of every row; what names neither an edition nor a work has none."""
    field = F.element_at(F.array(*map(F.lit, ("isbn", "external-identifier", "openlibrary_edition", "openlibrary_work", "other"))), (F.col("row_id") % 5 + 1).cast("int"))
    value = F.when(F.col("row_id") % 5 == 0, F.lit("0-306-40615-2")).when(F.col("row_id") % 5 == 1, F.lit("URN:ISBN:9780306406157")).when(F.col("row_id") % 5 == 2, F.concat(F.lit("ol"), "text_num", F.lit("m"))).otherwise(
        F.concat(F.lit("OL"), "text_num", F.lit("W")))
    d = table(spark, sf_dir, "gutenberg_catalog").select("row_id", identifiers.source_identity(field, value).alias("i"))
    return d.select("row_id", "i.role", "i.id")


def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers and versions of ids of the new and the old scheme, made from every order line."""
    n = F.col("l_orderkey") * 37 + F.col("l_linenumber")
    new = F.concat(F.lpad(n % 10000, 4, "0"), F.lit("."), F.lpad(F.col("l_partkey") % 10000, 4, "0"), F.when(F.col("l_linenumber") % 2 == 0, "7").otherwise(""))
    old = F.concat(F.lit("hep-th/"), F.lpad(n % 10000, 4, "0"), F.lpad(F.col("l_partkey") % 1000, 3, "0"))
    raw = F.concat(F.when(F.col("l_suppkey") % 10 == 0, "").otherwise("arxiv:"), F.when(F.col("l_suppkey") % 2 == 0, new).otherwise(old), F.when(F.col("l_quantity") < 25, "").otherwise(F.concat(F.lit("v"), F.col("l_linenumber") - 1)))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", scalars.arxiv_parts(raw).alias("p"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p.paper", "p.version", scalars.pdf_name("p.paper", "p.version").alias("pdf"))


def accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accession ids of every text with their version and the name of their file, and handles."""
    raw = F.concat(F.lit("pmc:PMC"), "text_num", F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("."), F.col("row_id") % 4)).otherwise(""))
    handle = F.concat(F.lit("oapen:20.500.12657/"), F.when(F.col("row_id") % 2 == 0, F.col("text_num").cast("string")).otherwise("x"))
    archive = F.concat(F.lit("archive:"), F.when(F.col("row_id") % 2 == 0, "item_").otherwise("_item"), "row_id")
    d = table(spark, sf_dir, "gutenberg_catalog").filter("text_num > 0").select("row_id", identifiers.accession_parts(raw).alias("p"), identifiers.handle_number(handle).alias("handle"), scalars.has_grammar(archive, "archive").alias("archive_ok"))
    return d.select("row_id", "p.paper", "p.version", identifiers.accession_pdf("p.paper", "p.version").alias("pdf"), "handle", "archive_ok")


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portable file name for every title."""
    return table(spark, sf_dir, "gutenberg_catalog").select("row_id", identifiers.file_stem("title", F.sha2(F.coalesce("title", F.lit("")), 256)).alias("stem"))


def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain query from the title and the first author of every resource."""
    first = F.get(F.col("authors"), F.lit(0))
    return table(spark, sf_dir, "discovery_validation").select("resource_no", identifiers.search_words("title", first).alias("words"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, lists and sizes read from JSON values of six kinds, one for every event."""
    kinds = ['"text"', '["a","b"]', "17", "null", '["a",1]', '"17"', "-3", "{bad"]
    raw = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return d.select("event_id", codecs.json_text("raw").alias("one"), F.array_join(codecs.json_texts("raw"), "|").alias("many"), codecs.json_size("raw").alias("size"))


def evidence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference to evidence for every document, read back; a changed one is refused."""
    sha = lambda c: F.sha2(F.concat(F.lit(c), F.col("doc_id").cast("string")), 256)
    fields = {"asset_id": F.concat(F.lit("sha256:"), sha("a")), "library_id": F.concat(F.lit("library:"), F.substring(sha("l"), 1, 32)), "holding_sha256": sha("h"), "metadata_sha256": sha("m"),
              "extractor": F.lit("epub-text/2"), "representation_id": F.concat(F.lit("sha256:"), sha("r")), "retrieval_sha256": sha("t")}
    d = table(spark, sf_dir, "documents").select("doc_id", codecs.evidence_token(fields).alias("token"))
    d = d.withColumns({"read": codecs.read_evidence("token"), "changed": codecs.read_evidence(F.concat("token", F.lit("A")))})
    return d.select("doc_id", "token", F.col("read.holding_sha256").alias("holding_sha256"), F.col("changed").isNull().alias("refused"))


def dwell_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pause and display time of every word of every rationale, and of a gap and a break in its place."""
    d = table(spark, sf_dir, "discovery_validation").select("resource_no", F.posexplode(F.split("rationale", " ")).alias("pos", "word"))
    return d.select("resource_no", "pos", "word", scalars.pause_class("word").alias("pause"), scalars.dwell_ms("word", 250).alias("ms"), scalars.dwell_ms("word", 5000, F.lit("gap")).alias("gap_ms"),
                    scalars.dwell_ms("word", 250, F.lit("break")).alias("break_ms"), scalars.dwell_ms("word", 50, F.lit("word"), F.lit("paragraph")).alias("last_ms"))


def word_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter of every part's name that the eye rests on, and the name in chunks of four cells."""
    d = table(spark, sf_dir, "part").select("p_partkey", codecs.focus_udf("p_name").alias("f"), codecs.grapheme_chunks_udf(4)("p_name").alias("c"))
    return d.select("p_partkey", "f.before", "f.focus", "f.after", F.array_join("c", "|").alias("chunks"))


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges of every document: its first 64 bytes, and 40 bytes from byte 50, which is refused inside a character."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.read_range("text", 0, 64).alias("a"), text.read_range("text", 50, 40).alias("b"))
    return d.select("doc_id", F.col("a.status").alias("a_status"), F.col("a.text").alias("a_text"), F.col("a.end").cast("long").alias("a_end"), F.col("b.status").alias("b_status"),
                    F.col("b.text").alias("b_text"), F.col("b.end").cast("long").alias("b_end"), F.col("b.end_of_unit").alias("b_last"))


def words_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its byte place and pause."""
    return text.words_with_offsets(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("ord", F.col("ord").cast("long"))


def first_words_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word at or after bytes 0, 1,000 and the end of every document."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    words = text.words_with_offsets(d, "doc_id", "text").select("doc_id", F.col("start_byte").alias("at"))
    points = d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1000), F.octet_length("text")).cast("array<long>")).alias("at"), F.lit("p").alias("what"))
    return text.first_at_or_after(points, words, "doc_id", "at").select("doc_id", "at", "item_at")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and line breaks of every document in one order, counted by kind, with the last place of each."""
    d = table(spark, sf_dir, "documents")
    breaks = text.locate(d.filter("text IS NOT NULL"), "doc_id", "text", "\n").select("doc_id", F.col("start_byte").alias("at"))
    gaps = text.locate(d.filter("text IS NOT NULL"), "doc_id", "text", "[").select("doc_id", F.col("start_byte").alias("at"), F.lit("bracket").alias("kind"))
    i = text.items_of(text.words_with_offsets(d, "doc_id", "text"), "doc_id", "start_byte", breaks, gaps)
    return i.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document laid out in lines of 72 cells. Each line depends on the one before: tested by brute force."""
    return text.line_layout(table(spark, sf_dir, "documents"), "doc_id", "text", 72)


def escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a JSON line and read back: nothing is lost, and no format character is left in the line."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", sinks.escaped_json("doc_id", "text").alias("line"))
    return d.select("doc_id", F.sha2(F.from_json("line", "doc_id long, text string").getField("text"), 256).alias("sha256"), F.col("line").rlike("[\\p{Cf}\\p{Cc}]").alias("unescaped"))


_NAMES = (package_identities, source_identities, paper_ids, accessions, file_stems, search_suggestions, json_values, evidence_tokens, dwell_times, word_focus, read_range, words_with_offsets,
          first_words_after, text_items, text_lines, escaped_lines)
QUERIES = {f.__name__: f for f in _NAMES}

_WHITE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words with their places: white space and words of a text by turns, their bytes added up.
_WORDS = f"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^{_WHITE}]+') AS w, string_split_regex(text, '[^{_WHITE}]+') AS g FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS word, unnest(g[1:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS ord FROM s),
words AS (SELECT doc_id, ord, word, CAST(sum(strlen(gap)) OVER o + coalesce(sum(strlen(word)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY ord))"""
_PAUSE = """CASE WHEN regexp_matches({w}, '[.!?…。！？]["'')\\]}}’”»」』）]*$') THEN 'sentence' WHEN regexp_matches({w}, '[,;:，、；：]["'')\\]}}’”»」』）]*$') THEN 'clause' ELSE 'none' END"""
_CUT = "list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({t}, k)) <= {n}))"

SQL = {
    "package_identities": f"""WITH r AS (SELECT row_id, text_num, {_RAW} AS raw, lpad(CAST(text_num AS VARCHAR), 9, '0') AS nine FROM gutenberg_catalog),
        c AS (SELECT *, (10 - (38 + list_sum(list_transform(range(1, 10), lambda i: CAST(nine[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10 AS digit FROM r),
        g AS (SELECT *, CASE WHEN row_id % 8 = 0 AND digit = row_id % 10 THEN 'edition' WHEN row_id % 8 = 1 THEN 'publication_version' WHEN row_id % 8 = 3 THEN 'work' WHEN row_id % 8 = 4 THEN 'edition' WHEN row_id % 8 = 7 AND row_id % 10 = 2 THEN 'edition' ELSE 'unassigned' END AS role FROM c)
        SELECT row_id, CASE WHEN row_id % 8 <> 6 THEN role END AS role, CASE WHEN row_id % 8 = 6 THEN NULL WHEN role = 'unassigned' THEN 'stated:' || sha256(CASE WHEN row_id % 8 = 7 THEN 'ISBN' ELSE '' END || chr(10) || trim(raw))
          WHEN row_id % 8 = 0 THEN 'isbn:978' || nine || digit WHEN row_id % 8 = 1 THEN 'doi:10.1234/' || text_num WHEN row_id % 8 = 3 THEN 'openlibrary_work:OL' || text_num || 'W' WHEN row_id % 8 = 4 THEN 'openlibrary_edition:OL' || text_num || 'M' ELSE 'isbn:0306406152' END AS id,
          CASE WHEN row_id % 8 = 6 THEN NULL WHEN role = 'unassigned' THEN 'preserved' ELSE 'stated' END AS confidence FROM g""",
    "source_identities": """SELECT row_id, CASE row_id % 5 WHEN 0 THEN 'edition' WHEN 1 THEN 'edition' WHEN 2 THEN 'edition' WHEN 3 THEN 'work' END AS role,
        CASE row_id % 5 WHEN 0 THEN 'isbn:0306406152' WHEN 1 THEN 'isbn:9780306406157' WHEN 2 THEN 'openlibrary_edition:OL' || text_num || 'M' WHEN 3 THEN 'openlibrary_work:OL' || text_num || 'W' END AS id FROM gutenberg_catalog""",
    "paper_ids": """WITH a AS (SELECT *, (l_orderkey * 37 + l_linenumber) % 10000 AS ym, l_suppkey % 2 = 0 AS new, l_linenumber % 2 = 0 AS five, CASE WHEN l_quantity < 25 THEN 0 ELSE l_linenumber - 1 END AS v FROM lineitem),
        b AS (SELECT *, l_suppkey % 10 <> 0 AND ym % 100 BETWEEN 1 AND 12 AND (l_quantity < 25 OR v > 0) AND CASE WHEN new THEN (NOT five AND ym BETWEEN 704 AND 1412) OR (five AND ym >= 1501) ELSE ym >= 9108 OR ym <= 703 END AS ok FROM a),
        c AS (SELECT *, CASE WHEN ok THEN CASE WHEN new THEN lpad(CAST(ym AS VARCHAR), 4, '0') || '.' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN five THEN '7' ELSE '' END ELSE 'hep-th/' || lpad(CAST(ym AS VARCHAR), 4, '0') || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') END END AS paper FROM b)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, paper, CASE WHEN ok THEN v END AS version, replace(paper, '/', '_') || 'v' || CAST(v AS INTEGER) || '.pdf' AS pdf FROM c""",
    "accessions": """WITH a AS (SELECT *, CASE WHEN row_id % 3 = 0 THEN row_id % 4 ELSE 0 END AS v, row_id % 3 <> 0 OR row_id % 4 <> 0 AS ok FROM gutenberg_catalog WHERE text_num > 0)
        SELECT row_id, CASE WHEN ok THEN 'PMC' || text_num END AS paper, CAST(CASE WHEN ok THEN v END AS INTEGER) AS version, CASE WHEN ok THEN 'PMC' || text_num || '.' || v || '.pdf' END AS pdf, CASE WHEN row_id % 2 = 0 THEN CAST(text_num AS VARCHAR) END AS handle, row_id % 2 = 0 AS archive_ok FROM a""",
    "file_stems": r"""WITH a AS (SELECT row_id, sha256(coalesce(title, '')) AS h, array_to_string(list_filter(string_split_regex(regexp_replace(coalesce(title, ''), '[^\p{L}\p{Nd} \-_.,/\\]', '', 'g'), '[ \-_.,/\\]+'), lambda x: x <> ''), '-') AS j FROM gutenberg_catalog),
        b AS (SELECT row_id, h, regexp_replace(left(j, 80), '-+$', '') AS s FROM a) SELECT row_id, CASE WHEN s = '' THEN left(h, 16) ELSE s || '-' || left(h, 8) END AS stem FROM b""",
    "search_suggestions": r"""SELECT resource_no, trim(left(trim(trim(regexp_replace(coalesce(title, ''), '[":()\s\x00-\x1f\x7f\x0b]+', ' ', 'g')) || ' ' || trim(regexp_replace(coalesce(authors[1], ''), '[":()\s\x00-\x1f\x7f\x0b]+', ' ', 'g'))), 200)) AS words FROM discovery_validation""",
    "json_values": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'text' WHEN 5 THEN '17' ELSE '' END AS one, CASE event_id % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'a|b' WHEN 3 THEN '' WHEN 5 THEN '17' END AS many, CAST(CASE event_id % 8 WHEN 2 THEN 17 WHEN 5 THEN 17 END AS BIGINT) AS size FROM events""",
    "evidence_tokens": """WITH j AS (SELECT doc_id, '{"schema_version":1,"asset_id":"sha256:' || sha256('a' || doc_id) || '","library_id":"library:' || left(sha256('l' || doc_id), 32) || '","holding_sha256":"' || sha256('h' || doc_id) || '","metadata_sha256":"' || sha256('m' || doc_id)
        || '","extractor":"epub-text/2","representation_id":"sha256:' || sha256('r' || doc_id) || '","retrieval_sha256":"' || sha256('t' || doc_id) || '"}' AS j FROM documents)
        SELECT doc_id, 'evidence1.' || rtrim(replace(replace(to_base64(encode(j)), '+', '-'), '/', '_'), '=') AS token, sha256('h' || doc_id) AS holding_sha256, true AS refused FROM j""",
    "dwell_times": f"""WITH w AS (SELECT resource_no, unnest(string_split(rationale, ' ')) AS word, unnest(range(0, len(string_split(rationale, ' ')))) AS pos FROM discovery_validation WHERE rationale IS NOT NULL),
        p AS (SELECT *, {_PAUSE.format(w='word')} AS pause, CASE WHEN length(word) > 8 THEN 1.3 ELSE 1.0 END AS f FROM w)
        SELECT resource_no, CAST(pos AS INTEGER) AS pos, word, pause, CAST(round(240 * f * CASE pause WHEN 'sentence' THEN 2 WHEN 'clause' THEN 1.5 ELSE 1 END, 3) AS DOUBLE) AS ms, CAST(750 AS DOUBLE) AS gap_ms, CAST(0 AS DOUBLE) AS break_ms, CAST(round(600 * f * 2.5, 3) AS DOUBLE) AS last_ms FROM p""",
    "word_focus": """WITH a AS (SELECT p_partkey, p_name, CASE WHEN length(p_name) = 1 THEN 0 WHEN length(p_name) <= 5 THEN 1 WHEN length(p_name) <= 9 THEN 2 WHEN length(p_name) <= 13 THEN 3 ELSE 4 END AS k FROM part)
        SELECT p_partkey, left(p_name, k) AS before, substr(p_name, k + 1, 1) AS focus, substr(p_name, k + 2) AS after, array_to_string(list_transform(range(0, (length(p_name) + 3) // 4), lambda i: substr(p_name, i * 4 + 1, 4)), '|') AS chunks FROM a""",
    "read_range": f"""WITH d AS (SELECT doc_id, text, strlen(text) AS n, left(text, {_CUT.format(n=50, t='text')}) AS head FROM documents),
        e AS (SELECT *, strlen(head) = 50 OR n = 50 AS ok, substr(text, length(head) + 1) AS rest FROM d)
        SELECT doc_id, CASE WHEN n <= 64 THEN 'complete_range' WHEN n > 64 THEN 'partial_range' END AS a_status, left(text, {_CUT.format(n=64, t='text')}) AS a_text, strlen(left(text, {_CUT.format(n=64, t='text')})) AS a_end,
        CASE WHEN text IS NULL THEN NULL WHEN NOT ok THEN 'invalid_request' WHEN n <= 90 THEN 'complete_range' ELSE 'partial_range' END AS b_status, CASE WHEN ok THEN left(rest, {_CUT.format(n=40, t='rest')}) END AS b_text,
        CASE WHEN ok THEN 50 + strlen(left(rest, {_CUT.format(n=40, t='rest')})) END AS b_end, CASE WHEN ok THEN n <= 90 END AS b_last FROM e""",
    "words_with_offsets": f"""{_WORDS} SELECT doc_id, ord, word, start_byte, {_PAUSE.format(w='word')} AS pause FROM words""",
    "first_words_after": f"""{_WORDS}, p AS (SELECT doc_id, unnest([0, 1000, strlen(text)]) AS at FROM documents WHERE text IS NOT NULL)
        SELECT p.doc_id, p.at, w.start_byte AS item_at FROM p ASOF LEFT JOIN words w ON p.doc_id = w.doc_id AND p.at <= w.start_byte""",
    "text_items": f"""{_WORDS}, b AS (SELECT doc_id, unnest(string_split(text, chr(10))[:-2]) AS p, unnest(range(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE contains(text, chr(10))),
        g AS (SELECT doc_id, unnest(string_split(text, '[')[:-2]) AS p, unnest(range(1, len(string_split(text, '[')))) AS i FROM documents WHERE contains(text, '['))
        SELECT doc_id, 'word' AS kind, count(*) AS n, max(start_byte) AS last_at FROM words GROUP BY 1 UNION ALL SELECT doc_id, 'break', count(*), CAST(sum(strlen(p)) + count(*) - 1 AS BIGINT) FROM b GROUP BY 1 UNION ALL SELECT doc_id, 'gap', count(*), CAST(sum(strlen(p)) + count(*) - 1 AS BIGINT) FROM g GROUP BY 1""",
    "escaped_lines": "SELECT doc_id, sha256(text) AS sha256, false AS unescaped FROM documents WHERE text IS NOT NULL",
}
