"""Queries over container formats: every row of a table is packed, read back, and compared with what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import content, library, structure
from shelfmark.sources import containers, packing, pdf, sinks
from shelfmark.session import table


def _id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col("path").cast("long")).drop("path")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an EPUB of two chapters, its text and its language, with a page list where it has a unit."""

    def pack(text: str | None, lang: str | None, source: str | None, unit: int | None, text_num: int | None) -> bytes:
        x = packing.xml_text
        chapters = [("Text", f"<h1>One</h1><p>{x(text)}</p>"), (f"Language of  {source}", f"<p>{x(lang)}</p><img src='a.png' alt='seal'/>")]
        pages = None if unit is None else [(str(unit), "c1.xhtml#p"), (f"{unit} b", "c2.xhtml")]
        return packing.epub_of(source or "", lang or "", [f"urn:text:{text_num}", "second"], chapters, pages, (text or "").encode())

    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "unit", "text_num"), "doc_id", pack)


def epub_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every book with their status and their characters that are no white space."""
    return _id(content.units(_books(spark, sf_dir), "epub-text/2")).select("doc_id", "unit", "member", "status", "n_gaps", "n_chars")


def epub_strict_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same units in the strict representation, which refuses a document with an image."""
    return _id(content.units(_books(spark, sf_dir), "epub-text/1")).select("doc_id", "unit", "status", "n_chars")


def epub_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every book's navigation."""
    return _id(content.units(_books(spark, sf_dir), "epub-nav/1")).select("doc_id", "unit", "level", "parent", "label", "member", "status")


def epub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every book's page list."""
    return _id(content.units(_books(spark, sf_dir), "epub-page-list/1")).select("doc_id", "unit", "label", "member", "fragment", "problem")


def epub_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared titles, languages and identifiers of every book."""
    m = _id(containers.epub_metadata(_books(spark, sf_dir)))
    return m.select("doc_id", F.col("titles")[0].alias("title"), F.col("languages")[0].alias("language"), "package_id", F.size("identifiers").alias("n_identifiers"))


def epub_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared cover of every book, by its digest."""
    return _id(containers.epub_cover(_books(spark, sf_dir))).select("doc_id", "member", F.sha2("image", 256).alias("sha256"))


def epub_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 bytes of the first unit of every book, and where to go on."""
    r = _id(content.read(_books(spark, sf_dir), "epub-text/2", 1, 0, 64))
    return r.select("doc_id", "status", "text", F.col("end").cast("long").alias("end"), "end_of_unit", "end_of_source", F.col("next_unit").cast("long").alias("next_unit"), F.col("next_start").cast("long").alias("next_start"))


def epub_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a literal in the units of every book."""
    return _id(content.locate(_books(spark, sf_dir), "epub-text/2", "the ")).groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("start_byte").alias("first_byte"))


def epub_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of every book's text."""
    return _id(content.representation_ids(_books(spark, sf_dir))).select("doc_id", "representation", "units", "with_gaps")


def epub_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every book with the token that leads back to each."""
    return _id(content.parts(_books(spark, sf_dir))).select("doc_id", "unit", "part", "kind", F.sha2("text", 256).alias("sha256"), "reference")


def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the books in the first representation that reads each, beside files that are none."""
    books = _books(spark, sf_dir)
    other = table(spark, sf_dir, "part").select(F.concat(F.lit("-"), "p_partkey").alias("path"), F.encode("p_name", "UTF-8").alias("content"))
    papers = _papers(spark, sf_dir).withColumn("path", F.concat(F.lit("1000000000"), "path"))
    u = content.text_units(books.unionByName(other).unionByName(papers))
    return _id(u).groupBy("doc_id").agg(F.count("unit").alias("units"), F.max("representation").alias("representation"), F.bool_or(F.col("finding").isNotNull()).alias("unread"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PDF of three pages: its text (a line for each word), its language with an image, and nothing."""

    def pack(text: str | None, lang: str | None) -> bytes:
        return packing.pdf_of(["\n".join((text or "").split()), lang or "", ""], [(0, "r", "", 3), (1, "D", "B-", 1)], 1)

    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", pack)


def pdf_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a PDF of every document, with printed labels and gaps."""
    u = content.units(_papers(spark, sf_dir), "pdf-text/1")
    return _id(u).select("doc_id", "unit", "label", "bytes", "status", "n_gaps", "n_images")


def pdf_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of the second page of every PDF, and its gaps."""
    r = _id(content.read(_papers(spark, sf_dir), "pdf-text/1", 2, 0, 4096))
    return r.select("doc_id", "status", "text", F.array_join(F.transform("gaps", lambda g: F.concat_ws("@", g["kind"], g["at"].cast("string"))), ",").alias("gaps"), F.col("next_unit").cast("long").alias("next_unit"))


def pdf_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a word that ends a line in the pages of every PDF."""
    return _id(content.locate(_papers(spark, sf_dir), "pdf-text/1", "the\n")).groupBy("doc_id", "unit").agg(F.count(F.lit(1)).alias("n"))


def pdf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, pages and labels of every PDF."""
    return _id(pdf.pdf_facts(_papers(spark, sf_dir))).select("doc_id", "version", "pages", "labelled", F.size("active").alias("active"))


def content_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be asked for."""
    return content.capabilities(spark)


def zip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive of every document, with one name that leads out of it."""

    def pack(text: str | None, lang: str | None) -> bytes:
        return packing.zip_of([("text.txt", (text or "").encode()), ("dir/lang.txt", (lang or "").encode()), ("../up.txt", b"x")])

    m = containers.zip_members(packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", pack))
    return _id(m).select("doc_id", F.col("ord").alias("member_no"), "name", "bytes", "disposition")


def nested_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives in archives, to four levels."""

    def pack(text: str | None, lang: str | None) -> bytes:
        inner = packing.zip_of([("text.txt", (text or "").encode())])
        for k in (4, 3, 2):
            inner = packing.zip_of([(f"level{k}.zip", inner), ("lang.txt", (lang or "").encode())])
        return packing.zip_of([("level1.zip", inner)])

    m = containers.nested_members(packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", pack))
    return _id(m).select("doc_id", "level", "name", F.when(F.col("disposition") == "ok", F.col("bytes")).alias("bytes"), F.when(F.col("disposition") == "ok", F.col("sha256")).alias("sha256"), "disposition")


def mp3_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, tags and gaps of an MP3 file for every track."""

    def pack(no: int | None, channels: int | None, recording: str | None) -> bytes:
        return packing.mp3_of((no or 0) % 7 + 2, 9, 2 if channels == 2 else 0, (recording or "").encode())

    f = _id(containers.mp3_frames(packing.packed(table(spark, sf_dir, "audio_tracks").select("track_id", "track_no", "channels", "recording_id"), "track_id", pack)), "track_id")
    return f.groupBy("track_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), F.sum("samples").cast("long").alias("samples"))


def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of an MP3 and an MP4 file for every track: as many as its number, modulo four, asks for."""

    def mp3(no: int | None) -> bytes:
        n = (no or 0) % 4
        return packing.mp3_of(2, 9, 0, packing.id3_chapters([(f"ch{k}", 1000 * k, 1000 * k + 500, f"Título {k}") for k in range(n)]))

    def mp4(no: int | None) -> bytes:
        return packing.mp4_of([5], 1024, 1, 0, [(1000 * k, f"Título {k}") for k in range((no or 0) % 4)])

    t = table(spark, sf_dir, "audio_tracks").select("track_id", "track_no")
    a = _id(containers.mp3_chapters(packing.packed(t, "track_id", mp3)), "track_id").select("track_id", F.lit("mp3").alias("file"), F.col("ord").alias("chapter_no"), "start_ms", "end_ms", "title")
    b = _id(containers.mp4_chapters(packing.packed(t, "track_id", mp4)), "track_id").select("track_id", F.lit("mp4").alias("file"), F.col("ord").alias("chapter_no"), "start_ms", F.lit(None).cast("long").alias("end_ms"), "title")
    return a.unionByName(b)


def mp3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames of every track's MP3 file from its third on, 1,000 bytes of them at most."""

    def pack(no: int | None, channels: int | None) -> bytes:
        return packing.mp3_of((no or 0) % 7 + 2, 9, 4 if channels == 2 else 0)

    r = content.frame_ranges(packing.packed(table(spark, sf_dir, "audio_tracks").select("track_id", "track_no", "channels"), "track_id", pack), 2, 1_300)
    return _id(r, "track_id").select("track_id", "preroll", "last", "byte_start", "byte_end", "complete", "stopped_at_gap", "end_of_track", "status")


def epub_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cover of every book as a resource of at most 2,000 bytes."""
    r = content.resource(_books(spark, sf_dir), "epub-structure/1", "OPS/cover.png", 2_000)
    return _id(r).select("doc_id", "media", "bytes", "sha256", F.col("finding").isNotNull().alias("refused"))


def href_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document to members and their fragments, as written."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    href = F.element_at(F.array(*map(F.lit, ("c2.xhtml#a", "c2.xhtml", "#a", "c2.xhtml#twice", "c2.xhtml#none", "c3.xhtml", "http://e.example/", "../../x", None))), (F.col("doc_id") % 9 + 1).cast("int"))
    links = d.select("doc_id", F.lit("OPS/c1.xhtml").alias("base"), href.alias("href"))
    members = d.select("doc_id", F.explode(F.array(F.struct(F.lit("OPS/c1.xhtml").alias("member"), F.lit(1).alias("unit")), F.struct(F.lit("OPS/c2.xhtml").alias("member"), F.lit(2).alias("unit")))).alias("m")).select("doc_id", "m.*")
    at = lambda u, f, o: F.struct(F.lit(u).alias("unit"), F.lit(f).alias("fragment"), F.lit(o).alias("offset"))
    targets = d.select("doc_id", F.explode(F.array(at(1, "a", 10), at(2, "a", 20), at(2, "twice", 30), at(2, "twice", 31))).alias("t")).select("doc_id", "t.*")
    return structure.resolve_hrefs(links, members, targets, "doc_id").select("doc_id", "unit", "offset", "status")


def entry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of an entry of every document that begins at its third byte in the first unit and ends in the second."""
    u = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("unit"), F.concat(F.lit("abc"), F.coalesce("text", F.lit(""))).alias("text")), F.struct(F.lit(2).alias("unit"), F.concat(F.lit("xy"), F.coalesce("lang", F.lit(""))).alias("text")))).alias("u")).select("doc_id", "u.*")
    r = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("entry"), F.lit(1).alias("unit"), F.lit(2).alias("offset"), F.when(F.col("doc_id") % 3 != 0, 2).alias("end_unit"), F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0).alias("end_offset"))
    t = structure.entry_text(r, u, "doc_id")
    return t.select("doc_id", "unit", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("text", 256).alias("sha256"))


def image_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every document beside the member each names."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    src = F.element_at(F.array(*map(F.lit, ("a.png", "../a.png", "http://e.example/a.png", "../../a.png", "b.png"))), (F.col("doc_id") % 5 + 1).cast("int"))
    members = d.select("doc_id", F.lit("OPS/a.png").alias("member"), F.col("doc_id").alias("bytes"), F.lit("s").alias("sha256"))
    r = structure.resolve_images(d.select("doc_id", F.lit("OPS/c1.xhtml").alias("base"), src.alias("src")), members, "doc_id")
    return r.select("doc_id", "status", "member", "image_bytes")


def mp4_packet_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of an MP4 file for every track."""

    def pack(no: int | None) -> bytes:
        return packing.mp4_of([10 * k + 7 for k in range((no or 0) % 5 + 1)], 1024, 2, 100)

    p = _id(content.units(packing.packed(table(spark, sf_dir, "audio_tracks").select("track_id", "track_no"), "track_id", pack), "mp4-packets/1"), "track_id")
    return p.select("track_id", F.col("unit").alias("packet_no"), "at", "length", "start_ticks")


def mp4_box_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes of each kind the same files hold."""

    def pack(no: int | None) -> bytes:
        return packing.mp4_of([10 * k + 7 for k in range((no or 0) % 5 + 1)], 1024, 2, 100)

    b = content.units(packing.packed(table(spark, sf_dir, "audio_tracks").select("track_id", "track_no"), "track_id", pack), "mp4-audio/1")
    return b.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))


def recovery_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery packets of every track by set: one set for a recording, its files the tracks."""

    def pack(track: int, recording: str | None, no: int | None, channels: int | None) -> bytes:
        import hashlib

        own = hashlib.md5((recording or "").encode(), usedforsecurity=False).digest()
        name = lambda n: (n or 0).to_bytes(16, "big")
        packets = [("main", b"same" if channels != 2 else b"else"), ("file", name(no) + b"name"), ("creator", b"tool")]
        packets += [("file", name(no) + str(track).encode())] if channels is None else []
        packets += [("recovery", bytes([k])) for k in range((no or 0) % 3)]
        return packing.recovery_of(own, packets + ([("broken", b"")] if track % 4 == 0 else []))

    files = packing.packed(table(spark, sf_dir, "audio_tracks").select("track_id", F.col("track_id").alias("t"), "recording_id", "track_no", "channels"), "track_id", pack)
    s = library.recovery_sets(containers.recovery_packets(files))
    return s.select("set_id", "files", "packets", "matching", "mismatched", "recovery", "mains", "descriptions", "file_ids", F.array_join("conflicts", ",").alias("conflicts"))


def wav_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of a WAV file around the name of every part."""
    w = table(spark, sf_dir, "part").select("p_partkey", sinks.wav(F.encode("p_name", "UTF-8"), 8000, 1).alias("w"))
    return w.select("p_partkey", F.hex(F.substring("w", 1, 44)).alias("head"), F.octet_length("w").cast("long").alias("bytes"))


def reading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown line for every resource."""
    d = table(spark, sf_dir, "discovery_validation")
    return d.select("resource_no", sinks.reading_list_line("title", "authors", "landing_url").alias("line"))


_NAMES = (epub_units, epub_strict_units, epub_contents, epub_pages, epub_declared, epub_covers, epub_ranges, epub_located, epub_text_ids, epub_parts, content_fallback, content_capabilities, pdf_units, pdf_ranges, pdf_located, pdf_facts, zip_listing,
          nested_archives, mp3_listing, mp3_ranges, epub_resources, href_statuses, entry_texts, image_members, chapter_marks, mp4_packet_listing, mp4_box_listing, recovery_set_report, wav_heads, reading_list)
QUERIES = {f.__name__: f for f in _NAMES}

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The documents with what XML does not allow taken out, their words joined by blanks, and that as the text of the first unit.
_READ = rf"""WITH d AS (SELECT *, regexp_replace(coalesce(text, ''), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{FFFE}}\x{{FFFF}}]', '', 'g') AS x FROM documents),
w AS (SELECT *, trim(regexp_replace(x, '{_SPACE}+', ' ', 'g')) AS plain FROM d), u AS (SELECT *, CASE WHEN plain = '' THEN 'One' ELSE 'One' || chr(10) || plain END AS first FROM w)"""
#: The words of the documents, a line for each.
_WORDS = r"""WITH p AS (SELECT doc_id, lang, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''), chr(10)) AS lines FROM documents)"""
_BYTES64 = "list_max(list_filter(range(0, 65), lambda k: strlen(left(first, k)) <= 64))"

SQL = {
    "epub_units": f"""{_READ} SELECT doc_id, 1 AS unit, 'OPS/c1.xhtml' AS member, 'text' AS status, 0 AS n_gaps, 3 + length(replace(plain, ' ', '')) AS n_chars FROM u
        UNION ALL SELECT doc_id, 2, 'OPS/c2.xhtml', 'text_with_gaps', 1, length(coalesce(lang, '')) FROM u""",
    "epub_strict_units": f"""{_READ} SELECT doc_id, 1 AS unit, 'text' AS status, 3 + length(replace(plain, ' ', '')) AS n_chars FROM u UNION ALL SELECT doc_id, 2, 'unsupported_document', NULL FROM u""",
    "epub_contents": """SELECT doc_id, 1 AS unit, 1 AS level, 0 AS parent, 'Text' AS label, 'OPS/c1.xhtml' AS member, 'internal' AS status FROM documents
        UNION ALL SELECT doc_id, 2, 1, 0, 'Language of ' || coalesce(source, 'None'), 'OPS/c2.xhtml', 'internal' FROM documents""",
    "epub_pages": """SELECT doc_id, 1 AS unit, CAST(unit AS VARCHAR) AS label, 'OPS/c1.xhtml' AS member, 'p' AS fragment, CAST(NULL AS VARCHAR) AS problem FROM documents WHERE unit IS NOT NULL
        UNION ALL SELECT doc_id, 2, unit || ' b', 'OPS/c2.xhtml', '', NULL FROM documents WHERE unit IS NOT NULL""",
    "epub_declared": "SELECT doc_id, coalesce(source, '') AS title, coalesce(lang, '') AS language, 'urn:text:' || coalesce(CAST(text_num AS VARCHAR), 'None') AS package_id, 2 AS n_identifiers FROM documents",
    "epub_covers": "SELECT doc_id, 'OPS/cover.png' AS member, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "epub_ranges": f"""{_READ} SELECT doc_id, CASE WHEN strlen(first) <= 64 THEN 'complete_range' ELSE 'partial_range' END AS status, left(first, {_BYTES64}) AS text, strlen(left(first, {_BYTES64})) AS "end", strlen(first) <= 64 AS end_of_unit,
        false AS end_of_source, CAST(CASE WHEN strlen(first) <= 64 THEN 2 ELSE 1 END AS BIGINT) AS next_unit, CASE WHEN strlen(first) <= 64 THEN 0 ELSE strlen(left(first, {_BYTES64})) END AS next_start FROM u""",
    "epub_located": f"""{_READ} SELECT doc_id, 1 AS unit, len(string_split(first, 'the ')) - 1 AS n, strlen(string_split(first, 'the ')[1]) AS first_byte FROM u WHERE contains(first, 'the ')""",
    "epub_text_ids": f"""{_READ} SELECT doc_id, sha256('1 text ' || sha256(first) || ' 0' || chr(10) || '2 text_with_gaps ' || sha256(coalesce(lang, '')) || ' 1') AS representation, CAST(2 AS BIGINT) AS units, CAST(1 AS BIGINT) AS with_gaps FROM u""",
    "epub_parts": f"""{_READ}, p AS (SELECT doc_id, 1 AS unit, 1 AS part, 'h1' AS kind, 'One' AS t, 0 AS s, 3 AS e FROM u UNION ALL SELECT doc_id, 1, 2, 'p', plain, 4, 4 + strlen(plain) FROM u WHERE plain <> ''
        UNION ALL SELECT doc_id, 2, 1, 'p', lang, 0, strlen(lang) FROM u WHERE lang IS NOT NULL AND lang <> '')
        SELECT doc_id, unit, part, kind, sha256(t) AS sha256, rtrim(replace(replace(to_base64(encode('{{"asset":"' || doc_id || '","end":' || e || ',"member":"OPS/c' || unit || '.xhtml","part":' || part || ',"representation":"epub-structure/1","start":' || s || ',"unit":' || unit || '}}')), '+', '-'), '/', '_'), '=') AS reference FROM p""",
    "content_fallback": """SELECT doc_id, CAST(2 AS BIGINT) AS units, 'epub-text/2' AS representation, false AS unread FROM documents UNION ALL SELECT -p_partkey, 0, NULL, true FROM part
        UNION ALL SELECT CAST('1000000000' || doc_id AS BIGINT), 3, 'pdf-text/1', false FROM documents""",
    "pdf_units": f"""{_WORDS} SELECT doc_id, 1 AS unit, 'iii' AS label, strlen(lines) AS bytes, CASE WHEN lines = '' THEN 'text_with_gaps' ELSE 'text' END AS status, CASE WHEN lines = '' THEN 1 ELSE 0 END AS n_gaps, 0 AS n_images FROM p
        UNION ALL SELECT doc_id, 2, 'B-1', strlen(coalesce(lang, '')), 'text_with_gaps', CASE WHEN lang IS NULL THEN 2 ELSE 1 END, 1 FROM p UNION ALL SELECT doc_id, 3, 'B-2', 0, 'text_with_gaps', 1, 0 FROM p""",
    "pdf_ranges": "SELECT doc_id, 'complete_range' AS status, coalesce(lang, '') AS text, CASE WHEN lang IS NULL THEN 'image@0,no_text_layer@0' ELSE 'image@' || strlen(lang) END AS gaps, CAST(3 AS BIGINT) AS next_unit FROM documents",
    "pdf_located": f"""{_WORDS} SELECT doc_id, 1 AS unit, CAST(len(string_split(lines, 'the' || chr(10))) - 1 AS BIGINT) AS n FROM p WHERE contains(lines, 'the' || chr(10))""",
    "pdf_facts": "SELECT doc_id, '1.7' AS version, 3 AS pages, true AS labelled, 0 AS active FROM documents",
    "content_capabilities": """SELECT unnest(['epub-text/2', 'epub-text/2', 'epub-text/2', 'epub-text/1', 'epub-text/1', 'epub-structure/1', 'epub-structure/1', 'epub-structure/1', 'epub-source/1', 'pdf-text/1', 'pdf-text/1', 'pdf-text/1', 'epub-nav/1', 'epub-page-list/1', 'mpeg-audio/1', 'mp4-audio/1', 'mp4-packets/1']) AS representation,
        unnest(['units', 'read', 'locate', 'units', 'read', 'units', 'read', 'resource', 'read', 'units', 'read', 'locate', 'units', 'units', 'units', 'units', 'units']) AS operation""",
    "zip_listing": """SELECT doc_id, 1 AS member_no, 'text.txt' AS name, strlen(coalesce(text, '')) AS bytes, 'ok' AS disposition FROM documents UNION ALL SELECT doc_id, 2, 'dir/lang.txt', strlen(coalesce(lang, '')), 'ok' FROM documents
        UNION ALL SELECT doc_id, 3, '../up.txt', 1, 'unsafe_name' FROM documents""",
    "nested_archives": """WITH n AS (SELECT * FROM (VALUES (1, 'level1.zip', 'archive'), (2, 'level1.zip!/level2.zip', 'archive'), (2, 'level1.zip!/lang.txt', 'ok'), (3, 'level1.zip!/level2.zip!/level3.zip', 'archive'), (3, 'level1.zip!/level2.zip!/lang.txt', 'ok'),
        (4, 'level1.zip!/level2.zip!/level3.zip!/level4.zip', 'too_deep'), (4, 'level1.zip!/level2.zip!/level3.zip!/lang.txt', 'ok')) AS v(level, name, disposition))
        SELECT doc_id, level, name, CASE WHEN disposition = 'ok' THEN strlen(coalesce(lang, '')) END AS bytes, CASE WHEN disposition = 'ok' THEN sha256(coalesce(lang, '')) END AS sha256, disposition FROM documents CROSS JOIN n""",
    "mp3_listing": """WITH t AS (SELECT track_id, coalesce(track_no, 0) % 7 + 2 AS f, coalesce(channels = 2, false) AS broken, strlen(coalesce(recording_id, '')) AS tag FROM audio_tracks)
        SELECT track_id, 'frame' AS kind, CAST(f - CASE WHEN broken THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(417 * (f - CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS bytes, CAST(1152 * (f - CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS samples FROM t
        UNION ALL SELECT track_id, 'gap', 1, 421, NULL FROM t WHERE broken UNION ALL SELECT track_id, 'id3v2', 1, tag + 10, NULL FROM t WHERE tag > 0""",
    "mp3_ranges": """WITH t AS (SELECT track_id, coalesce(track_no, 0) % 7 + 2 AS n, coalesce(channels = 2, false) AND coalesce(track_no, 0) % 7 + 2 >= 4 AS broken FROM audio_tracks),
        f AS (SELECT *, CASE WHEN broken THEN n - 1 ELSE n END AS frames FROM t), r AS (SELECT *, least(frames - 1, CASE WHEN broken THEN 2 ELSE frames - 1 END, 3) AS last FROM f WHERE frames > 2)
        SELECT track_id, 1 AS preroll, CAST(least(last, 3) AS BIGINT) AS last, CAST(417 AS BIGINT) AS byte_start, CAST(417 * (least(last, 3) + 1) AS BIGINT) AS byte_end, true AS complete, broken AND frames > 3 AS stopped_at_gap, last = frames - 1 AS end_of_track, 'ok' AS status FROM r""",
    "epub_resources": "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN 'image/png' END AS media, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN strlen(coalesce(text, '')) END AS bytes, CASE WHEN strlen(coalesce(text, '')) <= 2000 THEN sha256(coalesce(text, '')) END AS sha256, strlen(coalesce(text, '')) > 2000 AS refused FROM documents",
    "href_statuses": """SELECT doc_id, CAST(CASE doc_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS INTEGER) AS unit, CAST(CASE doc_id % 9 WHEN 0 THEN 20 WHEN 1 THEN 0 WHEN 2 THEN 10 END AS INTEGER) AS offset,
        (['resolved', 'resolved', 'resolved', 'ambiguous_fragment', 'missing_fragment', 'missing_member', 'external', 'invalid', 'unlinked'])[doc_id % 9 + 1] AS status FROM documents""",
    "entry_texts": """SELECT doc_id, 1 AS unit, CAST(2 AS BIGINT) AS start, strlen(coalesce(text, '')) + 3 AS "end", sha256('c' || coalesce(text, '')) AS sha256 FROM documents
        UNION ALL SELECT doc_id, 2, 0, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 2 + strlen(coalesce(lang, '')) END, sha256(CASE WHEN doc_id % 3 = 1 THEN 'x' ELSE 'xy' || coalesce(lang, '') END) FROM documents WHERE doc_id % 3 <> 2""",
    "image_members": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'local_resource' WHEN 2 THEN 'external' WHEN 3 THEN 'invalid' ELSE 'missing_member' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'OPS/a.png' END AS member, CASE WHEN doc_id % 5 = 0 THEN doc_id END AS image_bytes FROM documents""",
    "chapter_marks": """WITH t AS (SELECT track_id, unnest(range(0, coalesce(track_no, 0) % 4)) AS k FROM audio_tracks) SELECT track_id, 'mp3' AS file, CAST(k + 1 AS INTEGER) AS chapter_no, 1000 * k AS start_ms, 1000 * k + 500 AS end_ms, 'Título ' || k AS title FROM t
        UNION ALL SELECT track_id, 'mp4', k + 1, 1000 * k, NULL, 'Título ' || k FROM t""",
    "mp4_packet_listing": """WITH t AS (SELECT track_id, unnest(range(0, coalesce(track_no, 0) % 5 + 1)) AS k FROM audio_tracks)
        SELECT track_id, CAST(k + 1 AS INTEGER) AS packet_no, 100 + 5 * k * (k - 1) + 7 * k AS at, 10 * k + 7 AS length, 1024 * k AS start_ticks FROM t""",
    "mp4_box_listing": """SELECT unnest(['/ftyp', '/moov', '/moov/trak', '/moov/trak/mdia', '/moov/trak/mdia/minf', '/moov/trak/mdia/minf/stbl', '/moov/trak/mdia/minf/stbl/stsz', '/moov/trak/mdia/minf/stbl/stts', '/moov/trak/mdia/minf/stbl/stsc', '/moov/trak/mdia/minf/stbl/stco']) AS box,
        (SELECT count(*) FROM audio_tracks) AS n, (SELECT count(*) FROM audio_tracks) AS files""",
    "recovery_set_report": """WITH t AS (SELECT *, md5(coalesce(recording_id, '')) AS set_id, coalesce(track_no, 0) AS no FROM audio_tracks),
        d AS (SELECT set_id, no, 'name' AS body FROM t UNION SELECT set_id, no, CAST(track_id AS VARCHAR) FROM t WHERE channels IS NULL), dd AS (SELECT set_id, count(*) AS descriptions, count(DISTINCT no) AS file_ids FROM d GROUP BY 1),
        s AS (SELECT set_id, count(*) AS files, CAST(sum(3 + CASE WHEN channels IS NULL THEN 1 ELSE 0 END + no % 3) AS BIGINT) AS matching, CAST(sum(CASE WHEN track_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
        CAST(sum(no % 3) AS BIGINT) AS recovery, count(DISTINCT channels IS NOT DISTINCT FROM 2) AS mains FROM t GROUP BY 1)
        SELECT set_id, files, matching + mismatched AS packets, matching, mismatched, recovery, mains, descriptions, file_ids,
        concat_ws(',', CASE WHEN mains > 1 THEN 'main_packets' END, CASE WHEN descriptions > file_ids THEN 'file_descriptions' END) AS conflicts FROM s JOIN dd USING (set_id)""",
    "wav_heads": """WITH p AS (SELECT p_partkey, strlen(p_name) AS n FROM part), h AS (SELECT p_partkey, n, printf('%02X%02X0000', n % 256, n // 256) AS size, printf('%02X%02X0000', (n + 36) % 256, (n + 36) // 256) AS whole FROM p)
        SELECT p_partkey, '52494646' || whole || '57415645666D7420' || '10000000' || '0100' || '0100' || '401F0000' || '803E0000' || '0200' || '1000' || '64617461' || size AS head, n + 44 AS bytes FROM h""",
    "reading_list": r"""SELECT resource_no, '- [' || regexp_replace(coalesce(title, ''), '([\\`*_\[\]<>])', '\\\1', 'g') || '](' || coalesce(landing_url, '') || ')' || CASE WHEN len(authors) > 0 THEN ' — ' || regexp_replace(array_to_string(authors, '; '), '([\\`*_\[\]<>])', '\\\1', 'g') ELSE '' END AS line FROM discovery_validation""",
}
