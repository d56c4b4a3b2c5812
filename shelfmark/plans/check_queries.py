"""Queries over single values and small rules: grammars, numbers, flags, links, volumes, formats, assessments, labels, caps and pages.

Inputs are made from every row of a table by turns of the row's number, so the SQL can state what each turn must give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import codecs
from shelfmark.functions import scalars as S
from shelfmark.operators import changes, folds, groups, search, structure
from shelfmark.session import checkpoint_dir, table
from shelfmark.sources import catalog_csv, journals, records


def _turn(n: str, *values: object) -> Column:
    """One of ``values`` by turns of the number ``n``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(n), F.lit(len(values))) + 1).cast("int"))


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammars of ids, track numbers, digests, paths and flags of every catalogue row."""
    c = table(spark, sf_dir, "gutenberg_catalog")
    num = F.col("text_num").cast("string")
    sha = F.sha2(F.coalesce("title", F.lit("")), 256)
    return c.select(
        "row_id", S.has_grammar(F.concat(F.lit("gutenberg:"), num), "gutenberg").alias("gutenberg"), S.has_grammar(F.concat(_turn("row_id", "W", "W0", "w"), num), "openalex").alias("openalex"),
        S.has_grammar(F.concat(F.lit("librivox:"), num), "librivox").alias("librivox"), S.has_grammar(F.concat(_turn("row_id", "ok-", "-no", "No"), num), "resource").alias("resource"),
        S.has_grammar(F.concat(_turn("row_id", "1.2.", "1.", "v1.2."), num), "version").alias("version"),
        S.open_library_key(F.concat(_turn("row_id", "/works/OL", "ol", "OL0", "x"), num, _turn("row_id", "W", "m", "M", "W"))).alias("key"),
        S.track_number(_turn("row_id", "7", " 07 ", "7/12", "0012", "x", "", "12345", None)).alias("track"),
        S.hex_digest(_turn("row_id", "a", "b").eqNullSafe("a").cast("string"), 16).alias("no_digest"), S.hex_digest(F.when(F.col("row_id") % 2 == 0, sha).otherwise(F.upper(sha)), 32).alias("digest"),
        S.inside(_turn("row_id", "a/b/c", "a/b", "a/bc", "a"), F.lit("a/b/")).alias("inside"), S.flag_state(_turn("row_id", "true", '"1"', "0", '"false"', "maybe", "", None)).alias("flag"),
        S.date_shape(_turn("row_id", "2001-01-01", "2001-99-99", "2001-1-1", "x")).alias("dated"))


def href_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document resolved within its package."""
    d = table(spark, sf_dir, "documents").select("doc_id", codecs.resolve_href_udf(F.lit("OPS/text/c1.xhtml"), _turn("doc_id", "c2.xhtml#a", "../img/x%20y.png", "http://e.example/z", "#top", "../../../x", "/abs", "mailto:a@b", "")).alias("r"))
    return d.select("doc_id", "r.member", "r.fragment", "r.status")


def position_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position in every document as a token, read back; one that is not written exactly so is refused."""
    d = table(spark, sf_dir, "documents").select("doc_id", "unit")
    t = structure.bind_references(d, {"unit": F.coalesce("unit", F.lit(0)), "asset": F.concat(F.lit("é"), "doc_id"), "offset": F.col("doc_id") * 3})
    read = codecs.decoded(F.when(F.col("doc_id") % 3 == 0, F.concat("reference", F.lit("="))).otherwise(F.col("reference")))
    return t.select("doc_id", F.from_json(read, "asset string, offset long, unit int").alias("r")).select("doc_id", "r.asset", "r.offset", "r.unit")


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a JSON line of each event is canonical, and the digest of its canonical form."""
    line = _turn("event_id", '{"a":1.50,"b":"x"}', '{"b":"x","a":1.50}', '{"a": 1.50,"b":"x"}', '{"a":1,"a":2}', "[1", '{"a":1.50,"b":"x"} 1', "[" * 20 + "]" * 20, None)
    return table(spark, sf_dir, "events").select("event_id", codecs.is_canonical_udf(line).alias("canonical"), codecs.canonical_digest_udf(line).alias("digest"))


def archive_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set and number of a volume name of every part."""
    name = F.concat(F.lit("S"), "p_partkey", _turn("p_partkey", ".part03.RAR", ".7z.002", ".zip.0012", ".z07", ".r05", ".rar", ".part.rar"))
    v = table(spark, sf_dir, "part").select("p_partkey", S.volume_of(name).alias("v"))
    return v.select("p_partkey", "v.set", "v.number", "v.scheme")


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format of a file head of every part by its first bytes."""
    head = F.unhex(_turn("p_partkey", "504B030414", "255044462D312E", "4944330400", "FFFB9000", "0000001C66747970", "526172211A07", "4D5A9000", "7F454C46", "00", "FFE00000", ""))
    return table(spark, sf_dir, "part").select("p_partkey", S.detected_format(head).alias("format"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of every part against what was stated of it, and whether stored bytes agree."""
    content = F.when(F.col("p_partkey") % 5 == 4, F.lit(None)).otherwise(F.concat(F.when(F.col("p_partkey") % 5 == 3, "text").otherwise("%PDF-"), F.col("p_name")))
    f = table(spark, sf_dir, "part").select("p_partkey", content.alias("t")).withColumn("content", F.encode("t", "UTF-8"))
    f = f.withColumns({"bytes": F.octet_length("content") + F.when(F.col("p_partkey") % 5 == 1, 1).otherwise(0), "sha": F.when(F.col("p_partkey") % 5 != 2, F.sha2("content", 256)).otherwise("0"), "fmt": F.lit("pdf")})
    a = changes.assess(f, "bytes", "sha", "fmt")
    return a.select("p_partkey", "detected_format", F.array_join("findings", ",").alias("findings"), "status", changes.stored_agrees("content", "bytes", "sha").alias("agrees"))


def scanner_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of files from lines of a scanner's output."""
    line = F.concat(F.lit("/x/"), "p_partkey", F.lit(": a"), _turn("p_partkey", ": OK", ": Eicar-Test FOUND", ": Access denied. ERROR", ": what", ""))
    return changes.scanner_statuses(table(spark, sf_dir, "part").select(line.alias("line")), "line")


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed labels of the lines of every order read as pages: roman to the third, then decimal or letters with a prefix."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("page")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    rule = lambda first, style, prefix, number: F.struct(F.lit(first).alias("first"), style.alias("style"), F.lit(prefix).alias("prefix"), F.lit(number).alias("number"))
    ranges = o.select("doc", F.explode(F.array(rule(0, F.lit("roman"), "", 1), rule(3, F.when(F.col("doc") % 2 == 0, "decimal").otherwise("letters"), "A-", 5))).alias("r")).select("doc", "r.*")
    return structure.page_labels(pages, ranges, "doc", "page")


def identical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text stands more than once, under the digest of the text."""
    return groups.exact_members(table(spark, sf_dir, "documents"), "doc_id", "text")


def related_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind five relations, each with the key that it shares."""
    d = table(spark, sf_dir, "documents")
    return groups.related_members(d, "doc_id", {"same_text": F.sha2("text", 256), "same_work": F.col("text_num"), "same_unit": F.concat_ws("/", F.col("text_num").cast("string"), F.col("unit").cast("string")), "same_source": F.concat_ws("/", "source", "lang"), "same_size": F.col("n_chars")})


def declared_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ordered sets that declare how many lines they have."""
    l = table(spark, sf_dir, "lineitem").withColumn("stated", F.when(F.col("l_suppkey") % 4 == 0, 9))
    return groups.manifests(l, "l_orderkey", "l_linenumber", "l_partkey", "stated")


def merged_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each supplier, with whether one was ever returned."""
    return groups.merged_values(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_returnflag") == "R")


def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes of statements of each supplier, at most 16 by flag and 40 in all, in the order of first statement."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return groups.capped_fields(l, "l_suppkey", "l_returnflag", "l_partkey", "line", 16, 40)


def first_seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the order in which they first appear, the second ten of them."""
    return search.first_seen(table(spark, sf_dir, "events"), ["user_id"], "event_id", 10, 10)


def source_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of documents answered, one of them being gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return search.source_status({"verse": d.filter("source = 'verse'"), "none": d.filter("source = 'nowhere'"), "gone": None, "all": d}, 100)


def declaration_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the events of every user read as declarations."""
    return folds.declaration_digests(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "signup", "error")


def rolled_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that finish what is left open: clicks of each user without a purchase after them."""
    return changes.roll_forward(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "click", "purchase", ["value"])


def appended_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large lines that no small line names, each once."""
    l = table(spark, sf_dir, "lineitem")
    return changes.append_absent(l.filter("l_quantity < 10").select("l_partkey", "l_suppkey"), l.filter("l_quantity >= 49").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"])


def _written(spark: SparkSession) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue written as its nine-column CSV and read strictly: one row for each text that has a title."""
    c = table(spark, sf_dir, "gutenberg_catalog").filter("text_num > 0 AND title IS NOT NULL AND trim(title) != ''")
    one = c.groupBy("text_num").agg(F.min_by(F.struct("kind", "title", "languages", "authors", "subjects", "locc", "bookshelves"), "row_id").alias("x")).select("text_num", "x.*")
    cols = [F.col("text_num").alias("Text#"), F.col("kind").alias("Type"), F.lit("2001-02-03").alias("Issued"), F.col("title").alias("Title"), F.col("languages").alias("Language"), F.col("authors").alias("Authors"),
            F.col("subjects").alias("Subjects"), F.col("locc").alias("LoCC"), F.col("bookshelves").alias("Bookshelves")]
    path = _written(spark)
    one.select(*cols).write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return catalog_csv.read_catalog(spark, path).select(F.col("num").alias("text_num"), "issued", F.size("authors").alias("n_authors"), F.size("subjects").alias("n_subjects"), F.length("row_sha256").alias("digest_length"))


def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as canonical journals, one of users for each number of twenty, and read with their sequence checked."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("journal"), "event_id", "event_type", F.row_number().over(Window.partitionBy(F.col("user_id") % 20).orderBy("event_id")).alias("sequence"))
    line = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").alias("id"), "sequence"))
    path = _written(spark)
    e.select("journal", "sequence", line.alias("value")).repartition("journal").sortWithinPartitions("journal", "sequence").select("journal", "value").write.partitionBy("journal").text(path)
    j = journals.check_sequence(journals.read_journal(spark, f"{path}/journal=*", "event string, id long, sequence int"), "sequence")
    return j.select(F.regexp_extract("file", "journal=([0-9]+)", 1).cast("long").alias("journal"), F.col("line_no").cast("long").alias("line_no"), "event", "id")


def _lines(spark: SparkSession, rows: DataFrame, order: str) -> str:
    """``rows`` as JSON lines in the order of their columns, one journal for each ``journal``, below a new folder."""
    path = _written(spark)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "journal"]))
    rows.select("journal", F.col(order).alias("_o"), line.alias("value")).repartition("journal").sortWithinPartitions("journal", "_o").select("journal", "value").write.partitionBy("journal").text(path)
    return f"{path}/journal=*"


_LIBRARY = "library:0123456789abcdef0123456789abcdef"


def holdings_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track as a holding with its recording, written as a journal and read under its rules.

    A recording has at most 1000 tracks there, so a longer one is written in parts of 1000, each named in its ``source_file``.
    """
    t = table(spark, sf_dir, "audio_tracks").withColumn("sha256", F.sha2(F.col("track_id").cast("string"), 256))
    before = F.col("track_no").cast("long") - 1
    part = F.floor(before / 1000)
    place = (F.pmod(before, F.lit(1000)) + 1).cast("int")
    recording = F.when(F.col("track_no").isNotNull(), F.struct(F.coalesce("file_format", F.lit("x")).alias("source_format"), place.alias("position"), F.greatest(place, F.lit(2)).alias("tracks")))
    source = F.struct(F.lit("archive").alias("kind"), F.concat(F.lit("p/"), F.col("track_id")).alias("path"), F.col("recording_id").alias("source_id"), F.concat(F.lit("part "), part).alias("source_file"), recording.alias("recording"))
    late = F.col("channels").isNull()
    rows = t.select((F.col("track_id") % 4).alias("journal"), F.lit(1).alias("schema_version"), F.lit(_LIBRARY).alias("library_id"), F.concat(F.lit("sha256:"), F.col("sha256")).alias("id"), "sha256", F.col("track_id").alias("bytes"), F.lit("mp3").alias("format"),
                    F.when(late, "review").otherwise("checked").alias("status"), F.when(late, "scanner_failed").otherwise("").alias("reason"), F.lit("a").alias("path"), F.array(F.lit("T <1>")).alias("titles"), F.array(source).alias("sources"))
    h = records.read_relation(spark, _lines(spark, rows, "bytes"), "holdings")
    x = F.col("sources")[0]
    position = F.regexp_extract(x["source_file"], "^part (-?[0-9]+)$", 1).try_cast("long") * 1000 + x["recording"]["position"]
    return h.select(F.col("bytes").alias("track_id"), "status", "reason", position.cast("int").alias("position"), F.col("titles")[0].alias("title"))


def operations_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs of intent and completion, written as journals and read with sequence and pairs checked."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("journal"), "o_orderkey", F.row_number().over(Window.partitionBy(F.col("o_orderkey") % 8).orderBy("o_orderkey")).alias("n"))
    e = o.select("*", F.explode(F.array(F.lit("intent"), F.lit("completed"))).alias("event"))
    rows = e.select("journal", F.lit(1).alias("schema_version"), (F.col("n") * 2 - (F.col("event") == "intent").cast("int")).alias("sequence"), F.lit(_LIBRARY).alias("library_id"), F.concat(F.lit("op:"), "o_orderkey").alias("operation_id"), "event", F.lit("s").alias("source"),
                    F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("asset_id"), F.lit("epub").alias("format"), F.col("o_orderkey").alias("bytes"), F.lit("checked").alias("status"), F.lit("").alias("reason"), F.lit("2001-02-03T04:05:06Z").alias("at"))
    r = records.read_relation(spark, _lines(spark, rows, "sequence"), "operations")
    return r.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("sequence").cast("long").alias("last"))


def marks_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of saved places, written as journals, read and folded."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("journal"), "event_id", F.row_number().over(Window.partitionBy(F.col("user_id") % 8).orderBy("event_id")).alias("sequence"), F.sha2(F.col("user_id").cast("string"), 256).alias("u"))
    on = F.col("sequence") == 1
    rows = e.select("journal", F.lit(1).alias("schema_version"), "sequence", F.lit(_LIBRARY).alias("library_id"), F.when(on, "enabled").otherwise("save").alias("event"), F.when(~on, F.concat(F.lit("m"), "event_id")).alias("id"),
                    F.when(~on, F.concat(F.lit("sha256:"), "u")).alias("asset_id"), F.when(~on, "epub-text/2").alias("representation"), F.lit(0).alias("unit"), F.lit(3).alias("offset"), F.lit("é & <n>").alias("note"), F.lit("t").alias("at"))
    m = records.read_relation(spark, _lines(spark, rows, "sequence"), "marks")
    m = m.withColumn("journal", F.regexp_extract("file", "journal=([0-9]+)", 1).cast("long"))  # a journal is one file
    f = folds.mark_log_fold(m, "journal", "sequence", "event", "asset_id", "id")
    return f.select("journal", "asset_id", "id", F.col("saved_line").cast("long").alias("saved_line"), "valid")


_NAMES = (catalog_file, journal_files, holdings_journal, operations_journal, marks_journal, value_checks, href_targets, position_tokens, canonical_lines, archive_volumes, file_formats, assessments, scanner_report, page_labels, identical_documents, related_evidence, declared_manifests,
          merged_flags, capped_evidence, first_seen_users, source_answers, declaration_logs, rolled_forward, appended_absent)
QUERIES = {f.__name__: f for f in _NAMES}

SQL = {
    "catalog_file": r"""WITH one AS (SELECT text_num, arg_min(struct_pack(a := authors, s := subjects), row_id) AS x FROM gutenberg_catalog WHERE text_num > 0 AND title IS NOT NULL AND trim(title) <> '' GROUP BY 1)
        SELECT CAST(text_num AS INTEGER) AS text_num, '2001-02-03' AS issued, CAST(len(list_filter(string_split(coalesce(x.a, ''), ';'), lambda v: regexp_matches(v, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))) AS INTEGER) AS n_authors,
        CAST(len(list_filter(string_split(coalesce(x.s, ''), ';'), lambda v: regexp_matches(v, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))) AS INTEGER) AS n_subjects, 64 AS digest_length FROM one""",
    "holdings_journal": "SELECT track_id, CASE WHEN channels IS NULL THEN 'review' ELSE 'checked' END AS status, CASE WHEN channels IS NULL THEN 'scanner_failed' ELSE '' END AS reason, track_no AS position, 'T <1>' AS title FROM audio_tracks",
    "operations_journal": """SELECT unnest(['intent', 'completed']) AS event, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS bytes, unnest([(SELECT max(c) * 2 - 1 FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey % 8)), (SELECT max(c) * 2 FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey % 8))]) AS last FROM orders""",
    "marks_journal": """WITH e AS (SELECT user_id, event_id, user_id % 8 AS journal, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events), s AS (SELECT journal, user_id, max(n) AS saved_line, arg_max(event_id, n) AS e FROM e WHERE n > 1 GROUP BY 1, 2)
        SELECT j.journal, 'sha256:' || sha256(CAST(user_id AS VARCHAR)) AS asset_id, 'm' || e AS id, saved_line, true AS valid FROM (SELECT DISTINCT journal FROM e) j LEFT JOIN s USING (journal)""",
    "journal_files": "SELECT user_id % 20 AS journal, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS line_no, event_type AS event, event_id AS id FROM events",
    "value_checks": """WITH c AS (SELECT *, row_id % 3 AS a, row_id % 4 AS b, row_id % 2 AS h, length(CAST(text_num AS VARCHAR)) AS n FROM gutenberg_catalog)
        SELECT row_id, text_num > 0 AND n <= 8 AS gutenberg, CASE WHEN text_num IS NULL THEN NULL ELSE a = 0 AND text_num > 0 AND n <= 12 END AS openalex, text_num > 0 AND n <= 8 AS librivox, CASE WHEN text_num IS NULL THEN NULL ELSE a = 0 END AS resource,
        CASE WHEN text_num IS NULL THEN NULL ELSE a = 0 END AS version, CASE WHEN text_num > 0 THEN CASE b WHEN 0 THEN 'OL' || text_num || 'W' WHEN 1 THEN 'OL' || text_num || 'M' END END AS key,
        CAST(CASE row_id % 8 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 12 ELSE 0 END AS INTEGER) AS track, false AS no_digest, h = 0 AS digest, b < 2 AS inside,
        CASE row_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'false' WHEN 4 THEN 'unknown' ELSE 'not_declared' END AS flag, b < 2 AS dated FROM c""",
    "href_targets": """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'OPS/text/c2.xhtml' WHEN 1 THEN 'OPS/img/x y.png' WHEN 3 THEN 'OPS/text/c1.xhtml' WHEN 7 THEN 'OPS/text/c1.xhtml' ELSE '' END AS member, CASE doc_id % 8 WHEN 0 THEN 'a' WHEN 3 THEN 'top' ELSE '' END AS fragment,
        CASE doc_id % 8 WHEN 2 THEN 'external' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' WHEN 6 THEN 'external' ELSE 'internal' END AS status FROM documents""",
    "position_tokens": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'é' || doc_id END AS asset, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 3 END AS offset, CASE WHEN doc_id % 3 <> 0 THEN coalesce(unit, 0) END AS unit FROM documents",
    "canonical_lines": """SELECT event_id, event_id % 8 = 0 AS canonical, CASE WHEN event_id % 8 < 3 THEN sha256('{"a":1.50,"b":"x"}') END AS digest FROM events""",
    "archive_volumes": """SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 THEN 's' || p_partkey END AS set, CAST(CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 12 WHEN 3 THEN 7 WHEN 4 THEN 7 END AS INTEGER) AS number,
        CASE p_partkey % 7 WHEN 0 THEN 'part' WHEN 1 THEN '7z' WHEN 2 THEN 'zip' WHEN 3 THEN 'segment' WHEN 4 THEN 'old' END AS scheme FROM part""",
    "file_formats": "SELECT p_partkey, (['zip', 'pdf', 'mp3', 'mp3', 'mp4', 'rar', 'executable', 'executable', 'unknown', 'mp3', 'unknown'])[p_partkey % 11 + 1] AS format FROM part",
    "assessments": """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL WHEN 3 THEN 'unknown' ELSE 'pdf' END AS detected_format, CASE p_partkey % 5 WHEN 1 THEN 'size_differs' WHEN 2 THEN 'digest_differs' WHEN 3 THEN 'format_differs,format_unknown' ELSE '' END AS findings,
        CASE p_partkey % 5 WHEN 0 THEN 'limited_checks_passed' WHEN 3 THEN 'invalid_or_unsupported' WHEN 4 THEN 'incomplete' ELSE 'needs_review' END AS status, CASE WHEN p_partkey % 5 <> 4 THEN p_partkey % 5 IN (0, 3) END AS agrees FROM part""",
    "scanner_report": """SELECT '/x/' || p_partkey || CASE WHEN p_partkey % 5 = 4 THEN '' ELSE ': a' END AS file, CASE p_partkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'found' WHEN 2 THEN 'failed' ELSE 'incomplete' END AS status, CASE WHEN p_partkey % 5 = 1 THEN 'Eicar-Test' END AS threat FROM part""",
    "page_labels": """SELECT DISTINCT l_orderkey AS doc, l_linenumber - 1 AS page, CASE l_linenumber WHEN 1 THEN 'i' WHEN 2 THEN 'ii' WHEN 3 THEN 'iii' ELSE 'A-' || CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_linenumber + 1 AS VARCHAR) ELSE chr(97 + l_linenumber) END END AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "identical_documents": "SELECT sha256(text) AS sha256, doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "related_evidence": """WITH r AS (SELECT 'same_text' AS relation, sha256(text) AS key, doc_id AS member FROM documents UNION ALL SELECT 'same_work', CAST(text_num AS VARCHAR), doc_id FROM documents UNION ALL SELECT 'same_unit', concat_ws('/', text_num, unit), doc_id FROM documents
        UNION ALL SELECT 'same_source', concat_ws('/', source, lang), doc_id FROM documents UNION ALL SELECT 'same_size', CAST(n_chars AS VARCHAR), doc_id FROM documents)
        SELECT relation, key, member FROM (SELECT DISTINCT * FROM r WHERE key IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY relation, key) > 1""",
    "declared_manifests": """WITH p AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS c, bool_or(l_suppkey % 4 = 0) AS s FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, CAST(greatest(max(l_linenumber), CASE WHEN bool_or(s) THEN 9 END) AS INTEGER) AS declared, count(*) AS held, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts FROM p GROUP BY 1)
        SELECT l_orderkey, declared, held, declared - held AS missing, conflicts, declared = held AND conflicts = 0 AS complete FROM m""",
    "merged_flags": "SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS flagged FROM lineitem GROUP BY 1, 2",
    "capped_evidence": """WITH f AS (SELECT l_suppkey, l_returnflag, l_partkey, min(l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY line, l_partkey) AS own, count(*) OVER (PARTITION BY l_suppkey) AS n FROM f),
        b AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY line, l_returnflag, l_partkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY l_suppkey) AS kept FROM a WHERE own <= 16) SELECT l_suppkey, l_returnflag, l_partkey, place, n - least(kept, 40) AS omitted FROM b WHERE place <= 40""",
    "first_seen_users": "SELECT user_id, min(event_id) AS first_line, (SELECT count(DISTINCT user_id) FROM events) AS total FROM events GROUP BY 1 ORDER BY first_line LIMIT 10 OFFSET 10",
    "source_answers": """WITH n AS (SELECT 'verse' AS source, count(*) AS n FROM documents WHERE source = 'verse' UNION ALL SELECT 'none', 0 UNION ALL SELECT 'all', count(*) FROM documents)
        SELECT source, CASE WHEN n = 0 THEN 'empty' WHEN n <= 100 THEN 'complete' ELSE 'more' END AS status, least(n, 100) AS n FROM n UNION ALL SELECT 'gone', 'failed', NULL""",
    "declaration_logs": """WITH b AS (SELECT user_id, event_id // 4096 AS b, sha256(string_agg(event_id || ' ' || event_type, chr(10) ORDER BY event_id)) AS h, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2)
        SELECT user_id, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, chr(10) ORDER BY b)) END AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1""",
    "rolled_forward": """SELECT user_id, event_id, 'purchase' AS event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('click', 'purchase')) WHERE r = 1 AND event_type = 'click'""",
    "appended_absent": """SELECT l_partkey, l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem a WHERE l_quantity >= 49 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_quantity < 10) GROUP BY 1, 2""",
}
