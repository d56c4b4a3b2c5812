"""Identifiers stated by packages and sources: parts, roles and names as column expressions.

What is stated is classified, never guessed: a value that fits no rule keeps its text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.scalars import GRAMMARS, col, isbn10_ok, isbn13_ok

#: Places that resolve a DOI, and places of works and editions, as patterns (fixed values).
DOI_PLACE = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)"
WORK_PLACE, BOOK_PLACE = r"(?i)^https://openlibrary\.org/works/(OL[1-9][0-9]{0,11}W)/?$", r"(?i)^https://openlibrary\.org/books/(OL[1-9][0-9]{0,11}M)/?$"


def accession_parts(c: Column | str) -> Column:
    """Accession and version (0: none stated) of a ``pmc:`` id, or null."""
    paper = F.regexp_extract(col(c), GRAMMARS["pmc"], 1)
    version = F.coalesce(F.regexp_extract(col(c), GRAMMARS["pmc"], 2).try_cast("int"), F.lit(0))
    return F.when(paper != "", F.struct(paper.alias("paper"), version.alias("version")))


def accession_pdf(paper: Column | str, version: Column | str) -> Column:
    """Name of the PDF of one version of an accession."""
    return F.concat(col(paper), F.lit("."), col(version).cast("string"), F.lit(".pdf"))


def handle_number(c: Column | str) -> Column:
    """Number of an ``oapen:`` handle, or null."""
    n = F.regexp_extract(col(c), GRAMMARS["oapen"], 1)
    return F.when(n != "", n)


def stated_isbn(c: Column | str) -> Column:
    """``isbn:`` and the digits of a right ISBN of 10 or 13 places, or null; only digits, X, hyphens and blanks may stand in it."""
    v = F.trim(F.regexp_replace(F.trim(col(c)), "(?i)^urn:isbn:", ""))
    digits = F.upper(F.regexp_replace(v, "[- ]", ""))
    return F.when(v.rlike("^[0-9Xx -]*$") & (isbn13_ok(digits) | isbn10_ok(digits)), F.concat(F.lit("isbn:"), digits))


def stated_doi(c: Column | str) -> Column:
    """``doi:`` and the body of a DOI, its case kept, or null: 2 to 9 digits, then up to 200 visible ASCII characters without quotes, brackets and ``\\ # ?``."""
    body = F.regexp_replace(F.trim(col(c)), DOI_PLACE, "")
    ok = body.rlike(r"""^10\.[0-9]{2,9}/(?:(?![\\"'<>#?])[\x21-\x7e]){1,200}$""") & F.octet_length(body).between(8, 220)
    return F.when(ok, F.concat(F.lit("doi:"), body))


def looks_doi(c: Column | str, scheme: Column | str) -> Column:
    """Whether a value is meant as a DOI by its scheme and its beginning."""
    s, low = F.lower(F.coalesce(col(scheme), F.lit(""))), F.lower(F.trim(col(c)))
    placed = low.rlike(DOI_PLACE)
    return s.isin("", "doi", "url") & (placed | ((s == "doi") & low.startswith("10.")))


def library_key(c: Column | str, scheme: Column | str) -> Column:
    """``role`` (work or edition) and ``key`` of a work's or edition's address, or null."""
    s, v = F.lower(F.coalesce(col(scheme), F.lit(""))), F.trim(col(c))
    work = F.upper(F.regexp_extract(v, WORK_PLACE, 1))
    book = F.upper(F.regexp_extract(v, BOOK_PLACE, 1))
    role = F.when(work != "", "work").when(book != "", "edition")
    return F.when(s.isin("", "url", "openlibrary") & role.isNotNull(), F.struct(role.alias("role"), F.concat(work, book).alias("key")))


def stated_role(c: Column | str, scheme: Column | str) -> Column:
    """``role`` and ``id`` of a stated identifier: ISBN, then DOI, then a work's or edition's address; null where none fits."""
    s, low = F.lower(F.coalesce(col(scheme), F.lit(""))), F.lower(F.trim(col(c)))
    isbn = s.isin("isbn", "isbn-10", "isbn-13") | ((s == "") & low.startswith("urn:isbn:"))
    pair = lambda role, ident: F.when(ident.isNotNull(), F.struct(role.alias("role"), ident.alias("id")))
    key = library_key(c, scheme)
    address = F.concat(F.lit("openlibrary_"), key["role"], F.lit(":"), key["key"])
    return (F.when(isbn, pair(F.lit("edition"), stated_isbn(c))).when(looks_doi(c, scheme), pair(F.lit("publication_version"), stated_doi(c)))
            .otherwise(pair(key["role"], address)))


def package_identity(c: Column | str, scheme: Column | str) -> Column:
    """``role, id, confidence`` of a package's identifier; one of no known role is kept under the digest of what was stated. Null: not usable."""
    raw, s = F.trim(col(c)), F.trim(F.coalesce(col(scheme), F.lit("")))
    usable = (raw != "") & (F.octet_length(raw) <= 1000) & ~raw.rlike("[\\x00\r\n]") & (F.octet_length(s) <= 64) & ~s.rlike("[\\x00\r\n]")
    known = stated_role(raw, s)
    kept = F.concat(F.lit("stated:"), F.sha2(F.concat(s, F.lit("\n"), raw), 256))
    return F.when(usable, F.struct(F.coalesce(known["role"], F.lit("unassigned")).alias("role"), F.coalesce(known["id"], kept).alias("id"),
                                   F.when(known.isNotNull(), "stated").otherwise("preserved").alias("confidence")))


def source_identity(field: Column | str, c: Column | str) -> Column:
    """``role`` and ``id`` of a declared field of a source, or null: nothing but the four known fields is recorded."""
    f, v = col(field), col(c)
    usable = (F.trim(v) == v) & (v != "") & (F.octet_length(v) <= 300) & ~v.rlike("[\\x00\r\n]")
    pair = lambda role, ident: F.when(ident.isNotNull(), F.struct(F.lit(role).alias("role"), ident.alias("id")))
    key = lambda mark, name: F.when(v.rlike(f"(?i)^OL[1-9][0-9]{{0,11}}{mark}$"), F.concat(F.lit(name), F.upper(v)))
    got = (F.when((f == "isbn") | ((f == "external-identifier") & F.lower(v).startswith("urn:isbn:")), pair("edition", stated_isbn(v)))
           .when(f == "openlibrary_edition", pair("edition", key("M", "openlibrary_edition:"))).when(f == "openlibrary_work", pair("work", key("W", "openlibrary_work:"))))
    return F.when(usable, got)


def file_stem(title: Column | str, digest: Column | str, most: int = 80) -> Column:
    """A portable file name: letters and digits of the title (about ``most`` bytes) joined by hyphens, and the digest's beginning."""
    spaced = F.regexp_replace(F.coalesce(col(title), F.lit("")), r"[ \-_.,/\\]+", "-")
    joined = F.regexp_replace(F.regexp_replace(spaced, r"[^\p{L}\p{Nd}-]", ""), "-+", "-")
    stem = F.regexp_replace(F.substring(F.regexp_replace(joined, "^-+", ""), 1, most), "-+$", "")
    return F.when(stem == "", F.substring(col(digest), 1, 16)).otherwise(F.concat(stem, F.lit("-"), F.substring(col(digest), 1, 8)))


def search_words(title: Column | str, creator: Column | str, most: int = 200) -> Column:
    """A plain query of at most ``most`` characters from a title and a creator: quotes, colons and brackets are left out."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[":()\s\p{Cntrl}]+', " "))
    return F.trim(F.substring(F.trim(F.concat_ws(" ", clean(title), clean(creator))), 1, most))
