"""Content of assets by representation: what can be asked for, its units, ranges and occurrences.

Each representation is a builder over rows ``path, content``. All of them give units as ``path, unit, member, bytes, status``
(and what is particular to them), so a caller names a representation and gets a DataFrame; the bytes are read again for each
query, and an asset that cannot be read gives one row with a ``finding`` and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import text as texts
from shelfmark.operators.structure import bind_references, frame_range, unit_views
from shelfmark.session import cut
from shelfmark.sources import containers, pdf

#: Representations and the operations each has.
REPRESENTATIONS = {
    "epub-text/2": ("units", "read", "locate"), "epub-text/1": ("units", "read"), "epub-structure/1": ("units", "read", "resource"), "epub-source/1": ("read",),
    "pdf-text/1": ("units", "read", "locate"),
    "epub-nav/1": ("units",), "epub-page-list/1": ("units",), "mpeg-audio/1": ("units",), "mp4-audio/1": ("units",), "mp4-packets/1": ("units",),
}
#: Text representations, in the order in which they are tried.
TEXTS = ("epub-text/2", "pdf-text/1")


def capabilities(spark: SparkSession) -> DataFrame:
    """``representation, operation`` of everything that can be asked for."""
    return spark.createDataFrame([(r, o) for r, ops in REPRESENTATIONS.items() for o in ops], "representation string, operation string")


def _documents(files: DataFrame) -> DataFrame:
    """Documents of EPUBs with their text, parts, gaps and links; ``unit`` counts from 1."""
    d = containers.epub_documents(files)
    read = texts.read_markup(d.filter("finding IS NULL").select(F.struct("path", "ord", "member", "bytes").alias("doc"), "markup"), "doc", "markup")
    good = read.select("doc.path", F.col("doc.ord").alias("unit"), "doc.member", F.col("doc.bytes").alias("source_bytes"), "text", "n_chars", "parts", "gaps", "links", F.lit(None).cast("string").alias("finding"))
    bad = d.filter("finding IS NOT NULL").select("path", "finding")
    return good.unionByName(bad, allowMissingColumns=True)


def _text_units(files: DataFrame) -> DataFrame:
    d = _documents(files)
    status = F.when(F.col("finding").isNotNull(), "unreadable").when(F.size("gaps") > 0, "text_with_gaps").otherwise("text")
    return d.select("path", "unit", "member", F.octet_length("text").cast("long").alias("bytes"), status.alias("status"), F.size("gaps").alias("n_gaps"), "n_chars", "finding")


def _strict_units(files: DataFrame) -> DataFrame:
    """A document with an image, table or media has no strict text at all."""
    u = _text_units(files)
    refused = F.col("status") == "text_with_gaps"
    return u.withColumns({"status": F.when(refused, "unsupported_document").otherwise(F.col("status")), "bytes": F.when(~refused, F.col("bytes")), "n_chars": F.when(~refused, F.col("n_chars"))})


def _structure_units(files: DataFrame) -> DataFrame:
    d = _documents(files)
    return d.select("path", "unit", "member", F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("finding").isNotNull(), "unreadable").otherwise("structure").alias("status"),
                    F.size("parts").alias("n_parts"), F.size("links").alias("n_links"), "finding")


def _listed(read: Callable[[DataFrame], DataFrame], number: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: read(files).withColumnRenamed(number, "unit")


def _pages(files: DataFrame) -> DataFrame:
    """Pages of PDF files as documents; ``unit`` counts from 1."""
    p = pdf.pdf_pages(files)
    gaps = F.transform("gaps", lambda g: F.struct(g["kind"].alias("kind"), g["at"].alias("at"), g["detail"].alias("alt")))
    return p.select("path", (F.col("page") + 1).alias("unit"), "label", "text", gaps.alias("gaps"), "n_images", "finding")


def _page_units(files: DataFrame) -> DataFrame:
    p = _pages(files)
    status = F.when(F.col("finding").isNotNull(), "unreadable").when(F.size("gaps") > 0, "text_with_gaps").otherwise("text")
    return p.select("path", "unit", "label", F.octet_length("text").cast("long").alias("bytes"), status.alias("status"), F.size("gaps").alias("n_gaps"), "n_images", "finding")


_UNITS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "epub-text/2": _text_units, "epub-text/1": _strict_units, "epub-structure/1": _structure_units, "epub-nav/1": _listed(containers.epub_navigation, "ord"),
    "epub-page-list/1": _listed(containers.epub_page_lists, "ord"), "mpeg-audio/1": _listed(containers.mp3_frames, "frame_no"), "mp4-audio/1": _listed(containers.mp4_boxes, "ord"),
    "pdf-text/1": _page_units, "mp4-packets/1": _listed(containers.mp4_packets, "packet_no"),
}


def _check(representation: str, operation: str) -> None:
    if operation not in REPRESENTATIONS.get(representation, ()):
        raise ValueError(f"{representation} has no {operation}")


def units(files: DataFrame, representation: str) -> DataFrame:
    """The units of each asset in a representation."""
    _check(representation, "units")
    return _UNITS[representation](files)


def representation_ids(files: DataFrame) -> DataFrame:
    """The identity of each EPUB's text: ``path, representation, units, bytes, with_gaps``."""
    return unit_views(_documents(files).filter("finding IS NULL"), "path", "unit", "text", F.size("gaps"))


def read(files: DataFrame, representation: str, unit: int, start: int, limit: int) -> DataFrame:
    """One range of one unit of each asset: ``path, unit, status, text, start, end, end_of_unit, end_of_source``, gaps, and where to go on.

    ``epub-source/1`` reads the stored markup, the others the text. The next range begins at ``next_unit, next_start``.
    """
    _check(representation, "read")
    if representation == "epub-source/1":
        d = containers.epub_documents(files).filter("finding IS NULL").withColumnsRenamed({"ord": "unit", "markup": "text"}).withColumn("gaps", F.expr("CAST(array() AS array<struct<kind:string,at:bigint,alt:string>>)"))
    elif representation == "pdf-text/1":
        d = _pages(files).filter("finding IS NULL")
    else:
        d = _documents(files).filter("finding IS NULL")
        if representation == "epub-text/1":
            d = d.withColumn("text", F.when(F.size("gaps") == 0, F.col("text")))
    d = cut(d.select("path", "unit", "text", "gaps"))  # containers are read once
    last = d.groupBy("path").agg(F.max("unit").alias("last_unit"))
    r = d.filter(F.col("unit") == unit).select("path", "unit", texts.read_range("text", start, limit, "gaps").alias("r")).join(last, "path")
    ended = F.coalesce(F.col("r.end_of_unit"), F.lit(False))
    over = ended & (F.col("unit") == F.col("last_unit"))
    return r.select("path", "unit", F.coalesce("r.status", F.lit("unsupported_document")).alias("status"), "r.text", "r.start", "r.end", "r.end_of_unit", over.alias("end_of_source"), "r.gaps",
                    F.when(F.col("r.end").isNotNull() & ~over, F.when(ended, F.col("unit") + 1).otherwise(F.col("unit"))).alias("next_unit"),
                    F.when(F.col("r.end").isNotNull() & ~over, F.when(ended, 0).otherwise(F.col("r.end"))).alias("next_start"))


def locate(files: DataFrame, representation: str, needle: str) -> DataFrame:
    """Occurrences of a literal in the units of each asset: ``path, unit, start_byte, end_byte``."""
    _check(representation, "locate")
    d = (_pages if representation == "pdf-text/1" else _documents)(files).filter("finding IS NULL").select(F.struct("path", "unit").alias("doc"), "text")
    return texts.locate(d, "doc", "text", needle).select("doc.path", "doc.unit", "start_byte", "end_byte")


def resource(files: DataFrame, representation: str, member: str, most: int) -> DataFrame:
    """One declared member of each asset, at most ``most`` bytes of it or a finding: ``path, media, bytes, sha256, content``."""
    _check(representation, "resource")
    return containers.epub_member(files, member, most)


def frame_ranges(files: DataFrame, first: int, max_bytes: int) -> DataFrame:
    """Whole frames of each MPEG audio file from frame ``first`` (from 0) on, with the frames that a decoder needs before it."""
    f = cut(containers.mp3_frames(files).filter("kind = 'frame'"))
    f = f.select("path", (F.col("frame_no") - 1).cast("long").alias("no"), "at", "length", F.col("borrows").cast("long").alias("need"), F.col("lends").cast("long").alias("have"))
    asked = f.filter(F.col("no") == first).select("path", F.col("no").alias("first"), F.lit(max_bytes).cast("long").alias("max_bytes"))
    return frame_range(f, asked, "path", "no", "at", "length", "need", "have")


def parts(files: DataFrame, asset: Column | None = None) -> DataFrame:
    """Parts of structured documents, each with its bytes, its text and a reference token that leads back to it."""
    d = _documents(files).filter("finding IS NULL")
    p = d.select("path", "unit", "member", F.encode("text", "UTF-8").alias("_raw"), F.posexplode("parts").alias("i", "p"))
    p = p.select("path", "unit", "member", (F.col("i") + 1).alias("part"), "p.kind", "p.start", "p.end",
                 F.decode(F.substring("_raw", (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int")), "UTF-8").alias("text"))
    name = asset if asset is not None else F.col("path")
    return bind_references(p, {"asset": name, "end": F.col("end"), "member": F.col("member"), "part": F.col("part"), "representation": F.lit("epub-structure/1"), "start": F.col("start"), "unit": F.col("unit")})


def _epub_units(b: bytes) -> Iterator[tuple]:
    """Units of one EPUB: rows of ``_EPUB_UNITS``."""
    for n, member, _, _, _, markup in containers.read_documents(b):
        text, n_chars, _, gaps, _ = texts.markup_of(markup)
        yield n, member, len(text.encode()), "text_with_gaps" if gaps else "text", len(gaps), n_chars


def _pdf_units(b: bytes) -> Iterator[tuple]:
    """Units of one PDF: rows of ``_PDF_UNITS``."""
    for n, label, text, n_images, gaps in pdf.read_pages(b):
        yield n + 1, label, len(text.encode()), "text_with_gaps" if gaps else "text", len(gaps), n_images


_EPUB_UNITS = "unit int, member string, bytes long, status string, n_gaps int, n_chars long"
_PDF_UNITS = "unit int, label string, bytes long, status string, n_gaps int, n_images int"


def text_units(files: DataFrame) -> DataFrame:
    """Units of each asset in the first text representation that reads it; an asset that none reads has one row with its finding.

    Each asset is opened once, where it lies: no join by path, one pass from its bytes to its units. Its text stays in that pass.
    """
    d = containers.first_rows(files, dict(zip(TEXTS, ((_epub_units, _EPUB_UNITS), (_pdf_units, _PDF_UNITS)))))
    return d.select("path", "unit", "member", "bytes", "status", "n_gaps", "n_chars", "finding", F.col("reader").alias("representation"), "label", "n_images")
