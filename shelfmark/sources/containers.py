"""Readers of container formats over ``binaryFile`` rows: ZIP, EPUB, MP3, MP4 and recovery packets.

Each reader is a mapper over ``path, content``; a file that can't be read gives
one row with a ``finding`` instead of failing the others.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from shelfmark.functions.codecs import resolve_href

MOST_RATIO, MOST_MEMBER = 200, 256 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, content`` of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


#: What a reader raises on a file that it cannot read.
_BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, AssertionError, RuntimeError, OverflowError, EOFError, struct.error, zlib.error, zipfile.BadZipFile, ElementTree.ParseError)


def _rows(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")] + ["finding"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                try:
                    rows = [(path, *r, None) for r in parse(bytes(content))]
                except _BROKEN as e:
                    rows.append((path, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}"[:200]))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", *names], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"path string, {columns}, finding string")


def first_rows(files: DataFrame, readers: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]]) -> DataFrame:
    """Rows of each file by the first reader that gives any, with its name as ``reader``; else one row with the finding of the last, if it failed.

    A reader is a parser and its columns; those of the others are null. Each file is opened once, in one task.
    """
    kinds = {c.split(" ", 1)[0]: c for _, columns in readers.values() for c in columns.split(", ")}
    names = ["path", "reader", *kinds, "finding"]
    at = {r: [list(kinds).index(c.split(" ", 1)[0]) for c in columns.split(", ")] for r, (_, columns) in readers.items()}

    def of(path: str, content: bytes | None) -> list[tuple]:
        for name, (parse, _) in readers.items():
            finding = None
            try:
                found = list(parse(bytes(content)))
            except _BROKEN as e:
                found, finding = [], f"{type(e).__name__}: {e}"[:200]
            if found:
                rows = []
                for r in found:
                    full: list = [None] * len(kinds)
                    for k, v in zip(at[name], r):
                        full[k] = v
                    rows.append((path, name, *full, None))
                return rows
        return [(path, None, *[None] * len(kinds), finding)] if finding else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for path, content in zip(b["path"], b["content"]):
                rows += of(path, content)
                size += len(content or b"")
                if rows and (size > 1 << 20 or len(rows) > 500):
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, f"path string, reader string, {', '.join(kinds.values())}, finding string")


# ZIP ---------------------------------------------------------------------------------------------------------------


def _member_verdict(i: zipfile.ZipInfo) -> str:
    if i.is_dir():
        return "directory"
    if i.filename.startswith("/") or ".." in i.filename.split("/") or "\\" in i.filename:
        return "unsafe_name"
    if i.flag_bits & 1:
        return "encrypted"
    if i.file_size > MOST_MEMBER or i.file_size > MOST_RATIO * max(i.compress_size, 1):
        return "too_large"
    return "ok"


def zip_members(files: DataFrame) -> DataFrame:
    """Members of ZIP archives with a disposition; nothing is unpacked."""

    def parse(b: bytes) -> Iterator[tuple]:
        for n, i in enumerate(zipfile.ZipFile(io.BytesIO(b)).infolist(), 1):
            yield n, i.filename, i.file_size, i.compress_size, f"{i.CRC:08x}", _member_verdict(i)

    return _rows(files, parse, "ord int, name string, bytes long, packed long, crc string, disposition string")


def nested_members(files: DataFrame, levels: int = 4, most_bytes: int = MOST_MEMBER) -> DataFrame:
    """Members of ZIP archives and of the archives in them, ``levels`` deep: ``ord, level, name, bytes, sha256, disposition``.

    Names of nested members are joined by ``!/``. ``most_bytes`` is one budget for all that is unpacked of a file; what it no
    longer covers is listed as ``over_budget``, what lies deeper as ``too_deep``, and neither is read.
    """

    def walk(b: bytes, prefix: str, level: int, left: list[int]) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(b)) as z:
            for i in z.infolist():
                name, verdict = prefix + i.filename, _member_verdict(i)
                if verdict == "ok" and i.file_size > left[0]:
                    verdict = "over_budget"
                if verdict != "ok":
                    yield level, name, i.file_size, None, verdict
                    continue
                left[0] -= i.file_size
                data = z.read(i)
                archive = data[:4] == b"PK\x03\x04" and i.filename.lower().endswith(".zip")
                yield level, name, i.file_size, hashlib.sha256(data).hexdigest(), "too_deep" if archive and level == levels else "archive" if archive else "ok"
                if archive and level < levels:
                    try:
                        yield from walk(data, name + "!/", level + 1, left)
                    except zipfile.BadZipFile:
                        yield level + 1, name + "!/", None, None, "unreadable"

    def parse(b: bytes) -> Iterator[tuple]:
        for n, row in enumerate(walk(b, "", 1, [most_bytes]), 1):
            yield n, *row

    return _rows(files, parse, "ord int, level int, name string, bytes long, sha256 string, disposition string")


def _get(z: zipfile.ZipFile, name: str) -> bytes:
    i = z.getinfo(name)
    if (v := _member_verdict(i)) != "ok":
        raise ValueError(f"{name}: {v}")
    return z.read(i)


# EPUB --------------------------------------------------------------------------------------------------------------

_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/",
       "h": "http://www.w3.org/1999/xhtml", "e": "http://www.idpf.org/2007/ops", "n": "http://www.daisy.org/z3986/2005/ncx/"}


class Package:
    """The package document of an EPUB: manifest, reading order, declared metadata."""

    def __init__(self, b: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(b))
        if _get(self.zip, "mimetype").strip() != b"application/epub+zip":
            raise ValueError("no EPUB")
        root = ElementTree.fromstring(_get(self.zip, "META-INF/container.xml")).find(".//c:rootfile", _NS)
        self.path = root.get("full-path")
        opf = ElementTree.fromstring(_get(self.zip, self.path))
        at = posixpath.dirname(self.path)
        self.items = {i.get("id"): (posixpath.normpath(posixpath.join(at, unquote(i.get("href")))), i.get("media-type"), i.get("properties") or "") for i in opf.findall(".//o:manifest/o:item", _NS)}
        spine = opf.find("o:spine", _NS)
        self.spine = [(r.get("idref"), r.get("linear", "yes") != "no") for r in spine.findall("o:itemref", _NS)]
        self.ncx = spine.get("toc")
        self.titles = [e.text or "" for e in opf.findall(".//d:title", _NS)]
        self.languages = [e.text or "" for e in opf.findall(".//d:language", _NS)]
        self.identifiers = [(e.get("id") == opf.get("unique-identifier"), e.text or "") for e in opf.findall(".//d:identifier", _NS)]
        self.cover_id = next((m.get("content") for m in opf.findall(".//o:meta", _NS) if m.get("name") == "cover"), None)


EPUB_DOCUMENTS = "ord int, member string, media string, linear boolean, bytes long, markup string"


def read_documents(b: bytes) -> Iterator[tuple]:
    """Documents of one EPUB: rows of ``EPUB_DOCUMENTS``."""
    p = Package(b)
    for n, (ref, linear) in enumerate(p.spine, 1):
        member, media, _ = p.items[ref]
        data = _get(p.zip, member)
        yield n, member, media, linear, len(data), data.decode("utf-8-sig")


def epub_documents(files: DataFrame) -> DataFrame:
    """Documents of EPUBs in reading order."""
    return _rows(files, read_documents, EPUB_DOCUMENTS)


def epub_metadata(files: DataFrame) -> DataFrame:
    """Declared titles, languages and identifiers of EPUBs, and the SHA-256 of the file."""

    def parse(b: bytes) -> Iterator[tuple]:
        p = Package(b)
        yield p.titles, p.languages, [t for _, t in p.identifiers], next((t for u, t in p.identifiers if u), None), hashlib.sha256(b).hexdigest()

    return _rows(files, parse, "titles array<string>, languages array<string>, identifiers array<string>, package_id string, sha256 string")


def epub_navigation(files: DataFrame) -> DataFrame:
    """Entries of the NAV document or the NCX: order, level, parent (0: none), label and target."""

    def walk_nav(node: ElementTree.Element, level: int, parent: int, out: list) -> None:
        for li in node.findall("h:li", _NS):
            head = next((e for e in li if e.tag.endswith(("}a", "}span"))), None)
            me = len(out) + 1
            out.append((me, level, parent, " ".join("".join(head.itertext()).split()) if head is not None else "", head.get("href") if head is not None else None))
            for ol in li.findall("h:ol", _NS):
                walk_nav(ol, level + 1, me, out)

    def walk_ncx(node: ElementTree.Element, level: int, parent: int, out: list) -> None:
        for p in node.findall("n:navPoint", _NS):
            me = len(out) + 1
            label, content = p.find("n:navLabel/n:text", _NS), p.find("n:content", _NS)
            out.append((me, level, parent, " ".join((label.text or "").split()) if label is not None else "", content.get("src") if content is not None else None))
            walk_ncx(p, level + 1, me, out)

    def parse(b: bytes) -> Iterator[tuple]:
        p = Package(b)
        nav = next((m for m, _, props in p.items.values() if "nav" in props.split()), None)
        out: list[tuple] = []
        if nav:
            for n in ElementTree.fromstring(_get(p.zip, nav)).iter("{http://www.w3.org/1999/xhtml}nav"):
                if n.get("{http://www.idpf.org/2007/ops}type") in (None, "toc"):
                    for ol in n.findall("h:ol", _NS):
                        walk_nav(ol, 1, 0, out)
        elif p.ncx:
            nav = p.items[p.ncx][0]
            for m in ElementTree.fromstring(_get(p.zip, nav)).findall("n:navMap", _NS):
                walk_ncx(m, 1, 0, out)
        for n, level, parent, label, href in out:
            member, fragment, status = resolve_href(nav, href) if href else ("", "", "unlinked")
            yield n, level, parent, label, member, fragment, status

    return _rows(files, parse, "ord int, level int, parent int, label string, member string, fragment string, status string")


def epub_member(files: DataFrame, name: str, most: int = MOST_MEMBER) -> DataFrame:
    """One member of each EPUB that its manifest declares, by its path in the package: ``media, bytes, sha256, content``.

    A member above ``most`` bytes, an undeclared or a missing one gives a finding.
    """

    def parse(b: bytes) -> Iterator[tuple]:
        p = Package(b)
        media = next((m for member, m, _ in p.items.values() if member == name), None)
        if media is None:
            raise ValueError(f"{name} is not declared")
        if p.zip.getinfo(name).file_size > most:
            raise ValueError(f"{name} is above {most} bytes")
        data = _get(p.zip, name)
        yield media, len(data), hashlib.sha256(data).hexdigest(), data

    return _rows(files, parse, "media string, bytes long, sha256 string, content binary")


def epub_page_lists(files: DataFrame) -> DataFrame:
    """Entries of the page list of EPUBs: order, label and target, and a ``problem`` where none can be chosen.

    A navigation document with more than one page list, and a package whose navigation documents have one each, are
    ambiguous: each gives one row with its problem (multiple_page_lists, multiple_nav_documents) and no entries.
    """

    def parse(b: bytes) -> Iterator[tuple]:
        p = Package(b)
        lists: list[tuple[str, list]] = []
        for member, _, props in p.items.values():
            if "nav" in props.split():
                navs = [n for n in ElementTree.fromstring(_get(p.zip, member)).iter("{http://www.w3.org/1999/xhtml}nav") if n.get("{http://www.idpf.org/2007/ops}type") == "page-list"]
                if navs:
                    lists.append((member, navs))
        for member, navs in lists:
            problem = "multiple_nav_documents" if len(lists) > 1 else "multiple_page_lists" if len(navs) > 1 else None
            if problem:
                yield 0, None, None, None, "ambiguous", problem
                continue
            for n, a in enumerate(navs[0].iter("{http://www.w3.org/1999/xhtml}a"), 1):
                href = a.get("href")
                target, fragment, status = resolve_href(member, href) if href else ("", "", "unlinked")
                yield n, " ".join("".join(a.itertext()).split()), target, fragment, status, None

    return _rows(files, parse, "ord int, label string, member string, fragment string, status string, problem string")


def epub_cover(files: DataFrame) -> DataFrame:
    """The declared cover image of EPUBs, if there is one."""

    def parse(b: bytes) -> Iterator[tuple]:
        p = Package(b)
        got = next((i for i in p.items.values() if "cover-image" in i[2].split()), None) or p.items.get(p.cover_id or "")
        if got:
            yield got[0], got[1], _get(p.zip, got[0])

    return _rows(files, parse, "member string, media string, image binary")


# MP3 ---------------------------------------------------------------------------------------------------------------

#: Bit rates in kbit/s by MPEG version (1, and 2 for 2 and 2.5) and layer, and sample rates (fixed values).
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def mp3_frames(files: DataFrame) -> DataFrame:
    """Frames, tags and gaps of MPEG audio files of all layers: kind, place, length, bit rate, sample rate, samples.

    A first frame that only describes the stream (Xing, Info or VBRI) is of kind ``info`` and counts no samples. Of a frame
    of layer III, ``borrows`` are the bytes of earlier frames it begins in and ``lends`` its own bytes of main data.
    """

    def reservoir(b: bytes, at: int, length: int) -> tuple[int, int]:
        version, layer = b[at + 1] >> 3 & 3, b[at + 1] >> 1 & 3
        if layer != 1:
            return 0, 0
        mono, first = b[at + 3] >> 6 == 3, version == 3
        side = at + 4 + (0 if b[at + 1] & 1 else 2)
        size = (17 if mono else 32) if first else (9 if mono else 17)
        begin = int.from_bytes(b[side : side + 2].ljust(2, b"\0"), "big")
        return begin >> 7 if first else begin >> 8, max(0, length - (side - at) - size)

    def frame(b: bytes, at: int) -> tuple | None:
        if at + 4 > len(b):
            return None
        h = int.from_bytes(b[at : at + 4], "big")
        version, layer, rate, sample = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
        if h >> 21 != 0x7FF or layer == 0 or version == 1 or rate in (0, 15) or sample == 3:
            return None
        layer = 4 - layer
        kbit, hz = _RATES[1 if version == 3 else 2, layer][rate], _SAMPLES[version][sample]
        samples = 384 if layer == 1 else 1152 if version == 3 or layer == 2 else 576
        if layer == 1:
            return (12 * kbit * 1000 // hz + (h >> 9 & 1)) * 4, kbit, hz, samples
        return samples // 8 * kbit * 1000 // hz + (h >> 9 & 1), kbit, hz, samples

    def parse(b: bytes) -> Iterator[tuple]:
        at, end, n = 0, len(b), 0
        if b[:3] == b"ID3":
            size = 10 + _syncsafe(b[6:10])
            yield n, "id3v2", 0, size, None, None, None, None, None
            at = size
        if b[-128:-125] == b"TAG" and len(b) >= 128:
            end -= 128
            yield n, "id3v1", end, 128, None, None, None, None, None
        gap = None
        while at < end:
            f = frame(b, at)
            if f and (at + f[0] >= end or frame(b, at + f[0])):
                if gap is not None:
                    yield n, "gap", gap, at - gap, None, None, None, None, None
                    gap = None
                if n == 0 and (b[at + 36 : at + 40] == b"VBRI" or any(m in b[at + 4 : at + 40] for m in (b"Xing", b"Info"))):
                    yield n, "info", at, min(f[0], end - at), f[1], f[2], None, None, None
                    at += f[0]
                    continue
                n += 1
                whole = at + f[0] <= end
                yield n, "frame" if whole else "truncated", at, min(f[0], end - at), f[1], f[2], f[3], *reservoir(b, at, f[0])
                at += f[0]
            else:
                gap = at if gap is None else gap
                at += 1
        if gap is not None:
            yield n, "gap", gap, end - gap, None, None, None, None, None

    return _rows(files, parse, "frame_no int, kind string, at long, length long, kbit int, hz int, samples int, borrows int, lends int")


def mp3_chapters(files: DataFrame) -> DataFrame:
    """Chapters of the ID3 tag of MPEG audio files: ``ord, id, start_ms, end_ms, title``; a file without has none."""

    def text(b: bytes) -> str:
        kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
        return b[1:].decode(kinds.get(b[0] if b else 0, "latin-1"), "replace").split("\0")[0]

    def fields(b: bytes, wide: bool) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 10 <= len(b) and b[at : at + 4].strip(b"\0"):
            size = _syncsafe(b[at + 4 : at + 8]) if wide else int.from_bytes(b[at + 4 : at + 8], "big")
            if size <= 0 or at + 10 + size > len(b):
                raise ValueError("an ID3 field leaves its tag")
            yield b[at : at + 4], b[at + 10 : at + 10 + size]
            at += 10 + size

    def parse(b: bytes) -> Iterator[tuple]:
        if b[:3] != b"ID3" or b[3] not in (3, 4):
            return
        n, wide = 0, b[3] == 4
        for kind, body in fields(b[10 : 10 + _syncsafe(b[6:10])], wide):
            if kind == b"CHAP":
                ident, _, rest = body.partition(b"\0")
                start, end = struct.unpack_from(">II", rest)
                title = next((text(x) for k, x in fields(rest[16:], wide) if k == b"TIT2"), None)
                n += 1
                yield n, ident.decode("latin-1"), start, end, title

    return _rows(files, parse, "ord int, id string, start_ms long, end_ms long, title string")


# MP4 ---------------------------------------------------------------------------------------------------------------

_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"edts"}


def _boxes(b: bytes, at: int, end: int, path: str) -> Iterator[tuple[str, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", b, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", b, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, at + head, at + size
        if kind in _NESTED:
            yield from _boxes(b, at + head, at + size, name)
        at += size


def mp4_boxes(files: DataFrame) -> DataFrame:
    """Boxes of MP4 files by path, place and size."""

    def parse(b: bytes) -> Iterator[tuple]:
        for n, (path, at, end) in enumerate(_boxes(b, 0, len(b), ""), 1):
            yield n, path, at, end - at

    return _rows(files, parse, "ord int, box string, at long, length long")


def mp4_packets(files: DataFrame) -> DataFrame:
    """Exact packets of the first audio track: place, size, ticks; from the sample tables."""

    def parse(b: bytes) -> Iterator[tuple]:
        table: dict[str, int] = {}
        for path, at, _ in _boxes(b, 0, len(b), ""):
            table.setdefault(path.rsplit("/", 1)[1], at)
        u = lambda at, n: struct.unpack_from(f">{n}I", b, at)
        at = table["stsz"]
        same, count = u(at + 4, 2)
        sizes = [same] * count if same else list(u(at + 12, count))
        at = table["stts"]
        runs = u(at + 8, 2 * u(at + 4, 1)[0])
        ticks = [d for k in range(0, len(runs), 2) for d in [runs[k + 1]] * runs[k]]
        wide = "co64" in table
        at = table["co64" if wide else "stco"]
        n = u(at + 4, 1)[0]
        chunks = struct.unpack_from(f">{n}Q", b, at + 8) if wide else u(at + 8, n)
        at = table["stsc"]
        k = u(at + 4, 1)[0]
        rule = [u(at + 8 + 12 * j, 3) for j in range(k)]
        i, start = 0, 0
        for c, place in enumerate(chunks, 1):
            per = next(r[1] for r in reversed(rule) if r[0] <= c)
            for _ in range(per):
                if i >= count:
                    break
                yield i + 1, place, sizes[i], start, ticks[i]
                place += sizes[i]
                start += ticks[i]
                i += 1
        if i != count:
            raise ValueError("the chunks do not hold every sample")

    return _rows(files, parse, "packet_no int, at long, length long, start_ticks long, ticks long")


def mp4_chapters(files: DataFrame) -> DataFrame:
    """Chapters of the chapter list of MP4 files: ``ord, start_ms, title``; starts are stored in units of 100 ns."""

    def parse(b: bytes) -> Iterator[tuple]:
        for path, at, end in _boxes(b, 0, len(b), ""):
            if path == "/moov/udta/chpl":
                version, count = b[at], b[at + 8 if b[at] else at + 4]
                at += 9 if version else 5
                for n in range(1, count + 1):
                    start, size = struct.unpack_from(">QB", b, at)
                    if at + 9 + size > end:
                        raise ValueError("a chapter leaves its list")
                    yield n, start // 10_000, b[at + 9 : at + 9 + size].decode("utf-8", "replace")
                    at += 9 + size

    return _rows(files, parse, "ord int, start_ms long, title string")


# recovery packets --------------------------------------------------------------------------------------------------

_MAGIC = b"PAR2\x00PKT"
_PACKETS = {b"PAR 2.0\x00Main\x00\x00\x00\x00": "main", b"PAR 2.0\x00FileDesc": "file", b"PAR 2.0\x00IFSC\x00\x00\x00\x00": "checksums", b"PAR 2.0\x00RecvSlic": "recovery", b"PAR 2.0\x00Creator\x00": "creator"}


def recovery_packets(files: DataFrame) -> DataFrame:
    """Packets of recovery files: set, kind, place, whether the checksum holds, the digest of the body and the file described.

    After a damaged packet the search goes on, so what follows it is found too.
    """

    def parse(b: bytes) -> Iterator[tuple]:
        at = b.find(_MAGIC)
        while at >= 0:
            size = struct.unpack_from("<Q", b, at + 8)[0] if at + 64 <= len(b) else 0
            if 64 <= size <= len(b) - at and size % 4 == 0:
                body = b[at + 32 : at + size]
                good = hashlib.md5(body, usedforsecurity=False).digest() == b[at + 16 : at + 32]
                yield b[at + 32 : at + 48].hex(), _PACKETS.get(b[at + 48 : at + 64], "other"), at, size, good, hashlib.sha256(body).hexdigest(), b[at + 64 : at + 80].hex() if b[at + 48 : at + 64] == b"PAR 2.0\x00FileDesc" else None
                at = b.find(_MAGIC, at + size if good else at + 8)
            else:
                yield None, "truncated", at, len(b) - at, False, None, None
                at = b.find(_MAGIC, at + 8)

    return _rows(files, parse, "set_id string, kind string, at long, length long, checksum_ok boolean, body_sha256 string, file_id string")
