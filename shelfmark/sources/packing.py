"""Small valid containers around given contents: EPUB packages, ZIP archives, MP3, MP4 and recovery files.

They are what the readers of ``containers`` read, so each reader can be run over whole tables and compared with what was
packed. Every packer is a plain function over bytes, for use inside Arrow mappers.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that no XML document may hold.
_NOT_XML = re.compile(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]")
_DATE = (1980, 1, 1, 0, 0, 0)


def xml_text(text: str | None) -> str:
    """A text as XML character data; characters that XML does not allow are left out."""
    return escape(_NOT_XML.sub("", text or ""))


def zip_of(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of named members, the same bytes for the same members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, _DATE), data)
    return out.getvalue()


def epub_of(title: str, language: str, identifiers: list[str], chapters: list[tuple[str, str]], pages: list[tuple[str, str]] | None = None, cover: bytes | None = None) -> bytes:
    """An EPUB whose chapters are ``(heading, markup of the body)``; ``pages`` are ``(label, href)`` of a page list."""
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(1, len(chapters) + 1))
    image = '<item id="img" href="cover.png" media-type="image/png" properties="cover-image"/>' if cover is not None else ""
    names = "".join(f'<dc:identifier id="i{k}">{xml_text(x)}</dc:identifier>' for k, x in enumerate(identifiers))
    opf = (f'<package xmlns="http://www.idpf.org/2007/opf" unique-identifier="i0" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml_text(title)}</dc:title>'
           f'<dc:language>{xml_text(language)}</dc:language>{names}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}{image}</manifest>'
           f'<spine>{"".join(f"<itemref idref={chr(34)}c{k}{chr(34)}/>" for k in range(1, len(chapters) + 1))}</spine></package>')  # fmt: skip
    entries = "".join(f'<li><a href="c{k}.xhtml">{xml_text(h)}</a></li>' for k, (h, _) in enumerate(chapters, 1))
    listed = "" if pages is None else '<nav epub:type="page-list"><ol>' + "".join(f"<li><a href={quoteattr(href)}>{xml_text(label)}</a></li>" for label, href in pages) + "</ol></nav>"
    nav = f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{entries}</ol></nav>{listed}</body></html>'
    members = [("mimetype", b"application/epub+zip"),
               ("META-INF/container.xml", b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'),
               ("OPS/p.opf", opf.encode()), ("OPS/nav.xhtml", nav.encode())]
    members += [(f"OPS/c{k}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'.encode()) for k, (_, body) in enumerate(chapters, 1)]
    return zip_of(members + ([("OPS/cover.png", cover)] if cover is not None else []))


def mp3_of(frames: int, rate_index: int = 9, gap_after: int = 0, tag: bytes = b"") -> bytes:
    """MPEG 1 layer III frames at 44,100 Hz; junk after frame ``gap_after``, a tag before them if given."""
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[rate_index]
    frame = bytes([0xFF, 0xFB, rate_index << 4, 0])
    frame += b"\0" * (144 * kbit * 1000 // 44100 - 4)
    size = len(tag)
    head = b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag if tag else b""
    return head + b"".join(frame + (b"junk" if k == gap_after else b"") for k in range(1, frames + 1))


def id3_chapters(chapters: list[tuple[str, int, int, str]]) -> bytes:
    """The fields of an ID3 tag (version 4) for chapters ``(id, start, end, title)``."""
    size = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    field = lambda kind, body: kind + size(len(body)) + b"\0\0" + body
    return b"".join(field(b"CHAP", i.encode("latin-1") + b"\0" + struct.pack(">IIII", a, z, 0xFFFFFFFF, 0xFFFFFFFF) + field(b"TIT2", b"\x03" + t.encode())) for i, a, z, t in chapters)


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4_of(sizes: list[int], ticks: int, a_chunk: int, start: int, chapters: list[tuple[int, str]] | None = None) -> bytes:
    """The tables of an MP4 audio track: packets of ``sizes`` and ``ticks`` each, ``a_chunk`` to a chunk, beginning at ``start``; a list of chapters ``(start in ms, title)``."""
    full = lambda *n: struct.pack(f">{len(n) + 1}I", 0, *n)
    chunks = [sizes[k : k + a_chunk] for k in range(0, len(sizes), a_chunk)]
    places, at = [], start
    for c in chunks:
        places.append(at)
        at += sum(c)
    rule = [(1, a_chunk, 1)] + ([(len(chunks), len(chunks[-1]), 1)] if len(chunks) > 1 and len(chunks[-1]) != a_chunk else [])
    if len(chunks) == 1:
        rule = [(1, len(sizes), 1)]
    stbl = _box(b"stsz", full(0, len(sizes), *sizes)) + _box(b"stts", full(1, len(sizes), ticks)) + _box(b"stsc", full(len(rule), *[x for r in rule for x in r])) + _box(b"stco", full(len(places), *places))
    listed = b"".join(struct.pack(">QB", ms * 10_000, len(t.encode())) + t.encode() for ms, t in chapters or [])
    marks = b"" if chapters is None else _box(b"udta", _box(b"chpl", b"\1\0\0\0" + bytes(4) + bytes([len(chapters)]) + listed))
    return _box(b"ftyp", b"M4A \0\0\0\0") + _box(b"moov", _box(b"trak", _box(b"mdia", _box(b"minf", _box(b"stbl", stbl)))) + marks)


def recovery_of(set_id: bytes, packets: list[tuple[str, bytes]]) -> bytes:
    """Recovery packets of a set: kinds main, file, recovery, creator or broken (a main packet whose checksum is wrong), and bodies."""
    kinds = {"main": b"PAR 2.0\x00Main\x00\x00\x00\x00", "file": b"PAR 2.0\x00FileDesc", "recovery": b"PAR 2.0\x00RecvSlic", "creator": b"PAR 2.0\x00Creator\x00"}
    out = []
    for kind, body in packets:
        rest = set_id + kinds.get(kind, kinds["main"]) + body + b"\0" * (-len(body) % 4)
        digest = hashlib.md5(rest, usedforsecurity=False).digest()
        out.append(b"PAR2\x00PKT" + struct.pack("<Q", 32 + len(rest)) + (digest if kind in kinds else bytes(16)) + rest)
    return b"".join(out)


def pdf_of(pages: list[str], labels: list[tuple[int, str, str, int]] | None = None, image_on: int = -1) -> bytes:
    """A PDF of text pages. Characters are written as codes of a font whose ToUnicode map names them, a line for each line of the text.

    ``labels`` are ``(first page, style, prefix, start)``; the page ``image_on`` draws an image at its end.
    """
    letters = sorted({c for p in pages for c in p if c not in "\n"})
    code = {ord(c): f"{k:04x}" for k, c in enumerate(letters, 1)}
    chars = [f"<{k}> <{chr(c).encode('utf-16-be').hex()}>" for c, k in code.items()]
    maps = "".join(f"{len(chars[k : k + 100])} beginbfchar\n" + "\n".join(chars[k : k + 100]) + "\nendbfchar\n" for k in range(0, len(chars), 100))
    cmap = f"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange\n{maps}endcmap end".encode()
    objects: list[bytes] = []

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, more: str = "") -> int:
        z = zlib.compress(data)
        return put(f"<</Length {len(z)}/Filter/FlateDecode{more}>>stream\n".encode() + z + b"\nendstream")

    to = stream(cmap)
    font = put(f"<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/ToUnicode {to} 0 R/DescendantFonts[]>>".encode())
    image = stream(b"\0", "/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray")
    tree = len(objects) + 2 * len(pages) + 1
    kids = []
    for k, p in enumerate(pages):
        lines = p.translate(code).replace("\n", "> Tj 0 -14 Td <")
        content = stream(f"BT /F 12 Tf 72 720 Td <{lines}> Tj ET{' /I Do' if k == image_on else ''}".encode())
        kids.append(put(f"<</Type/Page/Parent {tree} 0 R/Contents {content} 0 R>>".encode()))
    put(f"<</Type/Pages/Count {len(pages)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]/Resources<</Font<</F {font} 0 R>>/XObject<</I {image} 0 R>>>>>>".encode())
    rules = "" if labels is None else "/PageLabels<</Nums[" + " ".join(f"{at}<</S/{style}/P({prefix})/St {start}>>" for at, style, prefix, start in labels) + "]>>"
    root = put(f"<</Type/Catalog/Pages {tree} 0 R{rules}>>".encode())
    out, places = b"%PDF-1.7\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + table.encode() + f"trailer<</Size {len(objects) + 1}/Root {root} 0 R>>\nstartxref\n{len(out)}\n%%EOF".encode()


def packed(rows: DataFrame, key: str, pack: Callable[..., bytes]) -> DataFrame:
    """``path, content`` of a container for each row: ``path`` is the key, ``pack`` gets the other columns in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                content = [pack(*r) for r in zip(*(c.to_pylist() for c in part.columns[1:]))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    others = [c for c in rows.columns if c != key]
    return rows.selectExpr(f"CAST(`{key}` AS STRING) AS path", *[f"`{c}`" for c in others]).mapInArrow(run, "path string, content binary")
