"""Byte-addressed text: occurrences, ranges, words with offsets, structure of markup.

Offsets are UTF-8 bytes, half-open. Everything but the reading of markup stays
in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.codecs import cells
from shelfmark.functions.scalars import CLAUSE_ENDS, CLOSING, SENTENCE_ENDS, _set, col, pause_class
from shelfmark.operators.packed import WHITE_SPACE


def locate(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Leftmost, non-overlapping occurrences of a literal: ``key, ord, start_byte, end_byte``; ``key`` is unique.

    Only sizes in bytes leave the row that holds the text, so a long text costs its number of occurrences.
    """
    if not needle:
        raise ValueError("the needle is empty")
    size = len(needle.encode())
    quoted = r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
    sizes = F.transform(F.split(F.col(text), quoted, -1), lambda p: F.octet_length(p).cast("long"))
    hits = df.filter(F.contains(F.col(text), F.lit(needle))).select(key, sizes.alias("sizes"))
    p = hits.select(key, F.posexplode(F.slice("sizes", F.lit(1), F.size("sizes") - 1)).alias("i", "n"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("n").over(before) + F.col("i") * size
    return p.select(key, (F.col("i") + 1).alias("ord"), start.alias("start_byte"), (start + size).alias("end_byte"))


def _inside_character(raw: Column, at: Column) -> Column:
    """Whether byte ``at`` (from 0) goes on with a character that began before it."""
    return F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")


def read_range(text: Column | str, start: Column | int, limit: int, gaps: Column | str | None = None) -> Column:
    """At most ``limit`` bytes of a text from byte ``start``: ``status, text, start, end, end_of_unit`` and, if asked for, ``gaps``.

    A start outside the text or inside a character is refused (``invalid_request``), never moved; the end is moved back to a
    character's beginning. ``gaps`` is an array of structs with a place ``at``: one lies in the range that starts at or before
    it, at the very end in the last range, so ranges that follow each other tell each gap once. Null texts give null.
    """
    if not 4 <= limit <= 65_536:
        raise ValueError("limit must lie in 4..65536")
    first = (F.lit(start) if isinstance(start, int) else start).cast("int")
    raw = F.encode(col(text), "UTF-8")
    size = F.octet_length(raw)
    far = F.least(size, first + limit)
    inside = lambda back: (far - back < size) & _inside_character(raw, far - back)
    end = F.when(~inside(0), far).when(~inside(1), far - 1).when(~inside(2), far - 2).otherwise(far - 3)
    ok = (first >= 0) & (first <= size) & ((first == size) | ~_inside_character(raw, first))
    part = F.decode(F.substring(raw, first + 1, end - first), "UTF-8")
    fields = [F.when(ok, F.when(end == size, "complete_range").otherwise("partial_range")).otherwise("invalid_request").alias("status"), F.when(ok, part).alias("text"),
              F.when(ok, first).alias("start"), F.when(ok, end).alias("end"), F.when(ok, end == size).alias("end_of_unit")]
    if gaps is not None:
        fields.append(F.when(ok, F.filter(col(gaps), lambda g: ((g["at"] >= first) & (g["at"] < end)) | ((g["at"] == end) & (end == size)))).alias("gaps"))
    return F.when(col(text).isNotNull(), F.struct(*fields))


def words_with_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words between white space with byte offsets and pause: ``key, ord, word, start_byte, pause``. One pass over each text, no shuffle."""
    kind = df.schema[key].dataType.simpleString()
    words = re.compile(f"[^{WHITE_SPACE}]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = last = 0
                for n, m in enumerate(words.finditer(t or ""), 1):
                    at += len(t[last : m.start()].encode())
                    last = m.start()
                    rows.append((k, n, m[0], at))
                if len(rows) > 20_000:
                    yield batch(b, rows)
                    rows = []
            if rows:
                yield batch(b, rows)

    def batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c[0], b.column(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64())],
                                          names=[key, "ord", "word", "start_byte"])

    found = df.select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, ord int, word string, start_byte long")
    return found.withColumn("pause", pause_class("word"))


def word_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words and pauses of each text, counted in place: ``key, words, sentences, clauses``.

    A pause is a mark at the end of a word, closing quotes and brackets aside.
    """
    ws, close = r"[ \t\n\x0b\x0c\r]", _set(CLOSING) + "*"
    n = lambda pattern: F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(pattern)).cast("long")
    ends = lambda marks: n(f"[{marks}]{close}(?={ws}|\\z)")
    return df.select(key, n(f"[^{ws[1:]}+").alias("words"), ends(SENTENCE_ENDS).alias("sentences"), ends(CLAUSE_ENDS).alias("clauses"))


def line_breaks(df: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    """Byte places of line feeds within ``[start, end)``."""
    found = locate(df, key, text, "\n")
    return found.filter((F.col("start_byte") >= start) & (F.col("start_byte") < end)).select(key, F.col("start_byte").alias("at"))


def line_layout(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Words laid out greedily in lines of ``width`` display cells: ``key, line_no, first_word, last_word, start_byte, n_cells``.

    A line feed ends a line, a word wider than a line stands alone. Each text is laid out where it lies.
    """
    if width < 1:
        raise ValueError("width must be positive")
    kind = df.schema[key].dataType.simpleString()
    tokens, clusters = re.compile(f"\n|[^{WHITE_SPACE}]+"), regex.compile(r"\X")

    def lines(t: str) -> Iterator[tuple]:
        no = word = at = last = used = first = begin = 0
        for m in tokens.finditer(t):
            at += len(t[last : m.start()].encode())
            last = m.start()
            if m[0] == "\n":
                if first:
                    no += 1
                    yield no, first, word, begin, used
                first = used = 0
                continue
            n = len(m[0]) if m[0].isascii() else sum(map(cells, clusters.findall(m[0])))
            if first and used + 1 + n > width:
                no += 1
                yield no, first, word, begin, used
                first = used = 0
            word += 1
            used, first, begin = (used + 1 + n, first, begin) if first else (n, word, at)
        if first:
            yield no + 1, first, word, begin, used

    names = ["line_no", "first_word", "last_word", "start_byte", "n_cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = list(lines(b.column(1)[k].as_py() or ""))
                if rows:
                    own = pa.array([b.column(0)[k].as_py()] * len(rows), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[key, *names])

    return df.select(key, F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} long" for n in names))


def items_of(words: DataFrame, key: str, start: str, breaks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Words, breaks and gaps of texts in one order: ``key, at, kind, value``; ``breaks`` have ``at``, ``gaps`` ``at, kind``.

    At one place a break comes before a gap and a gap before a word.
    """
    w = words.select(key, F.col(start).cast("long").alias("at"), F.lit("word").alias("kind"), F.col("word").alias("value"), F.lit(2).alias("side"))
    b = breaks.select(key, F.col("at").cast("long"), F.lit("break").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("side"))
    g = gaps.select(key, F.col("at").cast("long"), F.lit("gap").alias("kind"), F.col("kind").alias("value"), F.lit(1).alias("side"))
    return w.unionByName(b).unionByName(g)


def first_at_or_after(points: DataFrame, items: DataFrame, key: str, at: str) -> DataFrame:
    """The first item of the key at or after each point: ``item_at``, null behind the last. One window over both, no range join."""
    p = points.select(key, at, F.struct(*[c for c in points.columns if c not in (key, at)]).alias("p"), F.lit(None).cast("long").alias("item"), F.lit(0).alias("side"))
    i = items.select(key, at, F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.col(at).cast("long").alias("item"), F.lit(1).alias("side"))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(0, Window.unboundedFollowing)
    both = p.unionByName(i).withColumn("item_at", F.first("item", True).over(w))
    return both.filter("side = 0").select(key, at, "p.*", "item_at")


_BLOCKS = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "table", "tr", "td", "th", "pre", "hr", "br", "dl", "dt", "dd", "figure", "figcaption"}
_GAPS = {"img": "image", "table": "table", "audio": "media", "video": "media", "svg": "image", "math": "math", "object": "media", "iframe": "media"}


class _Reader(HTMLParser):
    """Text, parts, gaps and links of a markup document; the text has one line feed between blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.parts, self.gaps, self.links, self.hidden, self.size = [], [], [], [], 0, 0
        self.open: tuple[str, int] | None = None
        self.space = False  # white space stands between the last words and the next

    def add(self, s: str) -> None:
        self.text.append(s)
        self.size += len(s.encode())

    def close_part(self) -> None:
        if self.open and self.size > self.open[1]:
            self.parts.append((self.open[0], self.open[1], self.size))
            self.add("\n")
        self.open = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hidden += 1
        if tag in _GAPS:
            self.gaps.append((_GAPS[tag], self.size, a.get("alt")))
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], self.size))
        if tag in _BLOCKS:
            self.close_part()
            self.open = (tag, self.size)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.close_part()

    def handle_data(self, data: str) -> None:
        words = data.split()
        if self.hidden or not words:
            self.space |= bool(data)
            return
        if self.open is None:
            self.open = ("text", self.size)
        glue = " " if self.size > self.open[1] and (self.space or data[:1].isspace()) else ""
        self.add(glue + " ".join(words))
        self.space = data[-1:].isspace()


MARKUP = "text string, n_chars long, parts array<struct<kind:string,start:long,end:long>>, gaps array<struct<kind:string,at:long,alt:string>>, links array<struct<href:string,at:long>>"


def markup_of(m: str | None) -> tuple[str, int, list, list, list]:
    """Text, characters that are no white space, parts, gaps and links of one markup document."""
    r = _Reader()
    r.feed(m or "")
    r.close()
    r.close_part()
    text = "".join(r.text).rstrip("\n")
    return text, len("".join(text.split())), r.parts, r.gaps, r.links


def read_markup(df: DataFrame, key: str, markup: str) -> DataFrame:
    """Text, parts, gaps and links of markup documents; a null alt was not declared, an empty one was declared empty."""
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    gap = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int64()), ("alt", pa.string())]))
    link = pa.list_(pa.struct([("href", pa.string()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1).to_pylist():
                text, n_chars, parts, gaps, links = markup_of(m)
                rows.append((text, n_chars, [dict(zip(("kind", "start", "end"), p)) for p in parts], [dict(zip(("kind", "at", "alt"), g)) for g in gaps], [dict(zip(("href", "at"), x)) for x in links]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.int64(), part, gap, link)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=[key, *(x.split()[0] for x in ("text", "n_chars", "parts", "gaps", "links"))])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(markup).alias("m")).mapInArrow(run, f"{key} {kind}, {MARKUP}")
