"""Visually identical text with different characters, brought to one form.

A mapping from stored character sequences to what a reader sees is computed
once, from rules over the Unicode character database and short lists of
look-alike letters by script. Its keys have one character or several: every
canonical decomposition (a letter and its accents, in any of their orders) is a
key that gives the composed letter, as are letters struck through by a
combining stroke and the two characters of a line end. The mapping is checked
for conflicts (no output is mapped again; a long key gives what its parts give,
so that overlapping keys agree; no two letters of a script become one) and
compiled into a longest-match transducer (a trie over code points). The
transducer runs over the grapheme clusters of a text in one pass and remembers
the output of each cluster it has met.

The form keeps what is seen: letters, case, accents, punctuation and wording.
White space of any kind and length is one blank, none at the ends; what has no
visible form is nothing; wide, narrow, ligature and numeral compatibility
characters are their plain letters; accents are composed; letters of other
scripts that look like Latin ones (lists below) are those; hyphens are one
character.

Defined results: a null text has the form null and is in no pair; an empty
text, or one of nothing visible, has the form ''. Texts of any length are
handled whole. Repeated texts count once. Columns besides the named ones are
not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.packed import WHITE_SPACE
from shelfmark.session import cut, width

#: Letters by script and the Latin letters they look like (fixed values).
SCRIPTS = {
    "Cyrillic": ("аеорсухіјѕԁԛԝһӏѵАВЕКМНОРСТУХІЈЅԚԜӀҺѴ", "aeopcyxijsdqwhlvABEKMHOPCTYXIJSQWIhV"),
    "Greek": ("οανρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpABEZHIKMNOPTYX"),
    "Armenian": ("օսհոցզյՕՍՏԼ", "ouhngqjOUSL"),
    "Coptic": ("ⲟⲣⲥⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "opcABHIKMNOPCTYX"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᎶᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
LETTERS = {c: to for there, here in SCRIPTS.values() for c, to in zip(there, here, strict=True)}
#: Letters with a combining stroke, or with a dot put on, and the one letter they look like (fixed values).
STRUCK = {
    "o\u0338": "ø", "O\u0338": "Ø", "l\u0338": "ł", "L\u0338": "Ł", "d\u0335": "đ", "D\u0335": "Đ", "h\u0335": "ħ", "H\u0335": "Ħ", "t\u0335": "ŧ", "T\u0335": "Ŧ",
    "b\u0335": "ƀ", "i\u0335": "ɨ", "I\u0335": "Ɨ", "z\u0335": "ƶ", "Z\u0335": "Ƶ", "g\u0335": "ǥ", "G\u0335": "Ǥ", "ı\u0307": "i", "ȷ\u0307": "j",
}
#: Marks that look alike (fixed values): hyphens, letter apostrophe, dots.
MARKS = {"‐": "-", "‑": "-", "ʼ": "’", "․": ".", "ɡ": "g", "ɑ": "a"}
#: Invisible characters outside the format category: joiners, fillers and variation selectors (fixed values).
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Format characters that are drawn (fixed values).
DRAWN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _seen_as(c: str) -> str | None:
    """What one stored character is seen as, or None for itself."""
    n, cat = ord(c), unicodedata.category(c)
    if c in WHITE_SPACE:
        return " "
    if n in INVISIBLE or cat in ("Cc", "Cf") and n not in DRAWN:
        return ""
    for table in (LETTERS, MARKS):
        if c in table:
            return table[c]
    tag, _, parts = unicodedata.decomposition(c).partition(" ")
    if tag not in _TAGS or c == "ſ" or 0x2100 <= n < 0x2150:  # the long s and letter-like signs are seen as themselves
        return None
    got = "".join(chr(int(x, 16)) for x in parts.split())
    return None if got.startswith(" ") and len(got) > 1 else got  # a spacing accent isn't a blank


def _conflicts(mapping: dict[str, str]) -> list[str]:
    """Why ``mapping`` can't be applied in one pass without changing what is seen."""
    against = [f"{k!r} gives {v!r}, which is mapped again" for k, v in mapping.items() if any(c in mapping and mapping[c] != c for c in v)]
    for k, v in mapping.items():
        if len(k) > 1 and k != "\r\n":
            parts = "".join(mapping.get(c, c) for c in k)
            if unicodedata.normalize("NFC", STRUCK.get(parts, parts)) != unicodedata.normalize("NFC", v):
                against.append(f"{k!r} gives {v!r}, its characters give {parts!r}")
    for there, here in SCRIPTS.values():
        seen: dict[str, str] = {}
        for k, v in zip(there, here):
            if v in seen and seen[v].islower() == k.islower() and v.islower():
                against.append(f"{seen[v]!r} and {k!r} of one script both give {v!r}")
            seen.setdefault(v, k)
    return against


@lru_cache(1)
def mapping() -> dict[str, str]:
    """The whole mapping, closed so that one pass suffices."""
    first = {c: s for n in range(0x110000) if not 0xD800 <= n < 0xE000 and (s := _seen_as(c := chr(n))) is not None and s != c}

    def closed(s: str) -> str:
        for _ in range(8):
            t = "".join(first.get(c, c) for c in unicodedata.normalize("NFD", s))
            if t == s:
                break
            s = t
        return s

    out = {k: closed(v) for k, v in first.items()}
    # composed letters whose base letter looks like another, and letters with their accents as several characters
    for n in range(0x110000):
        if not 0xD800 <= n < 0xE000 and not 0xAC00 <= n < 0xD7A4:
            c = chr(n)
            d = unicodedata.normalize("NFD", c)
            if d != c and c not in out and (s := closed(d)) != d:
                out[c] = s
            if len(d) > 1 and not any(first.get(x) == "" for x in d):
                seen = unicodedata.normalize("NFC", closed(d))
                for accents in permutations(d[1:]):  # at most four
                    k = d[0] + "".join(accents)
                    if unicodedata.normalize("NFD", k) == d:
                        out[k] = seen
                for part in range(2, len(d)):  # the first accents already composed
                    if len(head := unicodedata.normalize("NFC", d[:part])) == 1:
                        out[head + d[part:]] = seen
    for k, v in STRUCK.items():
        out[k] = v
        for base in (c for c in (*LETTERS, *MARKS) if first.get(c) == k[0]):
            out[base + k[1:]] = v
    out["\r\n"] = " "
    against = _conflicts(out)
    if against:
        raise ValueError("conflicts in the look-alike mapping: " + "; ".join(against[:5]))
    return out


class Transducer:
    """Longest match over the code points of grapheme clusters, with a memory of the clusters met."""

    def __init__(self, table: dict[str, str], memory: int = 200_000) -> None:
        self.root: dict = {}
        for k, v in table.items():
            node = self.root
            for c in k:
                node = node.setdefault(c, {})
            node[""] = v
        self.memory, self.met = memory, {}
        self.clusters = regex.compile(r"\X")
        self.plain = regex.compile(r"[!-~]+(?: [!-~]+)*").fullmatch

    def cluster(self, s: str) -> str:
        out, i = [], 0
        while i < len(s):
            node, j, best = self.root, i, None
            while j < len(s) and (node := node.get(s[j])) is not None:
                j += 1
                if "" in node:
                    best = (j, node[""])
            i, got = best or (i + 1, s[i])
            out.append(got)
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str | None) -> str | None:
        if text is None or self.plain(text):
            return text
        met = self.met
        out = []
        for c in self.clusters.findall(text):
            got = met.get(c)
            if got is None:
                got = self.cluster(c)
                if len(met) < self.memory:
                    met[c] = got
            out.append(got)
        # a mark cut from its letter by an invisible character joins it now; runs of blanks become one
        return unicodedata.normalize("NFC", " ".join(x for x in "".join(out).split(" ") if x))


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(mapping())


def visible(text: str | None) -> str | None:
    """The one form of ``text``."""
    return transducer()(text)


def visible_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with the form of its string ``column`` in a new last column ``to``."""
    from pyspark.sql.types import StringType, StructField, StructType

    at = df.columns.index(column)
    schema = StructType([*df.schema.fields, StructField(to, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = transducer()
        for b in batches:
            forms = pa.array([f(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, forms], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def look_alike_pairs(texts: DataFrame, group: str, column: str) -> DataFrame:
    """Pairs of different stored texts of one ``group`` that a reader sees as the same: ``group, text_a, text_b``."""
    spark = texts.sparkSession
    distinct = texts.select(group, F.col(column).alias("t")).filter("t IS NOT NULL").distinct().repartition(width(spark), group, "t")
    forms = visible_column(distinct, "t", "form")
    forms = cut(forms.select(group, "t", "form"))
    # only forms with several texts go on; the pairs of a form, which are what is asked for, come from a join of its texts with each other
    several = forms.groupBy(group, "form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    texts = cut(forms.join(several, [group, "form"]))
    other = texts.withColumnRenamed("t", "text_b")
    return texts.withColumnRenamed("t", "text_a").join(other, [group, "form"]).filter("text_a < text_b").select(group, "text_a", "text_b")
