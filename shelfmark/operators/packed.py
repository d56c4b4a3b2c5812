"""Several values packed in one field: dialect choice by minimum description length.

A *dialect* is a set of separators together with a way of enclosing values
(none, double quotes with doubled or backslashed quotes inside, or one JSON
array). Every field is read in each dialect that its characters allow. A
reading costs the sum of the code lengths of its values:

* a value that other fields also hold costs ``-log2`` of its share in a
  dictionary, counted over all distinct fields (its own field left out);
* a new value is spelled out, character by character;
* a separator left inside a value that is not enclosed must be escaped and
  costs ``ESCAPE_BITS``; a stray enclosing mark costs ``STRAY_BITS``.

The cheapest reading wins; ties go to the reading with more values, then to
the smaller reading number, so the result is the same on every run.

Defined results: null, empty and blank fields and fields of separators only
give no rows; empty places take no position; a value repeated in a field comes
out each time; values are folded (each run of white space one blank, none at
the ends). A bare comma never separates: it does so only between enclosed
values. A slash and a middle dot separate only with white space on both sides.
Other columns of the input are neither read nor kept, so extra columns with
any names do no harm.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut, width

#: Unicode White_Space (fixed values of the standard).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = re.compile(f"[{WHITE_SPACE}]+")

#: Separators of the dialects: name and pattern.
SEPARATORS = (
    (";", r";"),
    ("；", "；"),
    ("|", r"\|"),
    ("/", rf"(?<=[{WHITE_SPACE}])/(?=[{WHITE_SPACE}])"),
    ("·", rf"(?<=[{WHITE_SPACE}])·(?=[{WHITE_SPACE}])"),
    ("•", "•"),
    ("\n", "\r\n|[\n\r\x85\u2028\u2029]"),
    ("\t", r"\t"),
)
_ANY = {name: re.compile(p) for name, p in SEPARATORS}
#: Separators of one character that need nothing beside them.
_PLAIN = {";", "；", "|", "•", "\t"}

_MAYBE = re.compile("[;；|/·•\n\r\t\x85\u2028\u2029]")
_ASCII_LETTERS = (string.ascii_letters + " ").encode()
_OTHER = re.compile(r"[^\w ]|[\d_]")
_NOTHING = re.compile(f"[{WHITE_SPACE};；|/·•,]*")
#: White space that folding changes.
_UNFOLDED = re.compile(f"[{WHITE_SPACE.replace(' ', '')}]|  ")
LETTER_BITS = 5.0
OTHER_BITS = 6.0
VALUE_BITS = 6.0
ESCAPE_BITS = 14.0
STRAY_BITS = 12.0
#: Values with at least this share of a dictionary are joined by broadcast; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 0.001


def fold(text: str) -> str:
    """Each run of Unicode white space made one blank, none left at the ends."""
    return (_WS.sub(" ", text) if _UNFOLDED.search(text) else text).strip(" ")


def fold_column(col: F.Column | str) -> F.Column:
    """``fold`` as a column expression (stays in the JVM)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, rf"[{WHITE_SPACE}]+", " "))


def _enclosed(raw: str, at: int, mark: str, ends: re.Pattern) -> tuple[str, int] | None:
    """The value enclosed from ``at`` and where it ends, if the enclosure is closed before a separator or the end."""
    out, i, n = [], at + 1, len(raw)
    while i < n:
        c = raw[i]
        if c == "\\" and i + 1 < n and raw[i + 1] in (mark, "\\"):
            out.append(raw[i + 1])
            i += 2
        elif c == mark:
            if i + 1 < n and raw[i + 1] == mark:
                out.append(mark)
                i += 2
                continue
            return ("".join(out), i + 1) if ends.match(raw, i + 1) else None
        else:
            out.append(c)
            i += 1
    return None


_ENDS: dict[frozenset, tuple[re.Pattern, re.Pattern]] = {}


def _patterns(seps: frozenset) -> tuple[re.Pattern | None, re.Pattern]:
    if seps not in _ENDS:
        alts = "|".join(p for name, p in SEPARATORS if name in seps)
        split = re.compile(alts) if alts else None
        near = "|".join(("/" if n == "/" else "·" if n == "·" else p) for n, p in SEPARATORS if n in seps)
        _ENDS[seps] = (split, re.compile(rf"[{WHITE_SPACE}]*(?:,|{near + '|' if near else ''}\Z)"))
    return _ENDS[seps]


Value = tuple[str, bool, int]  # the folded value, whether it was enclosed, how many separators stand in it unprotected


def _bare(part: str, inside: list[re.Pattern]) -> Value:
    return fold(part), False, sum(len(p.findall(part)) for p in inside)


def read_plain(raw: str, seps: frozenset, present: Iterable[str] = _ANY) -> list[Value]:
    """The values of ``raw`` between ``seps``; no enclosure. ``present`` are the separators that stand in ``raw`` at all."""
    split, _ = _patterns(seps)
    parts = split.split(raw) if split else [raw]
    inside = [_ANY[n] for n in present if n not in seps]
    return [v for x in parts if (v := _bare(x, inside))[0]]


def read_enclosed(raw: str, seps: frozenset, present: Iterable[str] = _ANY) -> list[Value]:
    """As ``read_plain``, where a value may stand in double quotes; a comma separates after a closing quote."""
    split, ends = _patterns(seps)
    inside = [_ANY[n] for n in present if n not in seps]
    out, i, n = [], 0, len(raw)
    while i <= n:
        j = i
        while j < n and _WS.match(raw[j]) and not (split and split.match(raw, j)):
            j += 1
        if j < n and raw[j] == '"' and (got := _enclosed(raw, j, '"', ends)):
            value, j = got
            if value := fold(value):
                out.append((value, True, 0))
            m = ends.match(raw, j)
            i = m.end() if m.end() > j or m.end() < n else n + 1
            if m.end() >= n:
                break
            continue
        m = split.search(raw, i) if split else None
        end = m.start() if m else n
        if (bare := _bare(raw[i:end], inside))[0]:
            out.append(bare)
        if not m:
            break
        i = m.end()
    return out


def read_json(raw: str) -> list[Value] | None:
    """The strings of a JSON array, or None where ``raw`` is no such array."""
    s = raw.strip()
    if not (s.startswith("[") and s.endswith("]")):
        return None
    try:
        got = json.loads(s, strict=False)
    except (ValueError, RecursionError):
        return None
    if not isinstance(got, list) or not all(v is None or isinstance(v, str) for v in got):
        return None
    return [(v, True, 0) for v in (fold(x or "") for x in got) if v]


def _present(raw: str) -> list[str]:
    """The separators that stand in a field."""
    marks = set(_MAYBE.findall(raw))
    if not marks:
        return []
    if len(marks) == 1 and (mark := marks.pop()) in _PLAIN:
        return [mark]
    return [n for n, _ in SEPARATORS if _ANY[n].search(raw)]


def readings(raw: str | None) -> list[list[Value]]:
    """The different readings of a field, one for each set of values that a dialect gives."""
    if not raw or not raw[0].isalnum() and _NOTHING.fullmatch(raw):
        return []
    out: dict[tuple, list] = {}
    present = _present(raw)
    if not present and '"' not in raw and raw[0] != "[":
        got = [(fold(raw), False, 0)]
        return [got] if got[0][0] else []
    if (got := read_json(raw)) is not None:
        out.setdefault(tuple(got), got)
    quoted = '"' in raw
    for k in range(len(present), -1, -1):
        for seps in combinations(present, k):
            s = frozenset(seps)
            if quoted:
                got = read_enclosed(raw, s, present)
                out.setdefault(tuple(got), got)
            got = read_plain(raw, s, present)
            out.setdefault(tuple(got), got)
    return list(out.values())


@lru_cache(200_000)
def spelled_bits(value: str) -> float:
    """Code length of a value that no other field holds."""
    others = len(value.encode().translate(None, _ASCII_LETTERS)) if value.isascii() else len(_OTHER.findall(value))
    return VALUE_BITS + LETTER_BITS * len(value) + (OTHER_BITS - LETTER_BITS) * others


def extra_bits(value: str, enclosed: bool, separators: int) -> float:
    """Code length of what must be escaped in a value."""
    bits = ESCAPE_BITS * separators
    if not enclosed:
        if value[:1] == '"' or value[-1:] == '"':
            bits += STRAY_BITS * ((value[:1] == '"') + (value[-1:] == '"'))
            if value.count('"') % 2 == 0:
                bits -= STRAY_BITS / 2
        if value.count('"') % 2:
            bits += STRAY_BITS
        if value[:1] == "[" and value[-1:] == "]":
            bits += 2 * STRAY_BITS
    return bits


_FIELDS = "field_name string, raw string, n_rows long, raw_id long, items array<array<string>>, votes array<array<double>>, own array<array<double>>, spelled array<array<double>>, extra array<array<double>>"


def _nested(values: list, ends: list[int], readings_to: list[int], kind: pa.DataType) -> pa.ListArray:
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
    return pa.ListArray.from_arrays(pa.array(readings_to, pa.int32()), inner)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct fields with the values of all their readings.

    ``own`` is the field's share in the dictionary entry of a value, ``votes`` the same once for each of its values.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 5_000):
            batch = whole.slice(at, 5_000)
            items, votes, own, spelled, extra = [], [], [], [], []
            ends, readings_to = [0], [0]
            for raw in batch.column(1).to_pylist():
                marks = set(_MAYBE.findall(raw)) if raw[:1].isalnum() and '"' not in raw and "[" not in raw else ()
                if len(marks) == 1 and (mark := next(iter(marks))) in _PLAIN:
                    # most fields: one separator and no enclosure, so just two readings
                    own_values = [v for x in raw.split(mark) if (v := fold(x))]
                    first = dict.fromkeys(own_values)
                    unsplit = fold(raw)
                    items += own_values
                    items.append(unsplit)
                    k = len(own_values) + 1
                    own += [0.5] * k
                    if len(first) == k - 1:
                        votes += [0.5] * k
                    else:
                        votes += [0.5 if first.pop(v, 0) is None else 0.0 for v in own_values]
                        votes.append(0.5)
                    spelled += map(spelled_bits, own_values)
                    spelled.append(spelled_bits.__wrapped__(unsplit))  # a whole field hardly comes again
                    extra += [0.0] * (k - 1)
                    extra.append(ESCAPE_BITS * raw.count(mark))
                    ends += (len(items) - 1, len(items))
                    readings_to.append(len(ends) - 1)
                    continue
                all_readings = readings(raw)
                n = len(all_readings)
                if n == 1:
                    share = dict.fromkeys([x[0] for x in all_readings[0]], 1.0)
                else:
                    share = {}
                    for r in all_readings:
                        for v in {x[0] for x in r}:
                            share[v] = share.get(v, 0.0) + 1 / n
                voted = set()
                for r in all_readings:
                    for v, enclosed, inside in r:
                        items.append(v)
                        own.append(share[v])
                        votes.append(0.0 if v in voted else share[v])
                        voted.add(v)
                        spelled.append(spelled_bits(v) if n > 1 else 0.0)
                        extra.append(extra_bits(v, enclosed, inside) if n > 1 else 0.0)
                    ends.append(len(items))
                readings_to.append(len(ends) - 1)
            lists = [_nested(x, ends, readings_to, pa.string() if x is items else pa.float64()) for x in (items, votes, own, spelled, extra)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[x.split()[0] for x in _FIELDS.split(", ")])


def _hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: F.Column | float, spread_by: str) -> DataFrame:
    """``left`` without the last of ``keys``, with the columns of ``right``, null where there are none; ``keys`` are unique in ``right``.

    Heavy keys, at most ``1/HOT_SHARE`` of them, are looked up by broadcast and all others by shuffle. Rows of heavy
    keys get a salt from ``spread_by``, so that they too are spread over all tasks of the one join.
    """
    added = [c for c in right.columns if c not in keys]
    heavy = F.col(weight) >= F.lit(HOT_SHARE) * total
    hot = right.filter(heavy).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in added])
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(spread_by), F.lit(1 << 20))).otherwise(0).cast("long"))
    # a heavy row's last key is not needed any more, so its text is not shuffled
    if dict(left.dtypes)[keys[-1]] == "string":
        marked = marked.withColumn(keys[-1], F.when(F.col("_hot"), "").otherwise(F.col(keys[-1])))
    joined = marked.join(right.filter(~heavy).withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], "left")
    return joined.select(*[c for c in left.columns if c not in keys[-1:]], *[F.coalesce(f"_hot_{c}", c).alias(c) for c in added])


def _code(item: F.Column) -> list[F.Column]:
    """A value as two 64-bit codes. The dictionary only weighs values, so it is joined by these and not by their text."""
    return [F.xxhash64(item).alias("code"), F.xxhash64(F.reverse(item), F.lit(7)).alias("check")]


def choose_readings(fields: DataFrame) -> DataFrame:
    """The cheapest reading of each distinct (``field_name``, ``raw``): ``field_name, raw, items array<string>, n_rows``."""
    spark = fields.sparkSession
    distinct = fields.groupBy("field_name", "raw").agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = distinct.repartition(width(spark), "raw").withColumn("raw_id", F.monotonically_increasing_id())
    read = cut(distinct.select("field_name", "raw", "n_rows", "raw_id").mapInArrow(_read, _FIELDS).filter(F.size("items") > 0))
    # the dictionary: how many distinct fields hold a value, the readings of a field sharing its one vote
    votes = read.select("field_name", F.explode(F.arrays_zip(F.flatten("items").alias("item"), F.flatten("votes").alias("vote"))).alias("v"))
    votes = votes.filter("v.vote > 0").select("field_name", *_code(F.col("v.item")), "v.vote")
    words = cut(votes.groupBy("field_name", "code", "check").agg(F.sum("vote").alias("held")))
    totals = {r["field_name"]: r["t"] for r in words.groupBy("field_name").agg(F.sum("held").alias("t")).collect()}
    total = F.lit(1.0)
    for name, t in totals.items():
        total = F.when(F.col("field_name") == F.lit(name), F.lit(float(t))).otherwise(total)
    several = read.filter(F.size("items") > 1)
    each = several.select("field_name", "raw_id", F.posexplode(F.arrays_zip("items", "own", "spelled", "extra")).alias("reading", "r"))
    each = each.select("field_name", "raw_id", "reading", F.explode(F.arrays_zip("r.items", "r.own", "r.spelled", "r.extra")).alias("v"))
    each = each.select("field_name", "raw_id", "reading", *_code(F.col("v.items")), "v.own", "v.spelled", "v.extra")
    scored = _hot_join(each, words, ["field_name", "code", "check"], "held", total, "raw_id")
    others = F.greatest(F.coalesce("held", F.lit(0.0)) - F.col("own"), F.lit(0.0))
    known = F.when(others > 1e-9, F.log2(total / others) + 1)
    scored = scored.select("raw_id", "reading", (F.least(F.col("spelled"), known) + F.col("extra")).alias("bits"))
    costs = scored.repartition(width(spark), "raw_id").groupBy("raw_id", "reading").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    best = costs.groupBy("raw_id").agg(F.min(F.struct(F.round("bits", 6), -F.col("n"), F.col("reading").alias("reading"))).alias("b")).select("raw_id", "b.reading")
    kept = ["field_name", "raw", "n_rows", "items"]
    chosen = several.select("raw_id", *kept).join(best, "raw_id").withColumn("items", F.element_at("items", F.col("reading") + 1)).select(*kept)
    return chosen.unionByName(read.filter(F.size("items") == 1).withColumn("items", F.col("items")[0]).select(*kept))


def _long(df: DataFrame, fields: list[str], *others: F.Column) -> DataFrame:
    """One row for each packed field that is not null, in one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("raw")) for n in fields])).alias("f")
    return df.select(*others, each).select(*[F.col(c) for c in df.select(*others).columns], "f.field_name", "f.raw").filter("raw IS NOT NULL")


def packed_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """The values of the packed string columns ``fields`` without their rows: ``field_name, item``, each at least once."""
    return choose_readings(_long(df, fields)).select("field_name", F.explode("items").alias("item"))


def split_packed(df: DataFrame, key: str, fields: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per value of the packed string columns ``fields`` of ``df``.

    Result: ``row_id`` (the value of ``key``), the columns ``carry``, ``field_name``, ``pos`` (from 1), ``item``.
    """
    carry = carry or []
    long = _long(df, fields, F.col(key).alias("row_id"), *[F.col(c) for c in carry])
    chosen = cut(choose_readings(long))
    n = chosen.agg(F.sum("n_rows")).first()[0] or 0
    rows = _hot_join(long, chosen, ["field_name", "raw"], "n_rows", F.lit(float(n)), "row_id").filter("items IS NOT NULL")
    out = rows.select("row_id", *carry, "field_name", F.posexplode("items").alias("p", "item"))
    return out.select("row_id", *carry, "field_name", (F.col("p") + 1).cast("int").alias("pos"), "item")
