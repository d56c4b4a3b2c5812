"""Functions without a column expression: canonical JSON, tokens, paths, graphemes. Arrow-batched Python."""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import unicodedata
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DuplicateKey(ValueError):
    """A JSON object holds a key twice."""


def strict_json(text: str, depth: int = 16) -> object:
    """A JSON value without duplicate keys, trailing data or more than ``depth`` levels; numbers keep their text."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise DuplicateKey("duplicate key")
        return out

    value = json.loads(text, object_pairs_hook=pairs, parse_float=_Number, parse_int=_Number, parse_constant=_refuse)
    if _depth(value) > depth:
        raise ValueError("too deep")
    return value


class _Number(str):
    """A number kept as it was written."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def _depth(v: object) -> int:
    if isinstance(v, dict):
        return 1 + max(map(_depth, v.values()), default=0)
    if isinstance(v, list):
        return 1 + max(map(_depth, v), default=0)
    return 0


def canonical_json(v: object) -> str:
    """Sorted keys, no white space, numbers as they were written."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical_json, v)) + "]"
    return str(v) if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)


def ordered_json(v: object, kind: T.DataType) -> set[str]:
    """The compact encodings of a value with the fields of objects in the order of a schema: as they are, and with ``< > &`` escaped."""

    def write(v: object, kind: T.DataType | None) -> str:
        if isinstance(v, dict):
            fields = [(f.name, f.dataType) for f in kind.fields if f.name in v] if isinstance(kind, T.StructType) else [(k, None) for k in sorted(v)]
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v[k], t)}" for k, t in fields) + "}"
        if isinstance(v, list):
            return "[" + ",".join(write(x, kind.elementType if isinstance(kind, T.ArrayType) else None) for x in v) + "]"
        return str(v) if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)

    text = write(v, kind)
    return {text, text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")}


def canonical_digest(text: str | None) -> str | None:
    """SHA-256 of the canonical form of a JSON text; null where it is none."""
    try:
        return None if text is None else hashlib.sha256(canonical_json(strict_json(text)).encode()).hexdigest()
    except (ValueError, RecursionError):
        return None


def is_canonical(text: str | None) -> bool:
    """Whether a line is exactly the canonical encoding of its value."""
    try:
        return text is not None and canonical_json(strict_json(text)) == text
    except (ValueError, RecursionError):
        return False


def position_token(**fields: object) -> str:
    """A position as URL-safe base64 of canonical JSON."""
    return base64.urlsafe_b64encode(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def read_token(token: str) -> dict:
    """The position of a token; it must encode to the same token again."""
    value = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    if not isinstance(value, dict) or position_token(**value) != token:
        raise ValueError("not a position token")
    return value


def resolve_href(base: str, href: str) -> tuple[str, str, str]:
    """Member, fragment and status (internal, external, invalid) of a reference inside a package."""
    try:
        u = urlsplit(href)
    except ValueError:
        return "", "", "invalid"
    if u.scheme or u.netloc:
        return "", "", "external"
    path = unquote(u.path)
    member = base if not path else posixpath.normpath(posixpath.join(posixpath.dirname(base), path))
    if member.startswith(("..", "/")):
        return "", "", "invalid"
    return member, unquote(u.fragment), "internal"


def visible_escapes(text: str) -> str:
    """Control and format characters as \\uXXXX (UTF-16 units)."""
    out = []
    for c in text:
        if unicodedata.category(c) in ("Cc", "Cf"):
            raw = c.encode("utf-16-be")
            out += [f"\\u{raw[k]:02x}{raw[k + 1]:02x}" for k in range(0, len(raw), 2)]
        else:
            out.append(c)
    return "".join(out)


def byte_cut(text: str | None, limit: int) -> str | None:
    """The longest beginning of at most ``limit`` UTF-8 bytes that ends with a character."""
    return None if text is None else text.encode()[:limit].decode("utf-8", "ignore")


def cells(cluster: str) -> int:
    """Display cells of a grapheme cluster: 2 for wide and emoji forms, 0 for what isn't drawn, else 1."""
    first = cluster[0]
    if unicodedata.category(first) in ("Cc", "Cf", "Mn", "Me"):
        return 0
    wide = unicodedata.east_asian_width(first) in "WF" or "\ufe0f" in cluster[1:] or 0x1F1E6 <= ord(first) < 0x1F200 and len(cluster) > 1
    return 2 if wide else 1


def grapheme_chunks(word: str, width: int) -> list[str]:
    """A word in pieces of at most ``width`` display cells; clusters are never cut, so a wider one stands alone."""
    out: list[str] = []
    used = 0
    for c in regex.findall(r"\X", word):
        n = cells(c)
        if out and used + n <= width:
            out[-1] += c
            used += n
        else:
            out.append(c)
            used = n
    return out


#: Clusters of a word up to which the eye rests on the cluster of that number, counted from 0 (fixed values).
FOCUS = ((1, 0), (5, 1), (9, 2), (13, 3))


def focus(word: str) -> tuple[str, str, str]:
    """A word split around the cluster the eye rests on."""
    parts = regex.findall(r"\X", word)
    if not parts:
        return "", "", ""
    at = next((k for most, k in FOCUS if len(parts) <= most), 4)
    return "".join(parts[:at]), parts[at], "".join(parts[at + 1 :])


def json_text(c: Column | str) -> Column:
    """A JSON string's value, an empty text for any other JSON value."""
    v = F.try_parse_json(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")), F.lit(""))


def json_texts(c: Column | str) -> Column:
    """A JSON string or list of strings as an array, empty for a JSON null; null where it is something else."""
    v = F.try_parse_json(F.col(c) if isinstance(c, str) else c)
    kind = F.schema_of_variant(v)
    many = F.try_variant_get(v, "$", "array<string>")
    return (F.when(kind == "VOID", F.array().cast("array<string>")).when(kind == "STRING", F.array(F.variant_get(v, "$", "string")))
            .when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(many, lambda x: x.isNull()), many))


def json_size(c: Column | str) -> Column:
    """A whole number from 0, written as a JSON number or a string of digits; else null."""
    x = F.col(c) if isinstance(c, str) else c
    n = F.regexp_extract(x, r'^(?:([+-]?[0-9]+)|"([+-]?[0-9]+)")$', 1)
    n = F.when(n == "", F.regexp_extract(x, r'^"([+-]?[0-9]+)"$', 1)).otherwise(n).try_cast("bigint")
    return F.when(n >= 0, n)


def encoded(c: Column) -> Column:
    """A text as URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decoded(c: Column) -> Column:
    """The inverse of ``encoded``; null for anything that does not encode to the same text again."""
    raw = F.translate(c, "-_", "+/")
    pad = F.pmod(-F.length(raw), F.lit(4))
    whole = F.concat(raw, F.repeat(F.lit("="), pad))
    text = F.when(c.rlike("^[A-Za-z0-9_-]*$") & (pad < 3), F.try_to_binary(whole, F.lit("base64")).cast("string"))
    return F.when(encoded(text) == c, text)


#: Fields of a reference to evidence, in their order, and what it begins with.
EVIDENCE = ("schema_version", "asset_id", "library_id", "holding_sha256", "metadata_sha256", "extractor", "representation_id", "retrieval_sha256")
EVIDENCE_MARK, EVIDENCE_BYTES = "evidence1.", 2048


def evidence_token(fields: dict[str, Column]) -> Column:
    """A reference to evidence: a mark and the encoded JSON of the fields in their order."""
    values = F.struct(*[(F.lit(1) if k == "schema_version" else fields[k]).alias(k) for k in EVIDENCE])
    return F.concat(F.lit(EVIDENCE_MARK), encoded(F.to_json(values)))


def read_evidence(token: Column | str) -> Column:
    """The fields of a reference to evidence, null unless it is exactly what ``evidence_token`` writes for well-formed fields."""
    c = F.col(token) if isinstance(token, str) else token
    text = decoded(F.substring(c, len(EVIDENCE_MARK) + 1, EVIDENCE_BYTES))
    kinds = ", ".join(f"{k} {'int' if k == 'schema_version' else 'string'}" for k in EVIDENCE)
    f = F.from_json(text, kinds)
    digest = lambda k, n, mark="": f[k].rlike(f"^{mark}[0-9a-f]{{{2 * n}}}$")
    ok = (c.startswith(EVIDENCE_MARK) & (F.octet_length(c) <= EVIDENCE_BYTES) & (F.to_json(f) == text) & (f["schema_version"] == 1) & digest("asset_id", 32, "sha256:")
          & digest("library_id", 16, "library:") & digest("holding_sha256", 32) & digest("metadata_sha256", 32) & digest("representation_id", 32, "sha256:")
          & digest("retrieval_sha256", 32) & F.length(f["extractor"]).between(1, 80))
    return F.when(F.coalesce(ok, F.lit(False)), f)


def digest_without(text: str | None, left_out: tuple[str, ...]) -> str | None:
    """SHA-256 of the canonical form of a JSON object without some of its fields; null where it is none."""
    try:
        value = None if text is None else strict_json(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k not in left_out}).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_digest_udf(x: pd.Series) -> pd.Series:
    return x.map(canonical_digest)


@F.pandas_udf(T.BooleanType())
def is_canonical_udf(x: pd.Series) -> pd.Series:
    return x.map(is_canonical)


@F.pandas_udf(T.StringType())
def visible_escapes_udf(x: pd.Series) -> pd.Series:
    return x.map(visible_escapes, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def graphemes_udf(x: pd.Series) -> pd.Series:
    return x.map(lambda w: regex.findall(r"\X", w), na_action="ignore")


def grapheme_chunks_udf(width: int) -> Callable:
    """``grapheme_chunks`` of a width as a column function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda w: grapheme_chunks(w, width), na_action="ignore")

    return run


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("before", "focus", "after")]))
def focus_udf(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([focus(w or "") for w in x], columns=["before", "focus", "after"])


def digest_without_udf(*left_out: str) -> Callable:
    """``digest_without`` some fields as a column function."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: digest_without(t, left_out))

    return run


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("member", "fragment", "status")]))
def resolve_href_udf(base: pd.Series, href: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([resolve_href(b, h) for b, h in zip(base, href)], columns=["member", "fragment", "status"])
