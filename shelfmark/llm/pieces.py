"""Splitting oversized texts at natural boundaries, by content-defined chunking.

Sizes are tokens of a public tokenizer. A rolling hash over the ids marks
landmarks that depend only on the ids around them. A cut is sought between the
minimum and the maximum size: the first landmark there snaps to the nearest
natural boundary (end of a paragraph, line or sentence; else a clause; else a
pre-token), and without a landmark the last natural boundary before the
maximum is taken. Only a single pre-token longer than the maximum is cut
inside. Since landmarks move with their text, an edit changes the pieces near
it and leaves the others as they were.

Each piece but the first starts exactly ``overlap`` tokens before the cut, so
consecutive pieces share that many tokens; a piece has at most ``limit``
tokens, the overlap included. ``ids`` of the pieces, the overlaps taken off,
give the ids of the whole text.

Defined results: a text of at most ``limit`` tokens is one piece; a null or
empty text has no piece. ``text`` of a piece is its bytes; where the overlap
starts within a character, that character's rest is left out of ``text`` (never
of ``ids``). Repeated rows are each split. Texts of any length are split whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tokens import TOKENIZER, Encoder, balanced, shared_encoder

LIMIT, OVERLAP, MINIMUM = 1024, 64, 320
_WINDOW = 16
_MASK = np.uint64(127)
_PARAGRAPH = regex.compile(r"\n\s*\n|[\f\u2029]")
_LINE = regex.compile(r"[\n\r\x85\u2028]")
_SENTENCE = regex.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_CLAUSE = regex.compile(r"[,;:—、，；：][\"'”’»)\]]*$")


def boundary_levels(words: list[str]) -> np.ndarray:
    """How natural a cut after each pre-token is: 3 paragraph, 2 line or sentence, 1 clause, 0 any."""
    seen: dict[str, int] = {}
    out = np.zeros(len(words), np.int8)
    for k, w in enumerate(words):
        v = seen.get(w)
        if v is None:
            v = 3 if _PARAGRAPH.search(w) else 2 if _LINE.search(w) or _SENTENCE.search(w) else 1 if _CLAUSE.search(w) else 0
            seen[w] = v
        out[k] = v
    return out


def landmarks(ids: np.ndarray) -> np.ndarray:
    """Token positions (a cut before the token) whose ``_WINDOW`` preceding ids have a marked hash."""
    n = len(ids)
    if n < _WINDOW:
        return np.zeros(0, np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(n - _WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(_WINDOW):
            h = h * np.uint64(0x100000001B3) + x[k : n - _WINDOW + 1 + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(((h >> np.uint64(40)) & _MASK) == 0) + _WINDOW


def cuts(ids: np.ndarray, words: list[str], per_word: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[int]:
    """Token positions at which a text of more than ``limit`` tokens is cut."""
    n, most = len(ids), limit - overlap
    ends = np.cumsum(per_word)  # positions after whole pre-tokens
    levels = boundary_levels(words)
    marks = landmarks(ids)
    out, at = [], 0
    while n - at > most:
        lo, hi = at + min(minimum, most), at + most
        a, b = np.searchsorted(ends, lo), np.searchsorted(ends, hi, "right")
        if a == b:  # one pre-token reaches over the whole range
            at = hi
            out.append(at)
            continue
        here, lev = ends[a:b], levels[a:b]
        k = np.searchsorted(marks, lo)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else None
        best = here[lev >= 2]
        if not len(best):
            best = here[lev >= 1]
        if not len(best):
            best = here
        at = int(best[np.argmin(np.abs(best - mark))] if mark is not None else best[-1])
        out.append(at)
    return out


def _check(limit: int, overlap: int, minimum: int) -> None:
    if not (0 <= overlap < limit and 0 < minimum <= limit - overlap):
        raise ValueError("0 <= overlap < limit and 0 < minimum <= limit - overlap must hold")


PIECE = "piece_no int, n_pieces int, token_start int, token_end int, n_tokens int, text string, ids array<int>"


def split_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER, limit: int = LIMIT, overlap: int = OVERLAP,
                minimum: int = MINIMUM, only_split: bool = False) -> DataFrame:
    """The pieces of each text; with ``only_split`` those of texts above ``limit`` tokens only."""
    _check(limit, overlap, minimum)
    shared = shared_encoder(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: Encoder = shared.value
        token_bytes = np.zeros(int(enc.ids.max()) + 1, np.int64)
        for b, r in enc.ranks.items():
            token_bytes[r] = len(b)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = part.column(1).to_pylist()
                ids, offsets, per, word_at = enc.encode(texts)
                rows: list[tuple] = []
                for k, t in enumerate(texts):
                    own = ids[offsets[k] : offsets[k + 1]]
                    if not t or only_split and len(own) <= limit:
                        continue
                    if len(own) <= limit:
                        rows.append((part.column(0)[k].as_py(), 1, 1, 0, len(own), len(own), t, own))
                        continue
                    at = cuts(own, enc.pre_tokens(t), per[word_at[k] : word_at[k + 1]], limit, overlap, minimum)
                    byte_at = np.concatenate(([0], np.cumsum(token_bytes[own])))
                    raw = t.encode()
                    for p, (a, e) in enumerate(zip([0, *(x - overlap for x in at)], [*at, len(own)]), 1):
                        piece = raw[byte_at[a] : byte_at[e]].decode("utf-8", "ignore")
                        rows.append((part.column(0)[k].as_py(), p, len(at) + 1, a, e, e - a, piece, own[a:e]))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], part.column(0).type), *(pa.array(x, pa.int32()) for x in c[1:6]), pa.array(c[6], pa.string()),
                         pa.array(c[7], pa.list_(pa.int32()))],
                        names=[key, *(x.split()[0] for x in PIECE.split(", "))])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(text).alias("text"))
    if only_split:  # a token has at least one byte
        rows = rows.filter(F.octet_length("text") > limit)
    return balanced(rows).mapInArrow(run, f"{key} {kind}, {PIECE}")
