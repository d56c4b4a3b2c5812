"""Evaluation passages inside corpus documents: a prefix-filtered join of word shingles, verified exactly.

A case is a document that holds a stretch of at least ``MIN_WORDS``
consecutive words of a passage in which at most one word in ``ERROR_EVERY`` is
changed, added or missing; both ends of the stretch are words of the passage.

Size of a shingle: an error destroys at most ``SHINGLE`` shingles, so of the
``n - SHINGLE + 1`` shingles of n words at most ``SHINGLE * (n / ERROR_EVERY)``.
With five words 10 of the 12 shingles of 16 words may be gone and nothing can be
left out; with three words 6 of 14 may, so any 7 of the 14 are a necessary
prefix. That is why shingles have three words here (the error rate is given).

1. Texts become word sequences: case, punctuation, markup, escapes, line
   breaks and the form of characters are taken off. Words are numbered in the
   vocabulary of the passages (0: a word of none of them).
2. The texts are read once. A document range is kept if it can hold a case by
   length: at least ``LEAST`` places with a shingle of some passage within the
   length of the shortest parts of a case. The number of documents that hold
   each shingle is counted over the whole corpus in the same pass.
3. Shingles are ordered by rarity, and the commonest are left out while every
   window of a passage keeps its necessary prefix (``Passages.prefix``): about
   half of all. Only these are joined with the documents.
4. Length and position bounds: around a joined shingle, ``MIN_WORDS`` passage
   words in a row must be there but for three, shifted by ``PART_ERRORS`` at most.
5. Each candidate is verified by extending an exact run of words to both sides
   with 0, 1, 2, ... errors as far as they reach, over windows of the size of
   the item; the stretch found is exact, not estimated.

Why parts of few errors do: a case of 42 words or more can be cut between two
matched words into two parts of at least ``MIN_WORDS`` words, since its errors
spoil fewer than all places to cut, and one of the two is a case by itself. So
each case has a part that is a case, of at most 41 words and 5 errors.

The passages are a stated query set. They are packed into blocks of at most
``MAX_BROADCAST_SHINGLES`` shingles by the executors; the driver holds one block
at a time, each block is a pass of its own over the documents, and the result
is the same for any blocks.

Defined results: null, empty and short texts and passages give no rows; items
with the same passage leak together, each once for a document; repeated
documents are each reported. Columns besides the named ones are not read.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.llm.tokens import balanced
from shelfmark.llm.visual import mapping
from shelfmark.session import cut

SHINGLE, MIN_WORDS, ERROR_EVERY = 3, 16, 8
MAX_BROADCAST_SHINGLES = 1_000_000
#: Most words and errors of a part that every case has (see above).
PART_WORDS, PART_ERRORS = 41, 5
#: Windows of so many shingles must keep so many: a case of 16 words with 2 errors and one of 24 with 3 keep one then, and longer parts hold these windows.
WINDOWS = [(n - SHINGLE + 1, SHINGLE * (n // ERROR_EVERY) + 1) for n in (MIN_WORDS, MIN_WORDS + ERROR_EVERY)]
#: Shingles that the errors leave in every case.
LEAST = min(n - SHINGLE + 1 - SHINGLE * (n // ERROR_EVERY) for n in range(MIN_WORDS, PART_WORDS + 1))

#: Zeros between texts that stand in one array.
_PAD = 64
#: Bits of the first test of a shingle's code.
_SIEVE = 22

_ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtfb])|(.))")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_TAG = re.compile(r"""</?[a-zA-Z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|</?[a-zA-Z][^<>]*>""")
_BROKEN = re.compile(r"[-\u2010\u2011\u00ad](?<=\w.)[ \t]*\r?\n\s*(?:[>|#*]+\s*)*(?=[^\W\d_])")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_APOSTROPHE = re.compile(r"['`](?<=\w.)(?=\w)")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] else m[4]


def _percent(m: re.Match) -> str:
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return m[0]


@lru_cache(1)
def _letters() -> dict[int, str]:
    """The look-alike mapping for single characters, accents and case taken off where they come composed."""
    out: dict[int, str] = {}
    for k, v in ((k, v) for k, v in mapping().items() if len(k) == 1):
        out[ord(k)] = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)).casefold()
    for n in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        if n not in out:
            d = "".join(c for c in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(c))
            out[n] = "".join(out.get(ord(c), c) for c in d).casefold()
    for n in range(0x300, 0x370):
        out[n] = ""
    for n in [*range(0x80, 0xC0), *range(0x2010, 0x2060), *range(0x3000, 0x3004), *range(0x3008, 0x3020)]:
        if not chr(n).isalnum():
            out.setdefault(n, " ")
    out |= dict.fromkeys(map(ord, "’‘ʼ＇´"), "'") | {0x2010: "-", 0x2011: "-", 0xAD: ""}
    out |= {ord("ß"): "ss", ord("ø"): "o", ord("Ø"): "o", ord("ł"): "l", ord("đ"): "d", ord("æ"): "ae", ord("Æ"): "ae", ord("œ"): "oe", ord("Œ"): "oe"}
    return out


@lru_cache(100_000)
def _plain_run(run: str) -> str:
    return run.translate(_letters())


def _plain(m: re.Match) -> str:
    return _plain_run(m[0])


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], " "]
        at = b + 3
    return "".join([*out, text[at:]])


def words(text: str | None) -> list[str]:
    """The words of a text as a reader compares them."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
        if "&" in text and ";" in text:
            text = html.unescape(text)
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "<" in text:
        text = _TAG.sub(" ", _without_comments(text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _FOREIGN.sub(_plain, text)
    text = text.lower()
    if "'" in text or "`" in text:
        text = _APOSTROPHE.sub("", text)
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def shingle_codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit code for each run of ``SHINGLE`` word numbers."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


class Passages:
    """Distinct passages as word numbers, the codes of their shingles and where each stands."""

    def __init__(self, texts: list[str]) -> None:
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        self.ids = [np.array([number.setdefault(w, len(number) + 1) for w in words(t)], np.int32) for t in texts]
        codes = [shingle_codes(i) if len(i) >= MIN_WORDS else np.zeros(0, np.uint64) for i in self.ids]
        each = np.concatenate([*codes, np.zeros(0, np.uint64)])
        self.codes, self.code_of = np.unique(each, return_inverse=True)
        self.size = np.array([len(c) for c in codes], np.int64)
        # all passages in one array, with zeros around each, to gather windows from
        self.flat = np.zeros(sum(len(x) + 2 * _PAD for x in self.ids), np.int32)
        self.flat_at = np.zeros(len(self.ids), np.int64)
        at = 0
        for k, x in enumerate(self.ids):
            self.flat_at[k] = at + _PAD
            self.flat[at + _PAD : at + _PAD + len(x)] = x
            at += len(x) + 2 * _PAD
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[self.codes >> np.uint64(64 - _SIEVE)] = True

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` are shingles of passages, and their numbers."""
        at = np.flatnonzero(self.sieve[codes >> np.uint64(64 - _SIEVE)])
        c = codes[at]
        k = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
        hit = self.codes[k] == c
        return at[hit], k[hit]

    def prefix(self, count: np.ndarray) -> "Prefix":
        """The necessary shingles of each passage, given in how many documents each shingle is: the commonest are left out first."""
        kept = np.zeros(len(self.code_of), bool)
        key = count[self.code_of]
        start = 0
        for m in self.size.tolist():
            own = slice(start, start + m)
            if m >= WINDOWS[0][0]:
                stay = np.ones(m, bool)
                room = [(w, np.full(m - w + 1, w - need)) for w, need in WINDOWS if m >= w]
                for i in np.argsort(-key[own], kind="stable").tolist():
                    spans = [free[max(0, i - w + 1) : i + 1] for w, free in room]
                    if all(x.min() > 0 for x in spans):
                        for x in spans:
                            x -= 1
                        stay[i] = False
                kept[own] = stay
            start += m
        return Prefix(self, kept)


class Prefix:
    """The necessary shingles: for each shingle number, the passages and places where it is kept."""

    def __init__(self, p: Passages, kept: np.ndarray) -> None:
        q = np.repeat(np.arange(len(p.size)), p.size)
        i = np.arange(len(p.code_of)) - np.repeat(np.cumsum(p.size) - p.size, p.size)
        order = np.argsort(p.code_of, kind="stable")
        order = order[kept[order]]
        self.q, self.i = q[order].astype(np.int32), i[order].astype(np.int64)
        self.at = np.searchsorted(p.code_of[order], np.arange(len(p.codes) + 1))
        self.share = float(kept.mean()) if len(kept) else 0.0


def _reach(a: list[int], b: list[int], errors: int) -> list[int]:
    """How many words of ``a`` can be read, ending with a match, against the start of ``b`` with 0..``errors`` errors."""
    na, nb = len(a), len(b)

    def slide(i: int, j: int) -> int:
        while i < na and j < nb and a[i] == b[j]:
            i += 1
            j += 1
        return i

    far = {0: slide(0, 0)}
    out = [far[0]]
    for e in range(1, errors + 1):
        new: dict[int, int] = {}
        best = out[-1]
        for d in range(-e, e + 1):  # d: words of b read minus words of a read
            start = max(far.get(d, -2) + 1, far.get(d + 1, -2) + 1, far.get(d - 1, -2))
            if start < 0 or start > na or not 0 <= start + d <= nb:
                continue
            new[d] = i = slide(start, start + d)
            if best < i <= na and 0 < i + d <= nb and a[i - 1] == b[i + d - 1]:
                best = i
        out.append(best)
        far = new
        if not far:
            break
    return out


def stretch(passage: list[int], doc: list[int], i: int, j: int, most: int) -> int:
    """Words of the longest allowed stretch of ``passage`` through the shared shingle at (``i``, ``j``), with at most ``most`` errors on a side; 0 if none is allowed."""
    right = _reach(passage[i:], doc[j:], most)
    left = _reach(passage[:i][::-1], doc[:j][::-1], most)
    best = 0
    for x, r in enumerate(right):
        for y, l in enumerate(left):
            if (n := r + l) >= max(MIN_WORDS, ERROR_EVERY * (x + y)):
                best = max(best, n)
    return best


def _dense(p: Passages, ids: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which hits have MIN_WORDS passage words in a row near them of which all but three occur in the document, shifted by at most PART_ERRORS.

    A part of up to PART_WORDS words has such a run of words: of two runs beside each other one has at most half of its errors.
    """
    reach = PART_WORDS + 1
    out = np.zeros(len(q), bool)
    steps = np.arange(-reach, reach + SHINGLE)
    for at in range(0, len(q), 20_000):
        cut_ = slice(at, at + 20_000)
        here = p.flat[(p.flat_at[q[cut_]] + i[cut_])[:, None] + steps]
        there = j[cut_][:, None] + steps
        same = np.zeros(here.shape, bool)
        for shift in range(-PART_ERRORS, PART_ERRORS + 1):
            same |= here == ids[np.clip(there + shift, 0, len(ids) - 1)]
        same &= here > 0
        total = np.cumsum(same, axis=1, dtype=np.int16)
        run = total[:, MIN_WORDS:] - total[:, :-MIN_WORDS]
        out[cut_] = run.max(axis=1) >= MIN_WORDS - 3
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))


NUMBERED = "doc_key {kind}, ends array<int>, ids array<int>, code array<int>, held array<int>"


def _number(passages, kind: pa.DataType, longest: int):
    """Mapper: the document ranges that may hold a case, as word numbers; and at its end in how many documents each shingle was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Passages = passages.value
        held = np.zeros(len(p.codes), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                if (got := number(batch.slice(at, 500), p, longest, held)) is not None:
                    yield got
        code = np.flatnonzero(held)
        for at in range(0, len(code), 100_000):
            some, none = code[at : at + 100_000], pa.array([None], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], kind), none, none, _lists(some, np.array([len(some)])), _lists(held[some], np.array([len(some)]))],
                names=["doc_key", "ends", "ids", "code", "held"])

    return run


def number(batch: pa.RecordBatch, p: Passages, longest: int, held: np.ndarray) -> pa.RecordBatch | None:
    """The ranges of one batch of documents, all held in one array; ``held`` is counted up."""
    get, gap = p.vocabulary.get, [0] * _PAD
    numbers: list[int] = list(gap)
    first, last = [], []
    for text in batch.column(1).to_pylist():
        first.append(len(numbers))
        numbers.extend(map(get, words(text), repeat(0)))
        last.append(len(numbers))
        numbers += gap
    ids, start, stop = np.array(numbers, np.int32), np.array(first), np.array(last)
    full = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)) if SHINGLE == 3 else np.flatnonzero(np.convolve(ids > 0, np.ones(SHINGLE, np.int8), "valid") == SHINGLE)
    hit, c = p.lookup(shingle_codes(ids)[full])
    place = full[hit]
    if not len(place):
        return None
    doc = np.searchsorted(start, place, "right") - 1
    held += np.bincount(np.unique(doc * len(p.codes) + c) % len(p.codes), minlength=len(p.codes)).astype(np.int32)
    # length bound: LEAST places within the document words of a part, its errors being added words at most
    span = PART_WORDS + PART_ERRORS
    enough = np.zeros(len(place), bool)
    last_of = LEAST - 1
    if len(place) > last_of:
        close = np.flatnonzero(place[last_of:] - place[: len(place) - last_of] <= span)
        mark = np.zeros(len(place) + 1, np.int32)
        np.add.at(mark, close, 1)
        np.add.at(mark, close + LEAST, -1)
        enough = np.cumsum(mark)[:-1] > 0
    places = place[enough]
    if not len(places):
        return None
    # windows of the size of the item around them, merged where they meet
    of = doc[enough]
    lo, hi = np.maximum(places - longest, start[of]), np.minimum(places + longest, stop[of])
    new = np.concatenate(([True], (lo[1:] > hi[:-1]) | (of[1:] != of[:-1])))
    a, b, of = lo[new], hi[np.concatenate((new[1:], [True]))], of[new]
    size = b - a
    docs, first_of = np.unique(of, return_index=True)
    total = np.cumsum(size)
    base = np.concatenate(([0], total))[first_of]
    ends = total - np.repeat(base, np.diff(np.append(first_of, len(of))))
    rows = pa.array(docs)
    none = pa.nulls(len(docs), pa.list_(pa.int32()))
    kept = np.concatenate([ids[x:y] for x, y in zip(a, b)])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), _lists(ends, np.diff(np.append(first_of, len(of)))), _lists(kept, np.diff(np.append(base, total[-1]))), none, none],
        names=["doc_key", "ends", "ids", "code", "held"])


def _join(passages, prefix):
    """Mapper: the passages that each document range holds, through its prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, index = passages.value, prefix.value
        texts = [x.tolist() for x in p.ids]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keys, found, lengths = [], [], []
                for row, q, n in candidates(batch, p, index, texts):
                    keys.append(row)
                    found.append(q)
                    lengths.append(n)
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(keys)), pa.array(found, pa.int32()), pa.array(lengths, pa.int32())],
                        names=["doc_key", "passage_no", "n_words"])

    return run


def candidates(batch: pa.RecordBatch, p: Passages, index: Prefix, texts: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Row, passage and words of the stretch, for each passage that a document of ``batch`` holds."""
    # the windows of all documents in one array, zeros between them
    ends, ids = batch.column(1), batch.column(2)
    flat, rows, starts, stops = [np.zeros(_PAD, np.int32)], [], [], []
    at = _PAD
    for row in range(batch.num_rows):
        own, low = ids[row].values.to_numpy(zero_copy_only=False), 0
        for high in ends[row].as_py():
            flat += [own[low:high], np.zeros(_PAD, np.int32)]
            rows.append(row)
            starts.append(at)
            stops.append(at + high - low)
            at += high - low + _PAD
            low = high
    doc, row_of, start, stop = np.concatenate(flat), np.array(rows), np.array(starts), np.array(stops)
    hit, c = p.lookup(shingle_codes(doc))
    n = index.at[c + 1] - index.at[c]
    hit, c, n = hit[n > 0], c[n > 0], n[n > 0]
    if not len(hit):
        return
    to = np.cumsum(n)
    where = np.repeat(index.at[c] - (to - n), n) + np.arange(to[-1])
    q, i, j = index.q[where].astype(np.int64), index.i[where], np.repeat(hit, n)
    # hits that overlap or touch on one diagonal are one exact run of words: its first stands for all
    order = np.lexsort((i, j - i, q))
    q, i, j = q[order], i[order], j[order]
    run = np.concatenate(([True], (q[1:] != q[:-1]) | ((j - i)[1:] != (j - i)[:-1]) | (i[1:] - i[:-1] > SHINGLE)))
    q, i, j = q[run], i[run], j[run]
    ok = _dense(p, doc, q, i, j)
    q, i, j = q[ok], i[ok], j[ok]
    window = np.searchsorted(start, j, "right") - 1
    row = row_of[window]
    order = np.lexsort((i, j, q, row)) if len(q) else np.zeros(0, np.int64)
    done, text_of, text = (-1, -1), -1, []
    for r, a, x, y, w in zip(*(v[order].tolist() for v in (row, q, i, j, window))):
        if (r, a) == done:
            continue
        if w != text_of:
            text_of, text = w, doc[start[w] : stop[w]].tolist()
        if stretch(texts[a], text, x, y - int(start[w]), PART_ERRORS):
            done = (r, a)
            yield r, a, stretch(texts[a], text, x, y - int(start[w]), len(texts[a]) // ERROR_EVERY)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [max(0, len(words(t)) - SHINGLE + 1) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["passage", "n"])


def _pack(most: int):
    """Mapper: the passages of a part packed into blocks of at most ``most`` shingles, or one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, part = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            numbers = []
            for n in b.column(1).to_pylist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                numbers.append((part << 32) + block)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64())], names=["passage", "block"])

    return run


def leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str,
          max_shingles: int = MAX_BROADCAST_SHINGLES) -> DataFrame:
    """Documents that hold a passage: ``doc_key, item_key, n_words`` (words of the stretch found)."""
    spark = docs.sparkSession
    kind = docs.schema[doc_key].dataType.simpleString()
    sized = items.select(F.col(passage).alias("passage")).filter("passage IS NOT NULL").distinct().mapInArrow(_sizes, "passage string, n long")
    sized = cut(sized.filter(F.col("n") >= MIN_WORDS - SHINGLE + 1))
    total = sized.agg(F.sum("n")).first()[0] or 0
    packed = cut(sized.repartition(-(-total // max_shingles) or 1).mapInArrow(_pack(max_shingles), "passage string, block long"))
    rows = balanced(docs.select(F.col(doc_key).alias("doc_key"), F.col(text).alias("text")).filter(
        F.length("text") >= 2 * (MIN_WORDS - MIN_WORDS // ERROR_EVERY) - 1))  # so many words need so many characters
    key_type = to_arrow_type(docs.schema[doc_key].dataType)
    out = spark.createDataFrame([], f"doc_key {kind}, passage string, n_words int")
    for (block,) in packed.select("block").distinct().orderBy("block").collect():  # one number for each block
        names = packed.filter(F.col("block") == block).select("passage").orderBy("passage")
        texts = [r.passage for r in names.collect()]  # one block, whose size is bounded
        p = Passages(texts)
        shared = spark.sparkContext.broadcast(p)
        longest = max(map(len, p.ids)) * (ERROR_EVERY + 1) // ERROR_EVERY + 1
        numbered = cut(rows.mapInArrow(_number(shared, key_type, longest), NUMBERED.format(kind=kind)))
        # rarity over the whole corpus: a count for each shingle of the block
        counted = numbered.filter("code IS NOT NULL").select(F.explode(F.arrays_zip("code", "held")).alias("x"))
        counted = counted.groupBy("x.code").agg(F.sum("x.held").alias("n")).toArrow()
        count = np.zeros(len(p.codes), np.int64)
        count[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
        prefix = spark.sparkContext.broadcast(p.prefix(count))
        found = balanced(numbered.filter("ids IS NOT NULL").select("doc_key", "ends", "ids")).mapInArrow(_join(shared, prefix), f"doc_key {kind}, passage_no int, n_words int")
        numbers = spark.createDataFrame(list(enumerate(texts)), "passage_no int, passage string")
        found = cut(found.join(F.broadcast(numbers), "passage_no").select("doc_key", "passage", "n_words"))
        for b in (shared, prefix):
            b.destroy()
        out = out.unionByName(found)
    by = items.select(F.col(item_key).alias("item_key"), F.col(passage).alias("passage"))
    return out.join(by, "passage").select(F.col("doc_key").alias(doc_key), F.col("item_key").alias(item_key), "n_words")
