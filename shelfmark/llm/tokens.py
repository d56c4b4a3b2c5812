"""Encoding of a corpus with a public byte-level BPE tokenizer.

Two tiers. A pre-token whose bytes are a whole vocabulary entry is resolved by
a minimal perfect hash over the vocabulary (hash-and-displace, held in numpy
arrays, exact since the stored bytes are compared). The others are merged by a
heap of adjacent pairs over linked bytes, lowest rank first and leftmost among
equals. Each Arrow batch resolves its distinct pre-tokens once; a bounded memo
keeps the merged ones of earlier batches.

The tables (about 1 MB, as large as the vocabulary and no larger) are built on
the driver from the vocabulary file, whose path is a parameter, and sent to
the executors by broadcast.

Defined results: null and empty texts give an empty list; strings that look
like special tokens are ordinary text; a text is encoded whole, whatever its
length. Repeated rows are each encoded. Columns besides the named ones are not
read. A lone surrogate, which valid UTF-8 can't hold, is not expected.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.packed import WHITE_SPACE

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern of the vocabulary, with white space spelled out (fixed values).
_S = f"[{WHITE_SPACE}]"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+|{_S}+(?![^{WHITE_SPACE}])|{_S}+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-z0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"
_MEMO = 300_000


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace: a bucket's displacement sends its keys to free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.m = m = max(1, n // 2)
        h = self.hashes(keys)
        if len(np.unique(h)) < n:
            raise ValueError("two keys share a hash")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(m + 1))
        sizes = np.diff(starts)
        self.d = np.zeros(m, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for k in np.argsort(-sizes, kind="stable").tolist():
            if sizes[k] < 2:
                break
            own = order[starts[k] : starts[k + 1]]
            d = 0
            while taken[slots := self._slot(h[own], d)].any() or len(set(slots.tolist())) < len(own):
                d += 1
            self.d[k] = d
            taken[slots] = True
            self.key_at[slots] = own
        # a bucket of one key names a free slot itself, as a negative displacement
        ones = order[starts[:-1][sizes == 1]]
        slots = np.flatnonzero(~taken)
        self.d[bucket[ones]] = -1 - slots
        self.key_at[slots] = ones
        self.keys = np.empty(n, dtype=object)
        self.keys[:] = keys

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        f = xxhash.xxh3_64_intdigest
        return np.fromiter((f(k) for k in keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.m)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key in the list given at first, or -1 for a string that isn't a key."""
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self.hashes(keys)
        d = self.d[self._bucket(h)]
        at = self.key_at[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))]
        asked = np.empty(len(keys), dtype=object)
        asked[:] = keys
        return np.where(self.keys[at] == asked, at, -1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Byte-level BPE with the two tiers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = list(ranks)
        self.ids = np.fromiter((ranks[k] for k in keys), np.int64, len(keys))
        self.table = PerfectHash(keys)
        self.ranks = ranks
        self.memo: dict[bytes, np.ndarray] = {}
        self.setup()

    def setup(self) -> None:
        self.pattern = regex.compile(PATTERN)
        self.ascii = re.compile(ASCII_PATTERN)

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "table": self.table, "ranks": self.ranks, "memo": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.setup()

    def pre_tokens(self, text: str) -> list[str]:
        return self.ascii.findall(text) if text.isascii() else self.pattern.findall(text)

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging the lowest-ranked adjacent pair until none is left."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 for a swallowed start
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # a part of the pair has been merged since
            end[i] = stop
            end[mid] = 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each distinct pre-token."""
        at = self.table.find(words)
        known = self.ids[at].astype(np.int32)
        out: list[np.ndarray] = [known[k : k + 1] for k in range(len(words))]
        for k in np.flatnonzero(at < 0).tolist():
            w = words[k]
            got = self.memo.get(w)
            if got is None:
                got = np.array(self.merge(w), np.int32)
                if len(self.memo) < _MEMO and len(w) < 200:
                    self.memo[w] = got
            out[k] = got
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the offsets of the texts in them, the number of ids of each pre-token, and its offsets by text."""
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words += self.pre_tokens(t)
            ends.append(len(words))
        word_at = np.array(ends, np.int64)
        if not words:
            z = np.zeros(0, np.int32)
            return z, np.zeros(len(ends), np.int64), z, word_at
        distinct = list(dict.fromkeys(words))
        number = {w: k for k, w in enumerate(distinct)}
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        each = self.resolve([w.encode() for w in distinct])
        size = np.fromiter(map(len, each), np.int64, len(each))
        first = np.concatenate(([0], np.cumsum(size)))
        flat = np.concatenate(each)
        per = size[codes]
        stop = np.cumsum(per)
        # each pre-token's ids are a run in flat
        where = np.repeat(first[codes] - (stop - per), per) + np.arange(stop[-1])
        return flat[where], np.concatenate(([0], stop))[word_at], per, word_at


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def shared_encoder(spark: SparkSession, path: str = TOKENIZER) -> Broadcast:
    """The encoder of a vocabulary file, on every executor. Its size is that of the vocabulary, never of the data."""
    return spark.sparkContext.broadcast(encoder(path))


def balanced(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores, where the input has fewer files or row groups."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def encode(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row."""
    shared = shared_encoder(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, offsets, _, _ = enc.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return balanced(df.select(key, F.col(text).alias("text"))).mapInArrow(run, f"{key} {kind}, ids array<int>")
