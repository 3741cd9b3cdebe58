"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a
token as a whole with one probe and one comparison. Tier two: a pre-token that isn't
is merged from its bytes, a linked list of parts with a heap of candidate merges, in
O(n log n) for n bytes. Pre-tokens met before are remembered per worker, up to
``REMEMBER`` bytes; the memory is emptied when full, so it is bounded, whatever the
length of the pre-tokens, and never decides a result.

Edge cases: a null text is empty and gives no ids; repeated rows each give their row;
an empty table gives an empty table; special-token strings are ordinary text. Input
columns other than the id and the text aren't read, so clashing names don't matter.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .registry import register

#: Bytes of pre-tokens and their ids that a worker remembers, with ``OVERHEAD`` for the objects of each.
REMEMBER = 96 << 20
OVERHEAD = 140

_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings to their ranks: hash, displace, compare."""

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = len(ranks)
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        placed: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            placed[xxhash.xxh3_64_intdigest(key) % self.buckets].append(key)
        order = sorted(range(self.buckets), key=lambda b: -len(placed[b]))
        free_from = 0
        for b in order:
            keys = placed[b]
            if len(keys) > 1:
                d = 1
                while True:
                    slots = [self._slot(xxhash.xxh3_64_intdigest(k), d) for k in keys]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            elif keys:  # one key left: point at a free place itself
                while self.keys[free_from] is not None:
                    free_from += 1
                slots = [free_from]
                self.shift[b] = -free_from - 1
            else:
                continue
            for s, k in zip(slots, keys, strict=True):
                self.keys[s], self.values[s] = k, ranks[k]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The rank, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Bpe(dict):
    """Pre-token -> ids as packed 32-bit integers. Holds the pre-tokens met so far, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.whole = PerfectHash(ranks)
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.vocabulary = {r: k for k, r in ranks.items()}
        # every way in which two tokens make a third: (left id, right id) -> its rank
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.find = Pretokens(pattern)
        self.held = 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def __missing__(self, pretoken: str) -> bytes:
        raw = pretoken.encode()
        rank = self.whole.get(raw)
        ids = array("i", (rank,) if rank >= 0 else self.merged(raw)).tobytes()
        size = OVERHEAD + 4 * len(pretoken) + len(ids)
        if size <= REMEMBER >> 4:
            if self.held + size > REMEMBER:
                self.forget()
            self.held += size
            self[pretoken] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost of equals, until none is left."""
        byte, pair = self.byte, self.pairs.get
        ids = [byte[b] for b in raw]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pair(a << 32 | b)) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = right[i]
            if ids[i] < 0 or j >= n or pair(ids[i] << 32 | ids[j]) != r:
                continue  # a part of this pair has been merged meanwhile
            ids[i], ids[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                s = pair(r << 32 | ids[k])
                if s is not None:
                    push(heap, s << 32 | i)
            h = left[i]
            if h >= 0:
                s = pair(ids[h] << 32 | r)
                if s is not None:
                    push(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class Pretokens:
    """All matches of the pattern. For texts of U+0000..U+00FF the classes of the
    usual pattern are spelled out, which the standard library matches several times
    faster; any other pattern or text takes the pattern as it is."""

    USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str):
        # White space is the Unicode property: the four separators U+001C..U+001F aren't part of it.
        space = r"[\t-\r \x85\xa0  -     　]"
        outside = space.replace("[", "[^", 1)
        self.any = regex.compile(
            pattern.replace(r"[^\s", "[^" + space[1:-1]).replace(r"\S", outside).replace(r"\s", space)).findall
        self.latin = None
        if pattern == self.USUAL:
            letter, number, blank = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
            self.latin = re.compile(
                rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+"
                rf"|[{blank}]+(?![^{blank}])|[{blank}]+").findall

    def __call__(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or max(text) <= "\xff"):
            return self.latin(text)
        return self.any(text)


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> Bpe:
    """Once per worker process, which serves many tasks."""
    return Bpe(read_ranks(path), pattern)


def _encoded(path: str, pattern: str, names: list[str], decoded: bool):
    def work(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                offs = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids or [np.empty(0, np.int32)])
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:  # from the ids alone
                    cols.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return work


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every row; ``path``: a rank file that every executor has."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        _encoded(path, pattern, [id_col, "token_ids"], False), f"`{id_col}` {kind}, token_ids array<int>")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded binary): :func:`decode` of :func:`encode` in one pass, with one worker a task."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        _encoded(path, pattern, [id_col, "token_ids", "decoded"], True), f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids, decoded binary): the bytes that the ids stand for. Null ids give no bytes."""

    def work(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [bpe.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())],
                                                 names=[id_col, "token_ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col("token_ids")).mapInArrow(
        work, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and reduce both to digests."""
    return round_trip(df, path, pattern, id_col, text_col).select(
        F.col(id_col),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spread(load(spark, sf_dir, "documents"), "doc_id")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
