"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``RankQueue`` keeps one bucket of linked-list positions per merge rank.  Two levels of
words mark the buckets in use, so find-first-set names the next rank in two steps
whatever the text's length; entries that a merge has made stale are skipped when they
surface.  A pre-token of n bytes costs O(n log n) at
worst, which is what very long pre-tokens need.

Every pre-token that isn't itself a vocabulary entry goes through the queue.  What it
gave is remembered, up to ``MEMO_BYTES`` a process, for the next time the pre-token is met.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

#: Bytes remembered a process in each of two generations; the longest pre-token remembered; characters a block.
MEMO_BYTES, MEMO_LONGEST, BLOCK_CHARS = 48_000_000, 512, 500_000
#: What an entry costs besides its bytes.
_ENTRY = 220
#: Bits of a word of the bitmap; the top word has a bit for each of them.
WORD, SHIFT, MASK = 256, 8, 255


class RankQueue:
    """Merges pre-tokens, lowest rank first and leftmost within a rank.

    ``buckets`` holds by rank a position, a heap of positions or None; a bit of ``low``
    marks a bucket in use, a bit of the top word a word of ``low`` that isn't 0.  The
    queue is empty again after each pre-token.
    """

    def __init__(self, ranks: int, pairs: dict[int, int]):
        self.low = [0] * (ranks // WORD + 1)
        self.bit = [1 << i for i in range(max(WORD, len(self.low)))]
        self.buckets: list = [None] * ranks
        self.pairs, self.pushed, self.stale = pairs, 0, 0

    def merge(self, ids: list[int], now: list[int]) -> list[int]:
        """What is left of ``ids`` when no pair has a rank; ``now`` has the rank of each id with the next, or -1."""
        low, buckets, find, bit, top, n = self.low, self.buckets, self.pairs.get, self.bit, 0, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        new = [(rank, i) for i, rank in enumerate(now) if rank >= 0]
        while True:
            self.pushed += len(new)
            for rank, i in new:
                held = buckets[rank]
                if held is None:
                    buckets[rank] = i
                    low[rank >> SHIFT] |= bit[rank & MASK]
                    top |= bit[rank >> SHIFT]
                elif held.__class__ is list:
                    heappush(held, i)
                else:
                    buckets[rank] = [held, i] if held < i else [i, held]
            while top:
                # find-first-set, twice
                high = top & -top
                word = high.bit_length() - 1
                bits = low[word]
                first = bits & -bits
                rank = word << SHIFT | first.bit_length() - 1
                i = buckets[rank]
                if i.__class__ is list:
                    heap = i
                    i = heappop(heap)
                    if not heap:
                        buckets[rank] = None
                else:
                    heap = buckets[rank] = None
                if not heap:
                    low[word] = bits = bits ^ first
                    if not bits:
                        top ^= high
                if now[i] == rank:
                    break
                self.stale += 1
            else:
                break
            j = after[i]
            ids[i], now[j], new = rank, -1, []
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = got = find(rank << 32 | ids[k], -1)
                if got >= 0:
                    new.append((got, i))
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = got = find(ids[h] << 32 | rank, -1)
                if got >= 0:
                    new.append((got, h))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class Memo(dict):
    """Ids by pre-token; misses are made by ``make`` and kept, of which the older half goes when it is full."""

    def __init__(self, make):
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece.encode())
        if len(piece) <= MEMO_LONGEST:
            self.held += _ENTRY + len(piece) + len(ids)
            if self.held > MEMO_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """A vocabulary of byte strings by rank; token ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values(), default=0) + 1
        self.text: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.text[rank] = piece
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.queue = RankQueue(self.size, self.pairs)
        self.byte_pairs = [self.pairs.get(self.byte_ids[i >> 8] << 32 | self.byte_ids[i & 255], -1) for i in range(1 << 16)]
        self.known = Memo(self.ids)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by the rank queue."""
        first, pairs = self.byte_ids, self.byte_pairs
        now = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        now.append(-1)
        return self.queue.merge([first[b] for b in piece], now)

    def ids(self, piece: bytes) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        out = self.merge(piece)
        return struct.pack(f"<{len(out)}I", *out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        get = self.known.__getitem__
        return [b"".join(map(get, self.find(x))) for x in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _encoded(column: pa.Array, encoder: Encoder) -> Iterator[list[bytes]]:
    texts, held = [], 0
    for x in column:
        text = x.as_py() or ""
        texts.append(text)
        held += len(text)
        if held > BLOCK_CHARS:
            yield encoder.encode_many(texts)
            texts, held = [], 0
    yield encoder.encode_many(texts)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "token_ids", digest: str | None = None) -> DataFrame:
    """``docs`` with ``into``: the token ids of ``text_col``, as array<int>; other columns as they are.

    A null or empty text has no ids.  A column already named ``into`` is replaced.
    Matches of ``pattern`` are encoded separately and no special tokens are known.
    With ``digest`` the ids are decoded in the same pass, and a column so named has the
    SHA-256 of the bytes.
    """
    kept = docs.drop(into, *([digest] if digest else []))
    schema = kept.withColumn(into, F.lit(None).cast("array<int>")).schema
    if digest:
        schema = schema.add(digest, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            done = 0
            for ids in _encoded(batch.column(batch.schema.get_field_index(text_col)), encoder):
                flat = np.frombuffer(b"".join(ids), "<i4")
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                piece = batch.slice(done, len(ids))
                shas = [pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())] if digest else []
                yield pa.RecordBatch.from_arrays([*piece.columns, lists, *shas], schema.names)
                done += len(ids)

    return kept.mapInArrow(B.lean(run), schema)


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``coded`` with ``into``: the bytes that ``ids_col`` (array<int>) stands for; null or no ids give no bytes."""
    kept = coded.drop(into)
    schema = kept.withColumn(into, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            out = [b"" if x.as_py() is None else encoder.decode(np.asarray(x.values, "<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    return kept.mapInArrow(B.lean(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id_col, n_tokens, ids_sha256, decoded_sha256, one row per row of ``docs``.

    A null text is empty.  Null and repeated ids are carried along; other columns are not read.
    """
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            n, sha, back = [], [], []
            for block in _encoded(batch.column(1), encoder):
                for ids in block:
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(B.lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
