"""Byte-level BPE encoding and decoding with a two-tier lookup.

Pre-tokens that are in the vocabulary as a whole are resolved by a minimal perfect hash: one displacement for each bucket of
keys sends all of them to places of their own in a table of exactly as many places as keys, and one comparison tells
members from others. All other pre-tokens are merged from single bytes over a doubly linked list, with a heap of the
adjacent pairs by rank and place.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from graphprep.llm.common import map_batches, text_bytes, worker_cache

#: Units of text kept by one Python worker.
CACHE_UNITS = 700_000
#: Keys of a bucket on average.
_BUCKET = 3
_MASK, _STEP, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_FACTOR)
    return x ^ (x >> np.uint64(32))


def _mix_one(x: int) -> int:
    x = (x ^ (x >> 32)) * _FACTOR & _MASK
    return x ^ (x >> 32)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(n), base64.b64decode(t)) for t, n in (line.split() for line in f if line.strip()))
    if [n for n, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings; place(key) is below len(keys), and another for each key."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // _BUCKET)
        spots = [self._hash(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, (b, _) in enumerate(spots):
            members[b].append(i)
        high = np.array([s[1] for s in spots], np.uint64)
        free = np.ones(n, bool)
        self.shift = array("q", bytes(8 * self.buckets))
        tries = np.arange(256, dtype=np.uint64)[:, None]
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            m = members[b]
            if len(m) < 2:
                singles.extend((b, i) for i in m)
                continue
            base = 0
            while True:
                places = (_mix(high[m][None, :] + (np.uint64(base) + tries) * np.uint64(_STEP)) % np.uint64(n)).astype(np.int64)
                for row in np.flatnonzero(free[places].all(axis=1)):
                    if len(set(places[row].tolist())) == len(m):
                        break
                else:
                    base += 256
                    if base > 1 << 24:
                        raise ValueError("no displacement found; keys must be distinct")
                    continue
                free[places[row]] = False
                self.shift[b] = base + int(row)
                break
        # A bucket of one key takes any place that is left: its displacement is that place, marked by the sign.
        for (b, _), place in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.shift[b] = -place - 1

    def _hash(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & _MASK) % self.buckets, h >> 64

    def place(self, key: bytes) -> int:
        b, high = self._hash(key)
        d = self.shift[b]
        return -d - 1 if d < 0 else _mix_one(high + d * _STEP & _MASK) % self.n


class Vocabulary:
    """Tokens by rank, and a rank by perfect hash."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.hash = PerfectHash(tokens)
        self.at = array("l", bytes(8 * len(tokens)))
        for rank, t in enumerate(tokens):
            self.at[self.hash.place(t)] = rank

    def rank(self, piece: bytes) -> int:
        """-1 for what is no token."""
        r = self.at[self.hash.place(piece)]
        return r if self.tokens[r] == piece else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank, the first of equals, until none is left. ranks: of all tokens."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    ends = list(range(1, n + 2))  # a live part i covers piece[i:ends[i]]; 0 once merged away
    rank, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if not ends[i] or j >= n or ends[j] != end:
            continue  # one of its parts has changed meanwhile
        ends[i], ends[j] = end, 0
        after[i] = end  # parts are contiguous: the next one begins where this one ends
        if end < n:
            before[end] = i
            if (r := rank(piece[i : ends[end]])) is not None:
                push(heap, (r, i, ends[end]))
        p = before[i]
        if p >= 0 and (r := rank(piece[p:end])) is not None:
            push(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class ByteEncoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        self.vocabulary = vocabulary
        self.ranks = {t: i for i, t in enumerate(vocabulary.tokens)}
        # White space in the pattern is the Unicode property, without the separators U+001C to U+001F.
        self.find = regex.compile(pattern).findall
        self.uneven = regex.compile(r"\s\s|^\s|\s\Z|[^\S \n]|[\x1c-\x1f]").search

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        r = self.vocabulary.rank(raw)
        return array("I", (r,) if r >= 0 else merge_bytes(raw, self.ranks)).tobytes()

    def _unit(self, text: str, cache: dict[str, bytes]) -> bytes:
        """A unit of several pieces (a word with its punctuation, say) is put together from pieces that are kept as well."""
        pieces = self.find(text)
        if len(pieces) == 1:
            ids = self._piece(text)
        else:
            parts = []
            for p in pieces:
                part = cache.get(p)
                if part is None:
                    part = cache[p] = self._piece(p)
                parts.append(part)
            ids = b"".join(parts)
        cache[text] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers.

        The pattern always cuts before a single space between other characters, and before and behind a single newline
        there: units that begin at such places are encoded once and kept. Texts with other spaces are cut by the pattern
        as a whole.
        """
        cache = worker_cache("bytebpe", CACHE_UNITS)
        get, unit = cache.get, self._unit
        if self.uneven(text):
            return b"".join([get(u) or unit(u, cache) for u in self.find(text)])
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            ids = [get(u) or unit(u, cache) for u in [" " + x for x in rest]]
            lines.append(b"".join([(get(first) or unit(first, cache)) if first else b"", *ids]))
        return (get("\n") or unit("\n", cache)).join(lines)


def _encoder(tokens: list[bytes], pattern: str, shift: bytes) -> ByteEncoder:
    cache = worker_cache("bytebpe-encoder")
    key = (pattern, len(tokens), xxhash.xxh3_128_digest(b"\0".join(tokens)))
    if cache.get("key") != key:
        worker_cache("bytebpe").clear()
        v = Vocabulary.__new__(Vocabulary)
        v.tokens = tokens
        h = v.hash = PerfectHash.__new__(PerfectHash)
        h.n, h.buckets, h.shift = len(tokens), max(1, len(tokens) // _BUCKET), array("q", shift)
        v.at = array("l", bytes(8 * len(tokens)))
        for rank, t in enumerate(tokens):
            v.at[h.place(t)] = rank
        cache.update(key=key, encoder=ByteEncoder(v, pattern))
    return cache["encoder"]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """Rows (doc_id, ids): the ids of each whole text, as tiktoken's encode_ordinary gives them.

    The vocabulary and the displacements of its perfect hash are sent to the executors; their size is the vocabulary's.
    Null texts count as empty and give no ids. Null and repeated doc_ids are kept; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens).shift.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = _encoder(*sent.value)
        for b in batches:
            raws = text_bytes(b.column(1))
            for lo in range(0, len(raws), 500):
                parts = [encode_one(x.decode("utf-8", "replace")) for x in raws[lo : lo + 500]]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(parts), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(parts)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>", caches="bytebpe")


def decode(encoded: DataFrame, tokens: list[bytes], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids give null; an id outside the vocabulary fails."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    sent = encoded.sparkSession.sparkContext.broadcast(tokens)
    kept = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.__getitem__
        for b in batches:
            column = b.column(ids)
            offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
            if values.size and (values.min() < 0 or values.max() >= len(sent.value)):
                raise ValueError("an id outside the vocabulary")
            made = [b"".join(map(token, values[x:y].tolist())) if ok else None for x, y, ok in zip(offsets, offsets[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, out])

    return map_batches(kept, run, StructType([*kept.schema.fields, StructField(out, BinaryType())]), caches="bytebpe")
