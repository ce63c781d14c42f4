"""SimHash fingerprints and their links, found by Golay-code fuzzy hashing.

A fingerprint is cut into segments of at most 23 bits. The binary Golay code (23, 12) is perfect: every segment has one
codeword within distance 3. A segment's keys are the indices of its near codewords: the nearest one, and for segments at
distance 3 also the five at distance 4. Two segments that differ in at most two bits always share a key (if both are at
distance 3, the codeword nearest to a word between them is within 4 of both; the other cases follow from the code's least
distance 7).

With links at two differing bits or fewer and three segments, one segment is equal in both and the segment after it
(cyclically, for the right choice of the equal one) differs in one bit at most. So each fingerprint gets, for each segment,
keys of that segment's bits and one codeword index of the next. Fingerprints that share a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import components, map_batches, materialize, text_bytes, words_of

BITS = 64
#: First bit and number of bits of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
LINK_BITS = 2
#: Rows of a key up to which all pairs are compared. Fuller keys go by neighbours, see links().
PAIRED = 256

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
_GENERATOR = 0b110001110101
_LENGTH, _CHECK = 23, 11


def _remainder(v: int) -> int:
    for i in range(_LENGTH - 1, _CHECK - 1, -1):
        if v >> i & 1:
            v ^= _GENERATOR << (i - _CHECK)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 bits and of the high 11 bits, and for each remainder the errors of its near codewords (-1: none)."""
    unit = [_remainder(1 << i) for i in range(_LENGTH)]

    def spread(first: int, n: int) -> np.ndarray:
        out = np.zeros(1 << n, np.int32)
        for i in range(n):
            out[1 << i : 2 << i] = out[: 1 << i] ^ unit[first + i]
        return out

    errors = np.full((1 << _CHECK, 6), -1, np.int64)
    used = np.zeros(1 << _CHECK, np.int32)
    for weight in range(5):
        for spots in combinations(range(_LENGTH), weight):
            r = 0
            for i in spots:
                r ^= unit[i]
            if weight < 4 or bin(int(errors[r, 0])).count("1") == 3:
                errors[r, used[r]] = sum(1 << i for i in spots)
                used[r] += 1
    return spread(0, 12), spread(12, 11), errors


_LOW, _HIGH, _ERRORS = _tables()


def golay_keys(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the near codewords of 23-bit segments: an n x 6 array, and which of its entries count."""
    v = segments.astype(np.int64)
    errors = _ERRORS[_LOW[v & 4095] ^ _HIGH[v >> 12]]
    return (v[:, None] ^ np.maximum(errors, 0)) >> _CHECK, errors >= 0


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words joined by spaces; of all words where there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it. No hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    columns = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the 64-bit fingerprint of each text as a signed long. Null texts count as empty: fingerprint 0.

    Whole texts are read. Rows with null ids are kept, repeated rows stay repeated, other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([majority_bits(shingle_hashes(words_of(t), shingle)) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, fp long")


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """Rows (key, fp): the keys of each fingerprint in prints (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i, exact in enumerate(parts):
                near, real = golay_keys(parts[(i + 1) % len(parts)])
                keys = (i << 60) | (exact[:, None] << 12) | near
                rows = np.broadcast_to(fp.view(np.int64)[:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[real]), pa.array(rows[real])], names=["key", "fp"])

    return map_batches(prints.select("fp"), run, "key long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of prints (fp) that connect all those at LINK_BITS differing bits or fewer.

    Keys with up to PAIRED fingerprints: every pair is verified. Fingerprints of fuller keys are instead joined to all 65
    words within one bit of them: two fingerprints within two bits have such a word in common, and any two that share one
    are within two bits. Each word links its fingerprints to the least of them, so rows grow as the fingerprints do, not
    as their pairs, and the components are the same.
    """
    keys = materialize(fuzzy_keys(prints), "simhash-keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    some = counts.where(F.col("n") <= PAIRED).select("key")
    shared = keys.join(some, "key")
    a, b = shared.select("key", F.col("fp").alias("a")), shared.select("key", F.col("fp").alias("b"))
    near = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS)).select("a", "b")
    full = keys.join(counts.where(F.col("n") > PAIRED).select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (1 << i for i in range(BITS))])
    around = full.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("w"))
    heads = around.groupBy("w").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = around.join(heads, "w").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return near.union(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id): documents whose fingerprints are chained by links share the smallest doc_id.

    Equal fingerprints are one node, so a group of copies costs one. Null texts count as empty; empty texts share
    fingerprint 0. Rows with a null doc_id take part and get a component as well (null only if no id is in it). Rows with
    equal doc_ids each get a row. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"))).select(F.col("id").alias("fp"), "component")
    # A component is named by its least fingerprint so far; from here on by its least doc_id.
    owner = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = owner.groupBy("component").agg(F.min("first").alias("component_id"))
    named = owner.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
