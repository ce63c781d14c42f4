"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a string of `length` bytes that covers it also starts earlier, in a smaller document or at an earlier place of
its own. The starts of equal strings are brought into one bucket, and buckets are refined only where they are still mixed:

1. Every start gets the identifier of its q-gram (q = `gram`). Identifiers of q bytes are pairs of identifiers of fewer bytes
   at the start itself and at a later offset, from 8 bytes on and doubled each time; what was found for a depth is used again
   for the next one. Of the q-grams of a string the one with the least identifier, the leftmost of equal ones, is its anchor.
   Neighbouring strings share anchors, so that a run of strings with one anchor is one row. The initial buckets are those of
   the anchors' q-grams; a bucket of one anchor holds nothing that repeats and falls out here.
2. Buckets are refined by the whole run: runs of equal bytes are one class, and all but its first run are repeated from end to
   end. Only the first run of each class goes on, and only in buckets that are still mixed.
3. These runs are cut where the anchor stands at the same places of the strings, into blocks of BLOCK starts. All strings of a
   block share a core of over `length` - BLOCK bytes. Buckets are refined by the core; blocks alone with theirs fall out.
4. What is left is refined to the full length, a start at a time.

Buckets of step 1 are named by 64-bit numbers, which can only let too much through; the classes of steps 2 to 4 are named by
128 bits of BLAKE2b over the bytes themselves. Groups are counted before they are joined, by partial aggregates, so that a
string found in a third of all documents is no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphprep.llm.common import drop, map_batches, materialize, text_bytes

LENGTH, GRAM, BLOCK = 100, 40, 16
#: Bytes that one step of numpy takes; a longer text is cut into segments of SEGMENT starts.
AT_ONCE, SEGMENT = 1 << 19, 1 << 22
#: Bits of the filter of repeated q-grams: 16 for each, 32 MB at most. A full filter lets all through to step 2.
FILTER_BITS, FILTER_PARTS = 1 << 28, 16
#: Marks and runs by document are sent to all executors up to this number; beyond it texts are shuffled to them.
SENT_ROWS, SENT_RUNS = 1_000_000, 4_000_000

_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of what a stands for, followed by what b stands for."""
    z = b >> _U(31)
    z ^= b
    z *= _ODD[1]
    z += a * _ODD[0]
    z ^= z >> _U(29)
    z *= _ODD[2]
    z ^= z >> _U(32)
    return z


def identifiers(raw: np.ndarray, gram: int) -> np.ndarray:
    """Identifier of the `gram` bytes (8 or more) from each start of uint8 raw on; len(raw) - gram + 1 of them."""
    if len(raw) < gram:
        return np.zeros(0, np.uint64)
    x = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,)).copy()
    depth = 8
    while depth < gram:
        step = min(depth, gram - depth)
        x = _pair(x[:-step], x[step:])
        depth += step
    return _pair(x, x) if gram == 8 else x


def _anchors(ids: np.ndarray, wide: int) -> np.ndarray:
    """For each start the place of the least of the next `wide` identifiers, by their upper halves, the leftmost of equal ones."""
    key = (ids & _U(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=np.uint64)
    depth = 1
    while depth < wide:
        step = min(depth, wide - depth)
        key = np.minimum(key[:-step], key[step:])
        depth += step
    return (key & _U(0xFFFFFFFF)).astype(np.int64)


def _steps(raws: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of text one after another: the bytes, and for each piece its text, where in it it begins, and its end in the bytes."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def out() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return b"".join(h[0] for h in held), np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.cumsum([len(h[0]) for h in held])

    for i, raw in enumerate(raws):
        for at in range(0, len(raw) - length + 1, SEGMENT):
            part = raw if len(raw) < SEGMENT else raw[at : at + SEGMENT + length - 1]
            held.append((part, i, at))
            size += len(part)
            if size >= AT_ONCE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def runs_of(raws: list[bytes], length: int, gram: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings with one anchor: the bytes, and for each run its place there, text, first start, number of starts, the
    anchor's distance from the first start, and the identifier of its q-gram."""
    for joined, texts, begins, ends in _steps(raws, length):
        ids = identifiers(np.frombuffer(joined, np.uint8), gram)
        anchor = _anchors(ids, length - gram + 1)
        piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
        places = np.flatnonzero(np.arange(len(anchor)) + length <= ends[piece])
        a, p = anchor[places], piece[places]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1])][: len(a)])
        n = np.diff(np.append(first, len(a)))
        lo, a, p = places[first], a[first], p[first]
        yield joined, lo, texts[p], lo - np.r_[0, ends][p] + begins[p], n, a - lo, ids[a]


def _digest(raw: bytes, salt: int = 0) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=salt.to_bytes(2, "little")).digest()


def _spots(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = _U(64 - bits.bit_length() + 1)
    return (grams * _ODD[0]) >> shift, ((grams ^ (grams >> _U(32))) * _ODD[1]) >> shift


def _repeated_grams(docs: DataFrame, length: int, gram: int) -> tuple[list[bytes], int]:
    """A filter of the anchors' q-grams that two anchors have, in parts: bit arrays of which the q-gram's remainder names one."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, ids in runs_of(text_bytes(b.column(0)), length, gram):
                one, n = np.unique(ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    found = map_batches(docs.select("text"), grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    found = materialize(found, "repeats-grams")
    bits = 1 << 10
    while bits < FILTER_BITS // FILTER_PARTS and bits * FILTER_PARTS < 16 * found.count():
        bits *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = (ids % _U(FILTER_PARTS)).astype(np.int64)
            for k in np.unique(part).tolist():
                table = tables.setdefault(k, np.zeros(bits, bool))
                for spot in _spots(ids[part == k], bits):
                    table[spot] = True
        for k, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()])], names=["part", "bits"])

    parts = [bytes(bits // 8)] * FILTER_PARTS
    dealt = found.repartition(FILTER_PARTS, F.pmod("gram", F.lit(FILTER_PARTS)))
    for r in map_batches(dealt, build, "part int, bits binary").toLocalIterator():  # FILTER_BITS at most, and a part from few tasks
        parts[r[0]] = (np.frombuffer(parts[r[0]], np.uint8) | np.frombuffer(r[1], np.uint8)).tobytes()
    return parts, bits


def _names(digests: list[bytes]) -> list[pa.Array]:
    """Digests as two numbers each, c1 and c2."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _candidate_runs(docs: DataFrame, key: str, parts: list[bytes], bits: int, length: int, gram: int) -> DataFrame:
    """Runs whose anchor's q-gram the filter knows: (c1, c2, gram, key, run), run = start * 65536 + to anchor * 256 + starts."""
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(p, np.uint8) for p in sent.value]
        for b in batches:
            for joined, at, text, start, n, lead, ids in runs_of(text_bytes(b.column(1)), length, gram):
                known = np.zeros(len(ids), bool)
                part = ids % _U(FILTER_PARTS)
                for k, table in enumerate(tables):
                    mine = np.flatnonzero(part == k)
                    one, two = (table[s >> _U(3)] >> (s & _U(7)).astype(np.uint8) & 1 for s in _spots(ids[mine], bits))
                    known[mine[(one & two).astype(bool)]] = True
                k = np.flatnonzero(known)
                view = memoryview(joined)
                classes = [_digest(view[a : a + m + length - 1]) for a, m in zip(at[k].tolist(), n[k].tolist(), strict=True)]
                # Half of the q-gram's number will do to tell mixed buckets.
                arrays = [*_names(classes), pa.array((ids[k] >> _U(32)).astype(np.uint32).view(np.int32)), b.column(0).take(pa.array(text[k])), pa.array(start[k] * 65536 + lead[k] * 256 + n[k])]
                yield pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "gram", "key", "run"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, "text"), run, f"c1 long, c2 long, gram int, key {kind}, run long")


def _by_key(runs: DataFrame, packed: str) -> DataFrame:
    """One row a document: its runs as numbers. A document has no more of them than bytes."""
    return runs.groupBy("key").agg(F.collect_list(packed).alias("runs"))


def _with_runs(docs: DataFrame, key: str, runs: DataFrame, column: str, how: str) -> DataFrame:
    """docs with the runs of their key. Few runs are sent to the texts, many meet them in a join."""
    rows, numbers = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    side = runs.select(F.col("key").alias("_repeats_key"), F.col("runs").alias(column))
    side = F.broadcast(side) if rows <= SENT_ROWS and numbers <= SENT_RUNS else side
    return docs.join(side, docs[key].eqNullSafe(side["_repeats_key"]), how).drop("_repeats_key")


def _of_texts(docs: DataFrame, key: str, runs: DataFrame, each: Callable[[bytes, list[int]], tuple[list[bytes], list[int]]]) -> DataFrame:
    """Rows (c1, c2, key, run): what `each` makes of every text and its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = text_bytes(b.column(1))
            for i, numbers in enumerate(b.column(2).to_pylist()):
                names, made = each(raws[i], numbers)
                yield pa.RecordBatch.from_arrays([*_names(names), b.column(0).take(pa.array([i] * len(made), pa.int64())), pa.array(made, pa.int64())], names=["c1", "c2", "key", "run"])

    kind = docs.schema[key].dataType.simpleString()
    texts = _with_runs(docs.select(key, "text"), key, runs, "runs", "inner")
    return map_batches(texts.select(key, "text", "runs"), run, f"c1 long, c2 long, key {kind}, run long")


def _blocks(length: int) -> Callable[[bytes, list[int]], tuple[list[bytes], list[int]]]:
    """Cuts runs into blocks, named by their core: start * 256 + starts."""

    def each(raw: bytes, runs: list[int]) -> tuple[list[bytes], list[int]]:
        cores, made = [], []
        for number in runs:
            p, anchor = number >> 16, (number >> 16) + (number >> 8 & 255)
            end = p + (number & 255)
            # The string that starts at p has its anchor at anchor - p; blocks are cut by that number.
            while p < end:
                block = (anchor - p) // BLOCK
                last = min(end - 1, anchor - block * BLOCK)
                cores.append(_digest(raw[anchor - block * BLOCK : anchor - (block + 1) * BLOCK + 1 + length], block + 1))
                made.append(p * 256 + last - p + 1)
                p = last + 1
        return cores, made

    return each


def _strings(length: int) -> Callable[[bytes, list[int]], tuple[list[bytes], list[int]]]:
    """All strings of blocks."""

    def each(raw: bytes, blocks: list[int]) -> tuple[list[bytes], list[int]]:
        starts = [p for x in blocks for p in range(x >> 8, (x >> 8) + (x & 255))]
        return [_digest(raw[p : p + length]) for p in starts], [p * 256 + 1 for p in starts]

    return each


def _firsts(rows: DataFrame, *more: Column) -> DataFrame:
    """Of each class the first (key, run) and the number of rows."""
    return rows.groupBy("c1", "c2").agg(F.min(F.struct("key", "run")).alias("head"), F.count(F.lit(1)).alias("size"), *more)


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, run) of the rows of classes of several that are not the first."""
    several = firsts.where("size > 1").select("c1", "c2", "head")
    return rows.select("c1", "c2", "key", "run").join(several, ["c1", "c2"]).where(~F.struct("key", "run").eqNullSafe(F.col("head"))).select("key", "run")


def _merged(marks: DataFrame, length: int) -> DataFrame:
    """(key, runs) of documents with repeats: the removed runs as first byte and end, one after the other."""
    kind = marks.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for numbers in b.column(1):
                x = np.sort(numbers.values.to_numpy())
                start, end = x >> 8, np.maximum.accumulate((x >> 8) + (x & 255) - 1 + length)
                new = np.r_[True, start[1:] > end[:-1]]
                out.append(np.stack([start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]]], 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["key", "runs"])

    return map_batches(_by_key(marks, "run"), run, f"key {kind}, runs array<bigint>")


def _irregular(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").take(1))


def repeated_runs(docs: DataFrame, key: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (key, runs) of documents with strings that start earlier: first byte and end of each run of bytes that they cover."""
    spark = docs.sparkSession
    parts, bits = _repeated_grams(docs, length, gram)
    found = materialize(_candidate_runs(docs, key, parts, bits, length, gram), "repeats-runs")
    classes = materialize(_firsts(found, F.min("gram").alias("gram")), "repeats-classes")
    whole = materialize(_later(found, classes).select("key", (F.shiftright("run", 16) * 256 + F.col("run") % 256).alias("run")), "repeats-whole")
    mixed = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("gram")
    heads = materialize(_by_key(classes.join(mixed, "gram").select("head.key", "head.run"), "run"), "repeats-heads")
    drop(spark, found, classes)
    blocks = materialize(_of_texts(docs, key, heads, _blocks(length)), "repeats-blocks")
    shared = blocks.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2")
    left = materialize(_by_key(blocks.join(shared, ["c1", "c2"]), "run"), "repeats-left")
    drop(spark, heads, blocks)
    strings = materialize(_of_texts(docs, key, left, _strings(length)), "repeats-strings")
    marks = materialize(_merged(whole.unionByName(_later(strings, _firsts(strings))), length), "repeats-marks")
    drop(spark, whole, left, strings)
    return marks


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: str = "kept", stats: tuple[str, str, str] = ("n_bytes", "n_removed", "n_spans")) -> DataFrame:
    """Add to docs (doc_id, text, ...) what is left of each text as bytes, its bytes, those removed, and the maximal removed runs.

    All strings are judged on the input. Null texts count as empty; texts below `length` bytes keep all. Documents are ordered by
    doc_id. Where doc_ids repeat or are null, null comes first and texts of one doc_id follow the order of their SHA-256; rows
    that are equal in both are one document, and all get its result. Columns of the given names are replaced, others stay, and
    columns whose names start with _repeats are the operator's own and are left out. An empty table gives an empty result.
    """
    if not 8 <= gram <= length <= 250:
        raise ValueError("8 <= gram <= length <= 250")
    names = (kept, *stats)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names and not c.lower().startswith("_repeats")])
    own = docs.columns
    if _irregular(docs):
        keyed = docs.withColumn("_repeats_id", F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")))
        key, texts = "_repeats_id", keyed.select("_repeats_id", "text").dropDuplicates(["_repeats_id"])
    else:
        key, keyed, texts = "doc_id", docs, docs.select("doc_id", "text")
    marked = _with_runs(keyed, key, repeated_runs(texts, key, length, gram), "_repeats_runs", "left").select(*own, "_repeats_runs")
    text = own.index(next(c for c in own if c.lower() == "text"))
    schema = StructType([docs.schema[c] for c in own]).add(kept, "binary")
    for s in stats:
        schema = schema.add(s, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, sizes, gone, spans = [], [], [], []
            for raw, numbers in zip(text_bytes(b.column(text)), b.column(len(own)), strict=True):
                sizes.append(len(raw))
                if not numbers.is_valid:
                    left.append(raw)
                    gone.append(0)
                    spans.append(0)
                    continue
                a, e = numbers.values.to_numpy().reshape(-1, 2).T
                left.append(b"".join(raw[i:j] for i, j in zip([0, *e.tolist()], [*a.tolist(), len(raw)], strict=True)))
                gone.append(int((e - a).sum()))
                spans.append(len(a))
            arrays = [b.column(i) for i in range(len(own))] + [pa.array(left, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, kept, *stats])

    return map_batches(marked, run, schema)
