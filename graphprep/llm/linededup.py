"""Line dedup over sharded cuckoo filters backed by exact reference tables.

An index has, for every line key that counts, an exact table of references (one row for each key and document), the
reference counts that follow from it, and a cuckoo filter for each shard of the key space that holds the keys found in at
least min_docs documents. A filter answers at once that a key is not repeated; what it lets through is checked against
the counts, so its false positives change nothing. Filters can forget keys: adding documents inserts the keys that reach
min_docs, deleting documents takes out those that fall below it, and a dedup after both is as if the deleted documents had
never been there.

Keys are 128-bit hashes (XXH3) of the line stripped of white space at both ends with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from graphprep.llm.common import fresh, map_batches, materialize, text_bytes

MIN_DOCS, MIN_CHARS = 3, 20
#: Keys of one filter shard, at most on average: what one task holds.
SHARD_KEYS = 250_000
#: References that one task holds against a filter; a shard with more is dealt to several tasks, each with the filter.
TASK_REFS = 2_000_000
#: Keys found in more documents than this are told apart: there are so few of them that they can be sent to every executor.
HOT_DOCS = 1_000_000
_BLANK = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """A set of 64-bit hashes with false positives but no false negatives: 16-bit fingerprints in buckets of four, two buckets each."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: bytes | None = None) -> None:
        if table is not None:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()
        else:
            buckets = 1
            while buckets * self.SLOTS * 0.9 < max(capacity, 1):
                buckets *= 2
            self.table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.mask = len(self.table) - 1

    def _spots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        print_ = (h >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        return (h & np.uint64(self.mask)).astype(np.int64), print_

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask)

    def _place(self, bucket: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put each fingerprint in a free slot of its bucket; give back those that found none."""
        order = np.argsort(bucket, kind="stable")
        bucket, print_ = bucket[order], print_[order]
        at = np.arange(len(bucket))
        fresh = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
        turn = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(at) else at
        free = self.table[bucket] == 0
        pick = free & (np.cumsum(free, axis=1) - 1 == turn[:, None])
        found = pick.any(axis=1)
        self.table[bucket[found], pick[found].argmax(axis=1)] = print_[found]
        return bucket[~found], print_[~found]

    def insert(self, hashes: np.ndarray) -> bool:
        """False if the filter is too full; it must then be built anew, larger, from the exact table."""
        bucket, print_ = self._place(*self._spots(hashes))
        bucket, print_ = self._place(self._other(bucket, print_), print_)
        for turn in range(self.KICKS):
            if not len(bucket):
                return True
            one, first = np.unique(bucket, return_index=True)
            rest = np.setdiff1d(np.arange(len(bucket)), first)
            slot = np.full(len(one), turn % self.SLOTS)
            out = self.table[one, slot].copy()
            self.table[one, slot] = print_[first]
            moved = self._other(one, out)
            bucket, print_ = self._place(np.r_[moved, bucket[rest]], np.r_[out, print_[rest]])
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        bucket, print_ = self._spots(hashes)
        return ((self.table[bucket] == print_[:, None]) | (self.table[self._other(bucket, print_)] == print_[:, None])).any(axis=1)

    def delete(self, hashes: np.ndarray) -> None:
        """Forget hashes that were inserted, once each."""
        for bucket, print_ in zip(*self._spots(hashes), strict=True):
            b, p = np.array([bucket]), np.array([print_])
            for spot in (int(bucket), int(self._other(b, p)[0])):
                hit = np.flatnonzero(self.table[spot] == print_)
                if len(hit):
                    self.table[spot, hit[0]] = 0
                    break

    def tobytes(self) -> bytes:
        return self.table.tobytes()


@dataclass
class LineIndex:
    """refs (key, doc_id); counts (key, n_docs, top_doc) of keys in min_docs documents or more; filters (shard, filter, n_keys)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars)


def line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (key, doc_id), once for each document and key of at least min_chars code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, t in enumerate(text_bytes(b.column(1))):
                own = {k for k in map(line_key, t.split(b"\n")) if _long_enough(k, min_chars)}
                keys.extend(map(_hash, own))
                rows.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], names=["key", "doc_id"])

    return map_batches(docs.where("doc_id is not null").select("doc_id", "text"), run, f"key binary, doc_id {kind}")


def _shard_of(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _words(keys: pa.Array) -> np.ndarray:
    """The first eight bytes of each key as a number: what filters hash by."""
    raw = b"".join(keys.cast(pa.binary()).to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)[:, 0].astype(np.uint64) if raw else np.zeros(0, np.uint64)


def build_filters(counts: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, filter, n_keys) over all keys of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            s, h = b.column(0).to_numpy(zero_copy_only=False), _words(b.column(1))
            for k in np.unique(s):
                held.setdefault(int(k), []).append(h[s == k])
        for k, parts in held.items():
            h, room = np.concatenate(parts), 1
            while not (f := CuckooFilter(len(h) * room)).insert(h):
                room *= 2
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f.tobytes()], pa.binary()), pa.array([len(h)], pa.int64())], names=["shard", "filter", "n_keys"])

    return map_batches(counts.select(_shard_of(shards).alias("shard"), "key").repartition("shard"), run, "shard int, filter binary, n_keys long")


def _counted(refs: DataFrame, min_docs: int) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc")).where(F.col("n_docs") >= min_docs)


def build_index(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
    """The index of all documents. Rows with equal doc_id are one document; rows whose doc_id is null are left out."""
    refs = materialize(line_refs(docs, min_chars), "line-refs")
    counts = materialize(_counted(refs.distinct() if _repeats(docs) else refs, min_docs), "line-counts")
    keys, shards = counts.count(), 1
    while shards * SHARD_KEYS < keys:
        shards *= 2
    return LineIndex(refs, counts, materialize(build_filters(counts, shards), "line-filters"), shards, min_docs, min_chars)


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").take(1))


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with docs added; keys that come to min_docs documents are inserted into their filters."""
    refs = materialize(index.refs.unionByName(line_refs(docs, index.min_chars)).distinct(), "line-refs")
    return _changed(index, refs)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents in doc_ids (doc_id); keys that fall below min_docs are deleted from their filters."""
    refs = materialize(index.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id"), "line-refs")
    return _changed(index, refs)


def _changed(index: LineIndex, refs: DataFrame) -> LineIndex:
    counts = materialize(_counted(refs.distinct(), index.min_docs), "line-counts")
    shard = _shard_of(index.shards).alias("shard")
    new = counts.select("key").join(index.counts.select("key"), "key", "left_anti").select(shard, "key", F.lit(1).alias("change"))
    gone = index.counts.select("key").join(counts.select("key"), "key", "left_anti").select(shard, "key", F.lit(-1).alias("change"))
    kept = index.filters.select("shard", F.col("filter").alias("key"), F.lit(0).alias("change"), "n_keys")
    new, gone = (x.withColumn("n_keys", F.lit(0).cast("long")) for x in (new, gone))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[bytes]]] = {}
        n_keys: dict[int, int] = {}
        for b in batches:
            for s, k, c, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                held.setdefault(s, {}).setdefault(c, []).append(k)
                n_keys[s] = n_keys.get(s, 0) + (c or n)
        for s, by in held.items():
            f = CuckooFilter(table=by[0][0]) if 0 in by else CuckooFilter(len(by.get(1, ())) * 2)
            f.delete(_words(pa.array(by.get(-1, []), pa.binary())))
            fits = f.insert(_words(pa.array(by.get(1, []), pa.binary())))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([f.tobytes() if fits else None], pa.binary()), pa.array([n_keys[s]], pa.int64())], names=["shard", "filter", "n_keys"])

    filters = materialize(map_batches(new.union(gone).union(kept).repartition("shard"), run, "shard int, filter binary, n_keys long"), "line-filters")
    if filters.where("filter is null").take(1):  # a filter overflowed: build all anew from the exact table
        shards = index.shards * 2
        return replace(index, refs=refs, counts=counts, filters=materialize(build_filters(counts, shards), "line-filters"), shards=shards)
    return replace(index, refs=refs, counts=counts, filters=filters)


def repeated_refs(index: LineIndex) -> DataFrame:
    """Rows (key, doc_id) that must go: the key is in min_docs documents or more and this document is not the largest of them.

    References meet the filter of their shard; what it lets through is joined to the exact counts.
    """
    refs, shard = index.refs, _shard_of(index.shards)
    kind = refs.schema["doc_id"].dataType.simpleString()
    # A row for each shard; a shard that a hot key fills is dealt to several tasks.
    parts = materialize(refs.groupBy(shard.alias("shard")).agg((1 + F.floor(F.count(F.lit(1)) / TASK_REFS)).cast("int").alias("parts")), "line-parts")
    none = F.lit(None).cast("binary")
    dealt = refs.select(shard.alias("shard"), "key", "doc_id").join(F.broadcast(parts), "shard")
    dealt = dealt.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), none.alias("filter"), "key", "doc_id")
    sent = index.filters.select("shard", "filter").join(F.broadcast(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter", none.alias("key"), F.lit(None).cast(kind).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: CuckooFilter | None = None
        own: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            where = b.column("shard").to_numpy().astype(np.int64) << 32 | b.column("part").to_numpy()
            starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(where)], strict=True):
                rows = b.slice(lo, hi - lo)
                if own != (spot := int(where[lo])):
                    own, now = spot, None
                if (table := rows.column("filter")[0].as_py()) is not None:
                    now, rows = CuckooFilter(table=table), rows.slice(1)
                if now is not None and rows.num_rows:
                    yield rows.filter(pa.array(now.contains(_words(rows.column("key"))))).select(["key", "doc_id"])

    # In each part the filter stands first.
    met = dealt.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("key").isNotNull())
    passed = map_batches(met, run, f"key binary, doc_id {kind}")
    hot = index.counts.where(F.col("n_docs") > HOT_DOCS).select("key", F.col("top_doc").alias("_hot"))  # references / HOT_DOCS rows at most
    marked = passed.join(F.broadcast(hot), "key", "left")
    rest = marked.where("_hot is null").select("key", "doc_id").join(index.counts.where(F.col("n_docs") <= HOT_DOCS).select("key", "top_doc"), "key").where("doc_id <> top_doc")
    return marked.where("doc_id <> _hot").select("key", "doc_id").union(rest.select("key", "doc_id"))


def drop_lines(docs: DataFrame, index: LineIndex, stats: bool = False) -> DataFrame:
    """docs without the lines that are repeated according to the index; all columns stay, text is replaced.

    A null text stays null if nothing is dropped from it (nothing can be). Lines of a row whose doc_id is null stay.
    stats adds _n_lines and _n_dropped, in the place of columns of these names. Lines are what stands between newline characters; an empty text is one empty line.
    """
    docs = docs.drop("_n_lines", "_n_dropped") if stats else docs
    keys = fresh("_gone_keys", docs)
    gone = repeated_refs(index).groupBy("doc_id").agg(F.collect_set("key").alias(keys))
    joined = docs.join(gone, "doc_id", "left").select(*docs.columns, keys)
    min_chars = index.min_chars
    at = docs.columns.index("text")
    fields = [*docs.schema.fields]
    fields[at] = StructField("text", StringType())
    extra = [StructField("_n_lines", LongType()), StructField("_n_dropped", LongType())] if stats else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(fields)).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    left = [x for x in lines if not (_long_enough(k := line_key(x), min_chars) and _hash(k) in gone)]
                    n_dropped.append(len(lines) - len(left))
                    t = b"\n".join(left)
                else:
                    n_dropped.append(0)
                texts.append(t)
            columns = [*b.columns[: len(fields)]]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if stats:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*fields, *extra]])

    return map_batches(joined, run, StructType([*fields, *extra]))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, stats: bool = False) -> DataFrame:
    """Drop the lines whose key of at least min_chars code points is in min_docs documents or more, except in the largest doc_id."""
    return drop_lines(docs, build_index(docs, min_docs, min_chars), stats)
