"""Near-duplicate texts: Golay-keyed SimHash links most copies, an exact prefix filter finds the links it cannot reach.

Two texts are near copies if the Jaccard index of their sets of word shingles is at least t (hashes of 64 bits stand for
shingles). A fingerprint of 64 bits strays by some ten bits between texts at the threshold, so links at two bits, as
simhash.links() finds them, cannot give all pairs. So the search has four steps, each on what the one before left apart:

1. Each shingle is counted: in how many texts it stands. A text with more than (1 - t) of its shingles found nowhere else
   has no near copy. Only the others, the candidates, go on; they keep the shingles they share with some text.
2. Fingerprints of the candidates are linked by simhash.links(), and linked texts are compared.
3. At the same time and in STARS - 1 more rounds, stars are compared. Shingles stand in one order, rare ones first. Two near copies of n shingles each share one of the first
   n - ceil(t * n) + 1 (a text's prefix). In each round every candidate is compared with one other text of its
   keys that lies in another component: at first the one with the fewest shingles of its own, which is the likeliest to be
   what the others were copied from, then one drawn by hash. So a group of copies costs as many comparisons as it has
   members.
4. What is still in different components and shares a key is compared unless bounds rule it out: the place of the key in
   both prefixes (which says how many shingles they can share at most), the shingles each has alone, and the bits in which
   the parities of the shared ones differ, each of which stands for one shingle that only one of the two has.

No step loses a link between components, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import components, fresh, map_batches, materialize, text_bytes, words_of
from graphprep.llm.simhash import links, majority_bits, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Texts sampled to tell very common shingles, which are not counted one by one; found in this many of them.
SAMPLED, COMMON, MOST_COMMON = 8_000, 5, 1 << 18
#: Shingles that one task counts, shingles of one bucket, and shingles sent at once.
TASK_SHINGLES, BUCKETS_A_TASK, SENT = 2_000_000, 8, 400_000
STARS = 2
PARITIES = 512
#: Rounding must not lose a pair at the very threshold.
SLACK = 1e-9
#: Very common shingles stand behind all others.
_LAST = 1 << 40


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, digest, node, n, fp): hashes of the words, 128 bits and 64, number of distinct shingles, fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            digests, nodes, sizes, prints = [], [], [], []
            for t in text_bytes(x.column(1)):
                words = words_of(t)
                joined = b" ".join(words)
                digests.append(xxhash.xxh3_128_digest(joined))
                nodes.append(xxhash.xxh64_intdigest(joined))
                hashes = shingle_hashes(words, shingle)
                sizes.append(len(np.unique(hashes)))
                prints.append(majority_bits(hashes))
            both = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(digests, pa.binary()), both[0], pa.array(sizes, pa.int64()), both[1]], names=["doc_id", "digest", "node", "n", "fp"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, digest binary, node long, n long, fp long")


def _common(texts: DataFrame, share: float, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles found in COMMON texts or more of a sample, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = [np.unique(shingle_hashes(words_of(t), shingle)) for t in text_bytes(x.column(0))]
            if own:
                found, n = np.unique(np.concatenate(own).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["h", "n"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counts = map_batches(sample, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    found, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _spread(texts: DataFrame, common: object, buckets: int, shingle: int) -> DataFrame:
    """Rows (bucket, hs, nodes): distinct shingles and the texts they stand in, as packed longs.

    Very common shingles go to negative buckets, any of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = common.value

        def packed(hashes: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
            h = np.concatenate(hashes)
            node = np.repeat(np.array(nodes, np.uint64), [len(x) for x in hashes])
            bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            if len(known):
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                bucket[known[at] == signed] = -1 - nodes[0] % buckets
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = pa.py_buffer((np.r_[first, len(bucket)] * 8).astype(np.int32))
            both = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(v[order])]) for v in (h, node)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *both], names=["bucket", "hs", "nodes"])

        hashes, nodes, held = [], [], 0
        for x in batches:
            for t in text_bytes(x.column(0)):
                words = words_of(t)
                own = np.unique(shingle_hashes(words, shingle))
                if len(own):
                    hashes.append(own)
                    nodes.append(xxhash.xxh64_intdigest(b" ".join(words)))
                    held += len(own)
                if held >= SENT:
                    yield packed(hashes, nodes)
                    hashes, nodes, held = [], [], 0
        if hashes:
            yield packed(hashes, nodes)

    return map_batches(texts.select("text"), run, "bucket int, hs binary, nodes binary")


def _shared(spread: DataFrame, common: object, tasks: int) -> DataFrame:
    """Rows (node, h, df): the shingles found in two texts or more, and in how many (common ones: behind all others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value

        def counted(bucket: int, hs: list[bytes], nodes: list[bytes]) -> pa.RecordBatch:
            h, node = np.frombuffer(b"".join(hs), np.int64), np.frombuffer(b"".join(nodes), np.int64)
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
            h, node = h[once], node[once]
            if bucket < 0:
                df = often[np.searchsorted(known, h)].astype(np.int64) + _LAST
            else:
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                n = np.diff(np.r_[first, len(h)])
                df = np.repeat(n, n)
                h, node, df = h[df > 1], node[df > 1], df[df > 1]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(h), pa.array(df)], names=["node", "h", "df"])

        now, hs, nodes = None, [], []
        for x in batches:
            for bucket, h, node in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                if bucket != now and hs:
                    yield counted(now, hs, nodes)
                    hs, nodes = [], []
                now = bucket
                hs.append(h)
                nodes.append(node)
        if hs:
            yield counted(now, hs, nodes)

    return map_batches(spread.repartition(tasks, "bucket").sortWithinPartitions("bucket"), run, "node long, h long, df long")


def _candidates(shared: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Rows (node, n, alone, fp, hs, keys, bits) of the texts that can have a near copy.

    alone: how many of the n shingles no other text has; hs: the others, rare ones first; keys: those of the prefix, the
    first of them at place `alone`; bits: for each of PARITIES hash values, whether an odd number of hs has it.
    """
    need = F.ceil(similarity * F.col("n") - SLACK)
    own = shared.groupBy("node").agg(F.collect_list(F.struct("df", "h")).alias("own"))
    own = own.join(nodes.where("n > 0"), "node").where(F.size("own") >= need).select("node", "n", "fp", need.cast("long").alias("need"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            alone, hs, keys, bits = [], [], [], []
            for n, need, own in zip(x.column(1).to_pylist(), x.column(3).to_pylist(), x.column(4), strict=True):
                df, h = (own.values.field(k).to_numpy() for k in (0, 1))
                h = h[np.lexsort((h, df))]
                alone.append(n - len(h))
                hs.append(h)
                keys.append(h[: len(h) - need + 1])
                odd = np.bincount((h.view(np.uint64) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                bits.append(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), pa.array(alone, pa.int64()), x.column(2), pa.array(hs, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["node", "n", "alone", "fp", "hs", "keys", "bits"],
            )

    return map_batches(own, run, "node long, n long, alone long, fp long, hs array<long>, keys array<long>, bits array<long>")


def _verified(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) whose texts are that similar, as edges (a, b). Shingles that a text has alone are in no intersection."""
    one = found.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("hs").alias("hx"))
    two = found.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("hs").alias("hy"))
    both = pairs.select("x", "y").join(one, "x").join(two, "y")
    near = F.size(F.array_intersect("hx", "hy")) * (1 + similarity) >= (F.col("nx") + F.col("ny")) * similarity - SLACK
    return both.where(near).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _by_prints(found: DataFrame) -> DataFrame:
    """Pairs (x, y) that connect what links of fingerprints connect: texts of one fingerprint, and one text of each for linked ones."""
    least = found.groupBy("fp").agg(F.min("node").alias("least"))
    same = found.select("fp", "node").join(least, "fp").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    edges = links(least.select("fp"))
    ends = edges.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ends.select("x", "y"))


def _parts(edges: DataFrame) -> DataFrame:
    """Components as edges (a, b) from each node to the least of its own: what later links are added to."""
    return materialize(components(edges).select(F.col("id").alias("a"), F.col("component").alias("b")), "near-parts")


def _placed(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """keys with the component of their node, without the keys whose nodes share one."""
    placed = keys.join(parts.select(F.col("a").alias("node"), F.col("b").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    return materialize(placed.join(several, "key", "left_semi"), "near-placed")


def _star(placed: DataFrame, score: F.Column, apart: float) -> DataFrame:
    """Pairs (x, y), at most one for each node x: y is the node of least score in its keys' heads that lies in another component."""
    heads = placed.groupBy("key").agg(F.min(F.struct(score.alias("score"), "node", "part", "n", "alone")).alias("head"))
    fit = (F.col("alone") + F.col("head.alone")) <= (F.col("n") + F.col("head.n")) * apart + SLACK
    offers = placed.join(heads, "key").where(F.col("part") != F.col("head.part")).where(fit)
    best = offers.groupBy("node").agg(F.min(F.struct("head.score", "head.node")).alias("best"))
    return best.select(F.col("node").alias("x"), F.col("best.node").alias("y"))


def _rest(placed: DataFrame, found: DataFrame, apart: float) -> DataFrame:
    """Pairs (x, y) of different components that share a key and are not ruled out by the bounds."""
    rows = placed.join(found.select("node", "bits"), "node")
    # The shorter text of a pair has the first shared key so early that what comes before fits in its share of the difference.
    one = rows.where(F.col("place") <= F.col("n") * apart + SLACK).select("key", F.struct("node", "n", "place", "alone", "part", "bits").alias("one"))
    two = rows.select("key", F.struct("node", "n", "place", "alone", "part", "bits").alias("two"))
    sizes = F.col("one.n") + F.col("two.n")
    ordered = (F.col("one.n") < F.col("two.n")) | ((F.col("one.n") == F.col("two.n")) & (F.col("one.node") < F.col("two.node")))
    shared = F.least(F.col("one.n") - F.col("one.place"), F.col("two.n") - F.col("two.place"))
    odd = sum((F.bit_count(F.col("one.bits")[k].bitwiseXOR(F.col("two.bits")[k])) for k in range(PARITIES // 64)), F.lit(0))
    fits = (shared * 2 >= sizes * (1 - apart) - SLACK) & (F.col("one.alone") + F.col("two.alone") + odd <= sizes * apart + SLACK)
    return one.join(two, "key").where((F.col("one.part") != F.col("two.part")) & ordered & fits).select(F.col("one.node").alias("x"), F.col("two.node").alias("y")).distinct()


def group_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, component_id), once for each doc_id of docs (doc_id, text) that is not null.

    Documents chained by pairs with a Jaccard index of at least `similarity` over shingles of `shingle` words (A-Z
    lower-cased; texts with fewer words are one shingle) share the smallest doc_id. Null texts count as empty; texts without
    words are copies of each other. Rows with equal doc_ids belong together. Rows with a null doc_id are left out. An empty
    table gives an empty result; other columns are not read.
    """
    apart = (1 - similarity) / (1 + similarity)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    prints = materialize(_prints(docs, shingle), "near-prints")
    # One text stands for all equal ones. Texts that only their 64-bit hashes take for equal have no near copies here.
    nodes = prints.groupBy("digest").agg(F.first("node").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("doc_id").alias("first"))
    nodes = materialize(nodes.withColumn("wide", F.col("digest")).groupBy("node").agg(F.min("wide").alias("lo"), F.max("wide").alias("hi"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("first").alias("first")), "near-nodes")
    plain = nodes.where("lo = hi")
    copies = prints.select("doc_id").distinct().join(nodes.select(F.col("first").alias("doc_id")), "doc_id", "left_anti")
    # Written, so that its size is known: Spark sends it to the executors below its threshold and shuffles the texts beyond.
    texts = docs.join(materialize(copies, "near-copies"), "doc_id", "left_anti")
    total, rows = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = docs.sparkSession.sparkContext.broadcast(_common(texts, min(1.0, SAMPLED / max(1, rows)), shingle))
    tasks = 1 + total // TASK_SHINGLES
    shared = _shared(_spread(texts, common, tasks * BUCKETS_A_TASK, shingle), common, tasks)
    found = materialize(_candidates(shared, plain.select("node", "n", "fp"), similarity), "near-candidates")
    keys = materialize(found.select("node", "n", "alone", F.posexplode("keys").alias("place", "key")).withColumn("place", F.col("place") + F.col("alone")), "near-keys")
    likeliest = F.struct((F.col("alone") / F.col("n")).alias("own"), F.xxhash64("node").alias("turn"))
    star = _star(keys.withColumn("part", F.col("node")), likeliest, apart)
    parts = _parts(_verified(_by_prints(found).union(star), found, similarity))
    for turn in range(1, STARS):
        star = _star(_placed(keys, parts), F.struct(F.xxhash64("node", F.lit(turn)).alias("turn")), apart)
        parts = _parts(parts.union(_verified(star, found, similarity)))
    edges = parts.union(_verified(_rest(_placed(keys, parts), found, apart), found, similarity))
    # Rows with equal doc_ids tie their texts together.
    tied = prints.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    tied = prints.select("doc_id", "node").join(tied.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    named = components(edges.union(tied)).select(F.col("id").alias("node"), "component")
    # Texts whose 64-bit hashes alone are equal go by their own digest.
    own = F.when(F.col("lo") == F.col("hi"), F.struct(F.coalesce("component", "node").alias("part"), F.lit(None).cast("binary").alias("digest"))).otherwise(F.struct(F.col("node").alias("part"), F.col("digest")))
    placed = prints.select("doc_id", "digest", "node").join(nodes.select("node", "lo", "hi"), "node").join(named, "node", "left").select("doc_id", own.alias("part"))
    least = placed.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, placed["part"].eqNullSafe(least["part"])).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id. All columns stay; rows with a null doc_id stay.

    Rows with equal doc_ids stay or go together.
    """
    name = fresh("_near_gone", docs)
    gone = group_near_duplicates(docs, shingle, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return docs.join(materialize(gone, "near-gone"), docs["doc_id"] == F.col(name), "left_anti")
