"""Ranked lexical search in whole numbers, with classes of documents that score alike.

1. Items (the queries) are taken in blocks whose terms fit in a bounded vocabulary. Documents are restricted to it: a
   document's bag is the vocabulary's terms that it holds with their frequencies, and its number of terms of any kind.
2. Documents of equal bags and of equal length factor m score alike for every item. They are grouped by a hash of both, and by
   the bag and m themselves, which verifies the hash. Document frequencies follow from the classes and their sizes.
3. Every class is scored once against the block's items, term by term.
4. The `top` best classes of an item, equal scores by their smallest doc_id, hold its `top` best documents: each of them has a
   member that comes before all members of the others. Only these classes are expanded, each by its members in ascending
   order of doc_id, at most `top` of them, and the documents are ranked.

A term is a maximal run of digits, ASCII letters and characters beyond ASCII; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphprep.llm.common import map_batches, materialize, text_bytes, worker_cache

TOP = 50
#: Items of one block, at most on average, and bytes of their texts: what is sent to the executors.
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 8_000_000
#: Numbers that one step of scoring holds.
AT_ONCE = 4_000_000
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of UTF-8 text, in order, with repeats."""
    return raw.translate(_TERM).split()


def _bags(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Rows (doc_id, n, terms, tfs): terms are numbers of words, ascending. Documents without any of them have empty ones."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("ranking")
        if cache.get("words") is not sent.value:
            cache.update(words=sent.value, numbers={w: i for i, w in enumerate(sent.value)})
        numbers = cache["numbers"]
        for b in batches:
            ns, terms, tfs = [], [], []
            for raw in text_bytes(b.column(1)):
                found = terms_of(raw)
                bag = sorted((numbers[t], n) for t, n in Counter(found).items() if t in numbers)
                ns.append(len(found))
                terms.append([t for t, _ in bag])
                tfs.append([n for _, n in bag])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tfs array<bigint>", caches="ranking")


def _scores(classes: DataFrame, weights: np.ndarray, items: list[np.ndarray], top: int) -> DataFrame:
    """Rows (item, class, first, score): of each task's classes those that may be among an item's `top` best."""
    sent = classes.sparkSession.sparkContext.broadcast((weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = sent.value
        step = max(1, AT_ONCE // max(1, len(weights), len(items)))
        held = [np.zeros(0, np.int64)] * len(items)  # the best scores of this task
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), sizes)
                term, tf = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
                m = b.column(2).to_numpy()[row]
                part = np.zeros((len(weights), b.num_rows), np.int64)
                part[term, row] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                turn = np.empty(b.num_rows, np.int64)
                turn[pc.sort_indices(pa.table({"x": b.column(1)}), [("x", "ascending")], null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
                out = []
                for i, own in enumerate(items):
                    score = part[own].sum(axis=0)
                    some = np.flatnonzero(score >= (held[i].min() if len(held[i]) == top else 1))
                    if len(some) > top:
                        some = some[np.lexsort((turn[some], -score[some]))[:top]]
                    if len(some):
                        held[i] = np.sort(np.r_[held[i], score[some]])[-top:]
                        out.append((np.full(len(some), i), some, score[some]))
                item, at, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(score.astype(np.int64))], names=["item", "class", "first", "score"])

    return map_batches(classes.select("class", "first", "m", "terms", "tfs"), run, f"item int, class long, first {classes.schema['first'].dataType.simpleString()}, score long")


def _best(df: DataFrame, group: list[str], order: list, top: int, rank: str) -> DataFrame:
    """The first `top` rows of each group. Spark cuts the groups to `top` in each task before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= top)


def _ranked_block(docs: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    """Rows (item, rank, doc_id, score) of the items with the given texts, by their number."""
    spark = docs.sparkSession
    own = [sorted(set(terms_of(t))) for t in texts]
    words = sorted({t for ts in own for t in ts})
    number = {w: i for i, w in enumerate(words)}
    items = [np.array([number[t] for t in ts], np.int64) for ts in own]
    bags = materialize(_bags(docs, words), "ranking-bags")
    n_docs, n_terms = bags.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(1, n_terms)}L")
    holding = bags.where(F.size("terms") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("terms", "tfs", "m"))
    classes = holding.groupBy("hash", "m", "terms", "tfs").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"))
    same = ["hash", "m", "terms", "tfs"]
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "ranking-classes")
    df = classes.select(F.explode("terms").alias("term"), "size").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(words), np.int64)
    for r in df.select("term", weight.alias("w")).toLocalIterator():  # a row for each word of the block at most
        weights[r[0]] = r[1]
    found = _scores(classes, weights, items, top)
    best = materialize(_best(found, ["item"], [F.desc("score"), F.asc("first")], top, "rank").drop("rank"), "ranking-best")
    # A row for each item and place at most. The hash finds the members, the bags verify them.
    wanted = classes.join(F.broadcast(best.select("class").distinct()), "class").select("class", *same)
    maybe = holding.select("doc_id", *same).join(F.broadcast(wanted.select("hash").distinct()), "hash")
    members = _best(maybe, same, [F.asc("doc_id")], top, "turn").join(wanted, same).select("class", "doc_id")
    return _best(best.join(members, "class"), ["item"], [F.desc("score"), F.asc("doc_id")], top, "rank").select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For each item its `top` best documents: rows (item_id, rank, doc_id, score), rank from 1, equal scores by ascending doc_id.

    docs has doc_id and text, other columns are not read. Null texts have no terms; neither items without terms nor items without
    a document that holds one of theirs give rows. Repeated rows of documents are documents of their own, a null doc_id comes
    before others; items that are equal in id and text are one, those that share an id only are ranked one by one. Empty tables
    give an empty result.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    distinct = materialize(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct(), "ranking-items")
    many, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-many // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    out = None
    for k in range(blocks):  # as many as the items need, whatever the documents
        rows = distinct.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if not rows and out is not None:
            continue
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        part = _ranked_block(docs, [(r[1] or "").encode() for r in rows], top)
        part = materialize(part.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranking-block")
        out = part if out is None else out.unionByName(part)
    return out
