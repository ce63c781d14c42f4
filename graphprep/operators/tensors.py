"""Feature rows to padded tensors and batches of them. Sparse pairs are made dense only on request: dense edges take types x nodes^2 cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from graphprep.operators.encode import mask, pad
from graphprep.operators.rules import batches
from graphprep.schema import PAD, PAD_ID


@dataclass(frozen=True)
class PaddingSizes:
    """What all examples are padded to. Edge types are those of the vocabulary: its reserved entries are valid types too."""

    nodes: int
    outputs: int
    edge_types: int
    subtokens: int = 1


def padding_sizes(features: DataFrame, vocab: DataFrame) -> PaddingSizes:
    """The largest example over all splits, in one aggregate, and the size of the edge vocabulary."""
    largest = lambda c: F.coalesce(F.max(c), F.lit(0))
    got = features.agg(largest(F.size("node_label_ids")).alias("n"), largest(F.size("target_token_ids")).alias("o"), largest(F.array_max("node_lengths")).alias("s")).first()
    types = vocab.where("kind = 'edge_type'").count()
    return PaddingSizes(got["n"], got["o"], types, max(1, got["s"]))


def dense_pairs(rows: Column, columns: Column, n_rows: int, n_columns: int) -> Column:
    """0/1 matrix with ones at the given places. Costs the cells and the pairs of each row, not their product."""
    own = lambda i: F.transform(F.filter(F.arrays_zip(rows.alias("r"), columns.alias("c")), lambda p: p["r"] == i), lambda p: p["c"])
    line = lambda at: F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda j: F.array_contains(at, j).cast("int"))
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(n_rows - 1)), own), line)


def dense_edges(types: Column, src: Column, dst: Column, n_types: int, n_nodes: int) -> Column:
    """0/1 tensor (type, source, destination)."""
    every = F.arrays_zip(types.alias("t"), src.alias("s"), dst.alias("d"))

    def plane(k: Column) -> Column:
        own = F.filter(every, lambda e: e["t"] == k)
        ends = lambda i: F.transform(F.filter(own, lambda e: e["s"] == i), lambda e: e["d"])
        line = lambda i: F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda j: F.array_contains(ends(i), j).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), line)

    return F.transform(F.sequence(F.lit(0), F.lit(n_types - 1)), plane)


def ragged(values: Column, lengths: Column, n_rows: int, n_columns: int, filler: int = PAD_ID) -> Column:
    """Rows of the given lengths out of a flat array, padded to n_rows x n_columns. What goes beyond is cut."""
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n.cast("int"))))
    line = lambda at, n: pad(F.slice(values, at + 1, F.least(n.cast("int"), F.lit(n_columns))), n_columns, filler)
    empty = F.array_repeat(F.lit(filler), n_columns)
    found = F.zip_with(F.slice(ends, F.lit(1), F.size(lengths)), lengths, line)
    return F.slice(F.concat(found, F.array_repeat(empty, F.greatest(F.lit(n_rows) - F.size(lengths), F.lit(0)))), 1, n_rows)


def padded(features: DataFrame, sizes: PaddingSizes, dense: bool = False) -> DataFrame:
    """Feature rows at one shape. dense turns copies, pointers and edges from pairs into tensors as well."""
    n, o = sizes.nodes, sizes.outputs
    rows = features.withColumns(
        {
            "target_token_ids": pad(F.col("target_token_ids"), o, PAD_ID),
            "target_texts": pad(F.col("target_texts"), o, PAD),
            "node_ids": ragged(F.col("node_label_ids"), F.col("node_lengths"), n, sizes.subtokens),
            "node_type_ids": pad(F.col("node_type_ids"), n, PAD_ID),
            "node_texts": pad(F.col("node_texts"), n, PAD),
            "candidate_mask": mask(F.col("candidate_indices"), F.lit(n)),
        }
    )
    if dense:
        rows = rows.withColumns({"copies": dense_pairs(F.col("copy_out"), F.col("copy_in"), o, n), "pointers": dense_pairs(F.col("pointer_out"), F.col("pointer_in"), o, n), "edges": dense_edges(F.col("edge_type_ids"), F.col("edge_src"), F.col("edge_dst"), sizes.edge_types, n)})
    return rows


def shuffled(rows: DataFrame, key: str, seed: int, epochs: int = 1) -> DataFrame:
    """Rows in an order by hash of (seed, epoch, key), epochs one after another, with columns epoch and turn."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("turn", F.xxhash64(F.lit(seed), "epoch", key))


def take(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows in an order; all of them for -1."""
    return rows if n == -1 else rows.orderBy(*order).limit(n)


def batched(rows: DataFrame, by: list[str], order: str, size: int, columns: list[str], drop_remainder: bool = True) -> DataFrame:
    """One row for each batch: arrays of `size` entries (the last batch may be shorter unless dropped), in order."""
    found = batches(rows, by, order, size, drop_remainder)
    held = found.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))  # `size` rows
    return held.select(*by, "batch", *[F.col(f"_rows.{c}").alias(c) for c in columns])


#: Feature columns of sparse batches: how a graph's entries are counted, and what points where.
_FLAT = {"node": ["node_label_ids", "node_lengths", "node_type_ids"], "edge": ["edge_type_ids"], "output": ["target_token_ids"]}
_POINTING = {"edge_src": "node", "edge_dst": "node", "copy_out": "output", "copy_in": "node", "pointer_out": "output", "pointer_in": "node", "candidate_indices": "node"}


def sparse_batches(features: DataFrame, by: list[str], order: str, size: int, drop_remainder: bool = True) -> DataFrame:
    """One row for each batch of `size` feature rows, their graphs side by side in one: nothing is padded.

    Nodes, edges and outputs of the graphs follow one another in flat arrays; node_splits, edge_splits and output_splits say where each graph
    begins and the last one ends, label_splits the same for the subtokens of nodes. What points to nodes or outputs (edge ends, copies,
    pointers, candidates) is moved by the number of those before its graph, so that a batch is one graph whose parts do not touch.
    example_ids keeps their order.
    """
    found = batches(features, by, order, size, drop_remainder)
    columns = [c for c in dict.fromkeys(["example_id", *sum(_FLAT.values(), []), *_POINTING]) if c in features.columns]
    held = found.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))  # `size` rows
    sizes = {"node": "node_type_ids", "edge": "edge_src", "output": "target_token_ids", "label": "node_label_ids"}
    begin = lambda c: F.aggregate(F.transform("_rows", lambda r: F.size(r[c])), F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    held = held.withColumns({f"{k}_splits": begin(c) for k, c in sizes.items()})
    flat = [F.flatten(F.col(f"_rows.{c}")).alias(c) for c in sum(_FLAT.values(), [])]

    def moved(c: str, to: str) -> Column:
        shifts = F.slice(f"{to}_splits", F.lit(1), F.size("_rows"))
        return F.flatten(F.zip_with("_rows", shifts, lambda r, s: F.transform(r[c], lambda x: x + s))).alias(c)

    return held.select(*by, "batch", F.col("_rows.example_id").alias("example_ids"), *[f"{k}_splits" for k in sizes], *flat, *[moved(c, to) for c, to in _POINTING.items() if c in features.columns])


def training_batches(features: DataFrame, split: str, size: int, columns: list[str], seed: int = 0, epochs: int = 1, most: int = -1) -> DataFrame:
    """Batches of one split: shuffled anew each epoch and without remainder for train, once and in order of example_id for the others."""
    own = take(features.where(F.col("split") == split), most, [F.col("example_id")])
    if split == "train":
        return batched(shuffled(own, "example_id", seed, epochs), ["epoch"], "turn", size, columns)
    return batched(own.withColumn("turn", F.xxhash64("example_id")).withColumn("epoch", F.lit(0)), ["epoch"], "turn", size, columns, drop_remainder=False)


def iterate(batch_rows: DataFrame) -> Iterator[Row]:
    """Batches to a consumer on the driver, a partition at a time with the next one under way."""
    yield from batch_rows.toLocalIterator(prefetchPartitions=True)


def shard_files(spark: SparkSession, path: str, hosts: int = 1, host: int = 0, parts: int = 1, part: int = 0) -> list[str]:
    """Files of a Parquet folder in order that belong to a host and, of these, to one of its parts. Only the listing is read."""
    files = sorted(spark.read.parquet(path).inputFiles())
    return files[host::hosts][part::parts]


def decode(ids: DataFrame, vocab: DataFrame, kind: str) -> DataFrame:
    """Add token to rows with an id; an id that the vocabulary doesn't have is an error. A vocabulary is bounded by its size parameter."""
    own = vocab.where(F.col("kind") == kind).select("id", F.col("token").alias("_token"))
    found = ids.join(F.broadcast(own), "id", "left")
    unknown = F.raise_error(F.concat(F.lit("no token has the id "), F.col("id").cast("string")))
    return found.withColumn("token", F.when(F.col("_token").isNotNull(), F.col("_token")).otherwise(unknown)).drop("_token")
