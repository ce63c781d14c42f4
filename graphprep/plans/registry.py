"""Datasets by name: how their raw files are read, what examples they make, and both stages of creating one.

A source is a Source: read(spark, path) gives raw rows with example_id, split (null where the source knows none) and provenance,
to_examples(rows) adds nodes, edges and output. register() adds one of a user's own; create() runs it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions.text import drop_empty, integers_of, token, words
from graphprep.operators import builders as B
from graphprep.operators import encode as E
from graphprep.operators import rules as R
from graphprep.plans import dataset as D
from graphprep.sources import readers as S
from graphprep.sources import writers as W
from graphprep.sources.scratch import scratch

KINDS = ("node_type", "node_label", "edge_type", "output_token")


@dataclass(frozen=True)
class Source:
    """A dataset. metrics is the name of its metric set; transforms and filters are those of the first stage."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    to_examples: Callable[[DataFrame], DataFrame]
    metrics: str = ""
    transforms: Sequence[D.Transform] = ()
    filters: Sequence[Column] = ()
    options: Mapping[str, object] = field(default_factory=dict)


_SOURCES: dict[str, Source] = {}


def register(source: Source, replace: bool = False) -> Source:
    if source.name in _SOURCES and not replace:
        raise ValueError(f"there is a source named {source.name}")
    _SOURCES[source.name] = source
    return source


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise ValueError(f"no source is named {name}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def create(
    spark: SparkSession,
    name: str,
    raw: str,
    out: str,
    stages: str = "12",
    shares: tuple[int, int, int] | None = None,
    seed: int = 0,
    shards: int = 1000,
    most_nodes: int | Mapping[str, int] = 1024,
    vocabulary_sizes: int | Mapping[str, int] = 10_000,
    dedup: bool = False,
    filters: Sequence[Column] = (),
    mode: str = "errorifexists",
) -> W.Layout:
    """Create a dataset below `out`; examples and their metadata in stage 1, vocabularies, features and theirs in stage 2.

    shares (train, valid, test in per cent) split by a hash of example_id and seed; without them the source must know the splits. Stage 2
    leaves out graphs of more nodes than most_nodes, for all splits or by split, before it counts words. Features are written as
    Parquet and, in `shards` files a split, as TFRecord.
    """
    if stages not in ("1", "2", "12"):
        raise ValueError("stages are 1, 2 or 12")
    own, layout = source(name), W.Layout(out)
    if "1" in stages:
        rows = own.read(spark, raw)
        split = R.split_of(F.concat_ws(":", F.lit(str(seed)), "example_id"), shares) if shares else F.coalesce("split", F.raise_error(F.lit(f"{name} knows no splits: shares are wanted")).cast("string"))
        # The examples are written before anything else reads them: what makes them runs once.
        made = own.to_examples(rows.withColumn("split", split).withColumn("source", F.lit(name)))
        made = D.prepare(made, own.transforms, own.filters, dedup)
        kept = [c for c in ("example_id", "split", "source", "task", "provenance", "nodes", "edges", "output", "n_nodes", "n_edges", "n_output", "n_edge_types") if c in made.columns]
        W.write_examples(made.select(*kept), layout.examples, mode)
        W.write_metadata(D.published_names(D.metadata(spark.read.parquet(layout.examples)), name), f"{layout.metadata}/stage_1", mode)
    if "2" in stages:
        most = {s: most_nodes for s in R.SPLITS} if isinstance(most_nodes, int) else dict(most_nodes)
        small = F.coalesce(*[F.when(F.col("split") == s, F.size("nodes") <= n) for s, n in most.items()], F.lit(True))
        examples = S.read_examples(spark, layout.examples).where(small)
        for f in filters:
            examples = examples.where(f)
        sizes = {k: vocabulary_sizes for k in KINDS} if isinstance(vocabulary_sizes, int) else dict(vocabulary_sizes)
        # Counted once, not for each vocabulary.
        place, found = scratch(spark, "counts"), E.token_counts(examples.where("split = 'train'"))
        found.write.parquet(place)
        counts = spark.read.schema(found.schema).parquet(place)
        for k in KINDS:
            W.write_vocabulary(E.vocabulary(counts.where(F.col("kind") == k), sizes.get(k, 10_000)), layout.vocabulary(k), mode)
        vocab = S.read_vocabulary(spark, layout.vocabulary(KINDS[0]), KINDS[0])
        for k in KINDS[1:]:
            vocab = vocab.unionByName(S.read_vocabulary(spark, layout.vocabulary(k), k))
        D.features(examples, vocab).write.mode(mode).partitionBy("split").parquet(f"{layout.features}/parquet")
        rows = spark.read.parquet(f"{layout.features}/parquet")
        W.write_tfrecords(rows, f"{layout.features}/tfrecord", shards, mode)
        W.write_metadata(D.published_names(D.feature_metadata(rows), name), f"{layout.metadata}/stage_2", mode)
    return layout


def split_by_end(path: Column, ends: Mapping[str, str]) -> Column:
    """The split that the end of a file's name tells; an error where none does."""
    found = F.coalesce(*[F.when(F.endswith(path, F.lit(e)), s) for e, s in ends.items()])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no split in the name of "), path)).cast("string"))


def split_by_parent(path: Column, folders: Mapping[str, str]) -> Column:
    """The split that the name of the folder around a file tells; an error where none does."""
    parent = F.element_at(F.split(path, "/", -1), -2)
    found = F.coalesce(*[F.when(parent == f, s) for f, s in folders.items()])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no split in the folder of "), path)).cast("string"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (example_id, file, value): ids are the file's name and the row's number in the pass that reads it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"))
    return rows.select(F.concat_ws(":", "_name", F.monotonically_increasing_id().cast("string")).alias("example_id"), "file", "value")


_ENDS = {"train.c2s": "train", "val.c2s": "valid", "test.c2s": "test"}
_BY_LAST = {f"{s}{e}": t for e in ("", ".txt", ".tsv") for s, t in (("train", "train"), ("valid", "valid"), ("test", "test"))}


def _read_code2seq(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("value <> ''")
    parts = drop_empty(F.split("value", " ", -1))
    bar = lambda x: F.split(x, r"\|", -1)
    fields = F.filter(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.split(p, ",", -1)), lambda f: F.size(f) == 3)
    path_of = lambda f: F.struct(bar(F.get(f, F.lit(0))).alias("start"), bar(F.get(f, F.lit(1))).alias("ast"), bar(F.get(f, F.lit(2))).alias("end"))
    return rows.select("example_id", split_by_end(F.col("file"), _ENDS).alias("split"), F.col("file").alias("provenance"), bar(F.element_at(parts, 1)).alias("name"), F.transform(fields, path_of).alias("paths"))


def _read_convattn(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("filename string, name array<string>, tokens array<string>").json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file"))
    keyed = rows.withColumn("example_id", F.concat_ws(":", "file", F.monotonically_increasing_id().cast("string")))
    return keyed.select("example_id", R.two_way_split(F.col("example_id"), F.col("file").contains("test")).alias("split"), F.col("filename").alias("provenance"), "name", "tokens")


def _read_funcom(spark: SparkSession, path: str) -> DataFrame:
    """functions.<split> and comments.<split>, joined by the ids of their lines within a split."""
    sides = []
    for side in ("functions", "comments"):
        rows = spark.read.text(path, pathGlobFilter=f"{side}.*").select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t", -1).alias("p")).where("size(p) = 2")
        sides.append(rows.select(split_by_end(F.col("file"), _BY_LAST).alias("split"), F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias(side)))
    both = sides[0].join(sides[1], ["split", "id"])
    return both.select(F.concat_ws(":", "split", "id").alias("example_id"), "split", F.col("id").alias("provenance"), "functions", "comments")


_GREAT = "source_tokens array<string>, edges array<array<string>>, has_bug boolean, error_location int, repair_targets array<int>, repair_candidates string, provenances string"


def _read_great(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_GREAT).json(path, recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"))
    given = F.transform("edges", lambda e: F.struct(e[0].cast("int").alias("src"), e[1].cast("int").alias("dst"), e[3].alias("type")))
    keyed = rows.withColumn("example_id", F.concat_ws(":", "_name", F.monotonically_increasing_id().cast("string"))).withColumn("links", given)
    return keyed.withColumn("split", split_by_parent(F.col("file"), {"train": "train", "dev": "valid", "eval": "test"})).withColumnRenamed("provenances", "provenance").drop("edges", "_name", "file")


def _read_retrieve(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).withColumn("p", F.split("value", "\t", -1)).where("size(p) = 4")
    fields = [F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("name", "comment", "arguments", "function"))]
    return rows.select("example_id", split_by_end(F.col("file"), _BY_LAST).alias("split"), F.col("file").alias("provenance"), *fields)


def _three_trees(rows: DataFrame) -> DataFrame:
    sections = {"FUNCTION_NAME": words(F.col("name")), "DOCSTRING": words(F.col("comment")), "ARGUMENTS": words(F.col("arguments"))}
    return B.tree_examples(rows, sections, F.transform(words(F.col("function")), token))


def _read_ogb(spark: SparkSession, path: str) -> DataFrame:
    bundle = S.read_bundle(spark, path)
    bounds = bundle.pop("bounds")
    examples = B.bundle_examples(**bundle).crossJoin(F.broadcast(bounds))  # one row
    split = F.when(F.col("graph") <= F.col("last_train"), "train").when(F.col("graph") <= F.col("last_valid"), "valid").otherwise("test")
    return examples.withColumns({"example_id": F.col("graph").cast("string"), "split": split, "provenance": F.lit("")}).drop("last_train", "last_valid")


def _read_dummy(spark: SparkSession, path: str) -> DataFrame:
    """`path` is the number of graphs: nothing is read."""
    rows = B.random_chains(spark, int(path or 1000))
    key = next(c for c in ("example_id", "graph", "id") if c in rows.columns)
    return rows.withColumns({"example_id": F.col(key).cast("string"), "split": F.lit(None).cast("string"), "provenance": F.lit("")})


register(Source("code2seq_dataset", _read_code2seq, lambda rows: B.path_examples(rows, "paths", F.transform("name", token)), "code2seq_dataset"))
register(Source("convattn_dataset", _read_convattn, lambda rows: B.chain_examples(rows, F.col("tokens"), F.transform("name", token)), "convattn_dataset"))
register(Source("funcom_dataset", _read_funcom, lambda rows: B.chain_examples(rows, words(F.col("functions")), F.transform(words(F.col("comments")), token)), "funcom_dataset"))
register(Source("great_var_misuse_dataset", _read_great, lambda rows: B.misuse_examples(rows, "source_tokens", "links", integers_of(F.col("repair_candidates")), "has_bug", "error_location", "repair_targets"), "great_var_misuse_dataset"))
register(Source("retrieve_and_edit_dataset", _read_retrieve, _three_trees, "retrieve_and_edit_dataset"))
register(Source("ogb_code_dataset", _read_ogb, lambda rows: rows, "ogb_code_dataset"))
register(Source("dummy_dataset", _read_dummy, lambda rows: rows))
