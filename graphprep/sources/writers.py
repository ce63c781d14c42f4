"""Writers of examples, metadata, vocabularies and predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions.text import cut_at
from graphprep.schema import SPLITS


def write_examples(examples: DataFrame, path: str, mode: str = "errorifexists", shards: int | None = None) -> None:
    """Parquet by split, so that a split's readers prune the others. Existing output is an error unless mode says otherwise."""
    rows = examples.repartition(shards) if shards else examples
    rows.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(path)


def write_json(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines by split, packed: nodes and edges repeat their names, and take some tenfold the room in plain text."""
    examples.write.mode(mode).option("compression", "gzip").partitionBy("split").json(path)


def write_metadata(row: DataFrame, path: str, mode: str = "errorifexists", warning: str | None = None) -> None:
    """One row as one JSON file."""
    (row.withColumn("WARNING", F.lit(warning)) if warning else row).coalesce(1).write.mode(mode).json(path)


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One escaped token a line, by id, in one file; a vocabulary is bounded by its size parameter."""
    vocab.orderBy("id").select("token").coalesce(1).write.mode(mode).text(path)


def write_predictions(rows: DataFrame, tokens: str, path: str, mode: str = "errorifexists") -> None:
    """Words up to the first DONE, a line each, by idx."""
    rows.orderBy("idx").select(F.array_join(cut_at(F.col(tokens)), " ").alias("value")).write.mode(mode).text(path)


def write_evaluation(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Line-aligned text of evaluated rows (idx, beam, target, score, provenance) in four folders; beams are arrays of token arrays.

    A beam's texts stand apart by tabs, each cut at its first DONE.
    """
    said = lambda c: F.array_join(cut_at(c), " ")
    lines = {"predictions": F.array_join(F.transform("beam", said), "\t"), "targets": said(F.col("target")), "scores": F.format_string("%.6f", "score"), "provenances": F.coalesce("provenance", F.lit(""))}
    ordered = rows.orderBy("idx")
    for name, line in lines.items():
        ordered.select(line.alias("value")).write.mode(mode).text(f"{path}/{name}")


def copy_vocabulary(source: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The vocabularies of another run, a folder for each kind."""
    for kind in ("node_type", "node_label", "edge_type", "output_token"):
        write_vocabulary(source.where(F.col("kind") == kind), f"{path}/{kind}", mode)


def shard_name(prefix: str, shard: int, shards: int) -> str:
    return f"{prefix}-{shard:05d}-of-{shards:05d}"


def write_shard(rows: DataFrame, path: str, prefix: str, shard: int, shards: int) -> None:
    """One of several parts of a result, in a folder of its own that a repeated run replaces as a whole."""
    rows.write.mode("overwrite").parquet(f"{path}/{shard_name(prefix, shard, shards)}")


def shards_to_do(spark: SparkSession, path: str, prefix: str, shards: int) -> list[int]:
    """The parts that are not there whole yet: a folder counts once Spark has marked it as done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def done(k: int) -> bool:
        mark = hadoop(f"{path}/{shard_name(prefix, k, shards)}/_SUCCESS")
        return mark.getFileSystem(conf).exists(mark)

    return [k for k in range(shards) if not done(k)]


def append_measurements(rows: DataFrame, path: str) -> None:
    """Rows (step, split, metric, value) behind those that are there."""
    rows.select("step", "split", "metric", "value").write.mode("append").partitionBy("split").parquet(path)


@dataclass(frozen=True)
class Layout:
    """Where a dataset's parts lie below a folder."""

    root: str

    @property
    def examples(self) -> str:
        return f"{self.root}/examples"

    @property
    def features(self) -> str:
        return f"{self.root}/features"

    @property
    def metadata(self) -> str:
        return f"{self.root}/metadata"

    def vocabulary(self, kind: str) -> str:
        return f"{self.root}/vocabularies/{kind}"


def write_tfrecords(features: DataFrame, path: str, shards: int, mode: str = "errorifexists") -> None:
    """Feature rows as TFRecord files, `shards` of them for each split: path/split-k-of-n.tfrecord, rows in order of example_id.

    Arrays of numbers become int64 or float lists, strings and arrays of strings byte lists. Files appear when all are whole;
    see tfrecords.py. path is a folder that all executors reach.
    """
    from graphprep.sources.tfrecords import FORMAT, register

    spark = features.sparkSession
    place, there = qualified(spark, path)
    if there and mode == "errorifexists":
        raise FileExistsError(place)
    register(spark)
    keyed = features.withColumn("_shard", F.pmod(F.xxhash64("example_id"), F.lit(shards)).cast("int"))
    # A task for each file: dealt by a hash of split and shard, large files would meet in one task while others had none.
    task = F.when(F.col("split") == SPLITS[0], 0).when(F.col("split") == SPLITS[1], 1).otherwise(2) * shards + F.col("_shard")
    dealt = keyed.repartitionById(3 * shards, task.cast("int")).sortWithinPartitions("split", "_shard", "example_id").drop("example_id")
    dealt.write.format(FORMAT).option("shards", shards).mode("append" if mode == "errorifexists" else mode).save(place)


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as Spark would complete it, and whether something is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString(), system.exists(where)
