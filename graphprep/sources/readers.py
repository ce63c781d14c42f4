"""Readers of raw sources and the splits that their paths tell. All of them go through Spark's file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphprep.functions.text import drop_empty
from graphprep.schema import EXAMPLES
from graphprep.sources.archives import list_members as list_members
from graphprep.sources.archives import read_archives as read_archives
from graphprep.sources.continued import read_continued as read_continued



def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """AST-path text: a line is a label and paths of (start, ast, end), fields apart by commas, subtokens by bars."""
    parts = drop_empty(F.split("value", " ", -1))
    fields = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.split(p, ",", -1))
    bar = lambda x: F.split(x, r"\|", -1)
    path_of = lambda f: F.struct(bar(F.get(f, F.lit(0))).alias("start"), bar(F.get(f, F.lit(1))).alias("ast"), bar(F.get(f, F.lit(2))).alias("end"))
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(bar(F.element_at(parts, 1)).alias("name"), F.transform(F.filter(fields, lambda f: F.size(f) == 3), path_of).alias("paths"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array each; repartitioned, as such a file is read by one task."""
    return spark.read.schema(schema).json(path, multiLine=True).repartition(spark.sparkContext.defaultParallelism)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated fields without quoting; lines with another number of fields drop out."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") == len(columns))
    return parts.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def read_pairs(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two TSV files of (id, text) joined on the id."""
    a, b = (read_tsv(spark, p, ["id", c]) for p, c in ((left, "source"), (right, "target")))
    return a.join(b, "id")


def read_file_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """Whole files whose names differ in their ends only: rows (prefix, left, right)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    side = lambda end, c: files.where(F.endswith("name", F.lit(end))).select(F.expr(f"left(name, length(name) - {len(end)})").alias("prefix"), F.col("value").alias(c))
    return side(left, "left").join(side(right, "right"), "prefix")


def read_predictions(spark: SparkSession, predictions: str, targets: str) -> DataFrame:
    """Rows (idx, beam, target) of line-aligned files: beams are apart by tabs. Fails if the numbers of lines differ."""

    def lines(path: str, c: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("value"))
        return files.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("pos", c))

    def numbered(rows: DataFrame, c: str) -> DataFrame:
        n = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = n.select("file", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file")) - F.col("n")).alias("shift"))  # a row for each file
        return rows.join(before, "file").select((F.col("shift") + F.col("pos")).alias("idx"), c)

    p, t = numbered(lines(predictions, "line"), "line"), numbered(lines(targets, "target"), "target")
    both = p.join(t, "idx", "full")
    whole = F.when(F.col("line").isNull() | F.col("target").isNull(), F.raise_error("predictions and targets differ in length")).otherwise(F.split("line", "\t", -1))
    return both.select("idx", whole.alias("beam"), "target")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-1 of each file, to hold downloads against what they should be."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"))


def verified(files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """checksums() rows with the wanted sum of the file's name and whether it is met; files without one are not, and none is an error."""
    name = F.element_at(F.split("path", "/", -1), -1)
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv]) if expected else F.create_map().cast("map<string,string>")
    return files.withColumn("expected", F.element_at(want, name)).withColumn("ok", F.coalesce(F.col("expected") == F.col("sha1"), F.lit(False)))


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The flat tables of a bundle, as bundle_examples() takes them: counts, node_rows, edge_rows, types and attrs, and the split bounds.

    Files: edge.csv, node-feat.csv, num-node-list.csv, num-edge-list.csv, graph-label.csv without headers, typeidx2type.csv and
    attridx2attr.csv with them, split/train.csv and split/valid.csv with graph numbers. Line numbers come from the files'
    order, so each of these is one file.
    """

    def lines(name: str) -> DataFrame:
        # The number of a line: lines before it in the file's earlier blocks, by their offsets, and in its own.
        found = spark.read.text(f"{folder}/{name}").select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"))
        n = found.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
        first = n.select("_block", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block")) - F.col("_n")).alias("_first"))  # a row for each block
        at = F.row_number().over(Window.partitionBy("_block").orderBy("_i")) - 1
        return found.withColumn("_at", at).join(first, "_block").select((F.col("_first") + F.col("_at")).alias("place"), "value")

    def numbers(name: str, *columns: str) -> DataFrame:
        p = F.split("value", ",", -1)
        return lines(name).select("place", *[F.trim(p[i]).cast("int").alias(c) for i, c in enumerate(columns)])

    n, e = (numbers(f"num-{k}-list.csv", f"n_{k}s") for k in ("node", "edge"))
    names = lines("graph-label.csv").select("place", F.col("value").alias("name"))
    last = lambda s: spark.read.text(f"{folder}/split/{s}.csv").agg(F.max(F.col("value").cast("long"))).first()[0]
    types = spark.read.text(f"{folder}/typeidx2type.csv").select(F.split("value", ",", -1).alias("p")).select(F.col("p")[0].try_cast("int").alias("type_id"), F.col("p")[1].alias("type")).where("type_id is not null")
    return {
        "counts": n.join(e, "place").join(names, "place").withColumnRenamed("place", "graph"),
        "node_rows": numbers("node-feat.csv", "type_id", "attr_id"),
        "edge_rows": numbers("edge.csv", "src", "dst"),
        "types": types,
        "attrs": read_continued(spark, f"{folder}/attridx2attr.csv").select(F.col("id").alias("attr_id"), "label"),
        "bounds": spark.createDataFrame([(last("train"), last("valid"))], "last_train long, last_valid long"),
    }


def read_examples(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    """Examples as write_examples() or write_json() left them, never inferred; provenance that is missing is empty."""
    read = spark.read.schema(EXAMPLES)
    rows = read.json(path) if as_json else read.option("mergeSchema", "true").parquet(path)
    return rows.withColumn("provenance", F.coalesce("provenance", F.lit("")))


def read_tfrecords(spark: SparkSession, path: str, schema: str | None = None, **options: object) -> DataFrame:
    """TFRecord files as rows of features, or of bytes without a schema. options: split, hosts, host, parts, part; see tfrecords.py."""
    from graphprep.sources.tfrecords import FORMAT, register
    from graphprep.sources.writers import qualified

    register(spark)
    read = spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()})
    return (read.schema(schema) if schema else read).load(qualified(spark, path)[0])


def read_vocabulary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows (kind, token, id): the id is the number of the line. A vocabulary is one file and bounded by its size parameter."""
    lines = F.split(F.regexp_replace("value", r"\n$", ""), r"\n", -1)
    return spark.read.text(path, wholetext=True, pathGlobFilter="part-*").where("value <> ''").select(F.lit(kind).alias("kind"), F.posexplode(lines).alias("id", "token")).select("kind", "token", "id")


def split_from_path(path: Column) -> Column:
    """train, valid or test by what the path holds; an error where it holds none."""
    return F.when(path.contains("train"), "train").when(path.contains("valid") | path.contains("dev"), "valid").when(path.contains("test"), "test").otherwise(F.raise_error(F.concat(F.lit("no split in "), path)))
