"""Queries that write the supplied tables by a sink and read them back by a source, as digests of what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import builders as B
from graphprep.operators import rules as R
from graphprep.plans import dataset as D
from graphprep.plans import registry as G
from graphprep.plans.examples import document_chains, shards_of, spread, table, table_bytes
from graphprep.plans.queries import _SPLIT, _TOK, query
from graphprep.sources import readers as S
from graphprep.sources import writers as W
from graphprep.sources.scratch import scratch

_HEAD = "('0x'||substr(md5({}),1,8))::BIGINT"


def _head(text: Column) -> Column:
    """A number of 32 bits that tells texts apart."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select(F.col("doc_id").cast("string").alias("example_id"), R.split_of(F.col("doc_id")).alias("split"), F.coalesce("text", F.lit("")).alias("text"), "lang")


# ---- TFRecord


@query(f"SELECT split, count(*) AS n_records, sum(len(w))::BIGINT AS n_words, sum(list_sum(list_transform(w, lambda x, i: length(x) * i)))::BIGINT AS lengths, sum({_HEAD.format('text')})::BIGINT AS texts FROM (SELECT {_SPLIT} AS split, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w FROM documents) GROUP BY split")
def tfrecord_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the lengths of their words through TFRecord files of four shards a split, or more where the table is large."""
    rows = _documents(spark, sf_dir).select("example_id", "split", "text", F.transform(T.words(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("lengths"))
    path = scratch(spark, "tfrecord")
    W.write_tfrecords(rows, path, shards_of(table(spark, sf_dir, "documents")))
    out = None
    for split in R.SPLITS:
        got = S.read_tfrecords(spark, path, "text string, lengths array<bigint>", split=split)
        summed = F.aggregate(F.transform("lengths", lambda n, i: n * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
        one = got.agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("lengths")).cast("bigint").alias("n_words"), F.sum(summed).cast("bigint").alias("lengths"), F.sum(_head(F.coalesce("text", F.lit("")))).alias("texts")).where("n_records > 0").select(F.lit(split).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n_records, count(DISTINCT doc_id) AS n_different, sum(doc_id)::BIGINT AS ids, 4::BIGINT AS n_parts FROM documents")
def tfrecord_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of two hosts with two parts each hold every record once."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), R.split_of(F.col("doc_id")).alias("split"), "doc_id")
    path = scratch(spark, "tfrecord-parts")
    W.write_tfrecords(rows, path, shards_of(table(spark, sf_dir, "documents")))
    out = None
    for host in range(2):
        for part in range(2):
            one = S.read_tfrecords(spark, path, "doc_id bigint", hosts=2, host=host, parts=2, part=part).withColumn("part", F.lit(2 * host + part))
            out = one if out is None else out.unionByName(one)
    return out.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("doc_id").alias("n_different"), F.sum("doc_id").alias("ids"), F.countDistinct("part").alias("n_parts"))


# ---- examples, vocabularies, metadata


@query(f"WITH {_TOK} SELECT 'json' AS kind, split, count(DISTINCT doc_id) AS n, count(*) AS n_nodes, sum(2 * pos)::BIGINT AS edge_ends, sum({_HEAD.format('label')})::BIGINT AS labels FROM lab GROUP BY split UNION ALL SELECT 'parquet', split, count(DISTINCT doc_id), count(*), sum(2 * pos)::BIGINT, sum({_HEAD.format('label')})::BIGINT FROM lab GROUP BY split")
def examples_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token chains as examples written as Parquet and as JSON."""
    rows = document_chains(spark, sf_dir).withColumns({"example_id": F.col("doc_id").cast("string"), "source": F.lit("documents"), "provenance": F.lit("")}).select("example_id", "split", "source", "provenance", "nodes", "edges", "output")
    out = None
    for kind, write in (("parquet", W.write_examples), ("json", W.write_json)):
        path = scratch(spark, f"examples-{kind}")
        write(rows, path)
        got = S.read_examples(spark, path, as_json=kind == "json")
        labels = F.aggregate(F.transform("nodes.label", _head), F.lit(0).cast("bigint"), lambda s, v: s + v)
        # Each edge 0-1, 1-2, ... stands in both ways; the larger ends of a chain of n are 1 to n - 1.
        ends = F.aggregate("edges", F.lit(0).cast("bigint"), lambda s, e: s + F.greatest(e["src"], e["dst"]))
        one = got.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("nodes")).cast("bigint").alias("n_nodes"), F.sum(ends).cast("bigint").alias("edge_ends"), F.sum(labels).cast("bigint").alias("labels")).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_LANG = f"w AS (SELECT {_SPLIT} AS split, coalesce(lang, '') AS lang FROM documents), c AS (SELECT lang AS token, count(*) AS n FROM w WHERE split = 'train' GROUP BY 1)"


@query(f"WITH {_LANG} SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS id FROM c UNION ALL VALUES ('<OOV>', 0), ('<pad>', 1)")
def vocabulary_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as node types: their vocabulary copied to text files and read by the numbers of its lines."""
    from graphprep.operators import encode as E

    docs = table(spark, sf_dir, "documents").select(R.split_of(F.col("doc_id")).alias("split"), F.coalesce("lang", F.lit("")).alias("token"))
    counts = docs.where("split = 'train'").groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).withColumn("kind", F.lit("node_type"))
    path = scratch(spark, "vocabulary")
    W.copy_vocabulary(E.vocabulary(counts, 100), path)
    return S.read_vocabulary(spark, f"{path}/node_type", "node_type").select("token", "id")


@query(f"""WITH {_LANG}, d AS (SELECT split, count(*) AS n FROM w GROUP BY split)
    SELECT s.split, coalesce(d.n, 0) AS n_examples, CASE WHEN d.n > 0 THEN 2 ELSE 0 END::BIGINT AS most_nodes, 'x' AS warning FROM (VALUES ('train'), ('valid'), ('test')) s(split) LEFT JOIN d ON d.split = s.split""")
def metadata_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata file of chains of two nodes, with a warning."""
    docs = _documents(spark, sf_dir)
    rows = B.chain_examples(docs, F.array("lang", "split"), F.array(T.token(F.col("lang"))))
    path = scratch(spark, "metadata")
    W.write_metadata(D.metadata(rows), path, warning="x")
    row = spark.read.json(path)
    cells = [F.struct(F.lit(s).alias("split"), F.col(f"num_{s}_examples").alias("n_examples"), F.col(f"{s}_max_num_nodes").alias("most_nodes"), F.col("WARNING").alias("warning")) for s in R.SPLITS]
    return row.select(F.inline(F.array(*cells)))


@query(f"""WITH {_TOK}, n AS (SELECT doc_id, split, count(*) AS n FROM lab GROUP BY ALL)
    SELECT split, count(*) AS n_examples, sum(n)::BIGINT AS n_nodes, sum(2 * (n - 1))::BIGINT AS n_edges FROM n WHERE n <= 300 GROUP BY split""")
def dataset_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset registered by name and created in both stages from documents: graphs of at most 300 nodes as TFRecord files."""

    def read(s: SparkSession, path: str) -> DataFrame:
        docs = _documents(s, path)
        return docs.withColumn("provenance", F.col("lang"))

    # The output is a word that every text has as a node or the vocabulary knows, so that no example is impossible.
    source = G.Source("documents", read, lambda rows: B.chain_examples(rows, T.words(F.col("text")), F.array(T.token(F.element_at(T.words(F.col("text")), 1)))))
    G.register(source, replace=True)
    layout = G.create(spark, "documents", sf_dir, scratch(spark, "dataset"), shards=shards_of(table(spark, sf_dir, "documents")), most_nodes=300, vocabulary_sizes=500)
    out = None
    for split in R.SPLITS:
        got = S.read_tfrecords(spark, f"{layout.features}/tfrecord", "node_label_ids array<bigint>, edge_src array<bigint>", split=split)
        one = got.agg(F.count(F.lit(1)).alias("n_examples"), F.sum(F.size("node_label_ids")).cast("bigint").alias("n_nodes"), F.sum(F.size(F.coalesce("edge_src", F.array().cast("array<bigint>")))).cast("bigint").alias("n_edges")).where("n_examples > 0")
        out = one.select(F.lit(split).alias("split"), "*") if out is None else out.unionByName(one.select(F.lit(split).alias("split"), "*"))
    return out


# ---- text sources


_FLAT = "translate(coalesce(text, ''), chr(9)||chr(10)||chr(13), '___')"


def _flat() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), "\t\n\r", "___")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, md5({_FLAT}) AS source, md5(coalesce(lang, '')) AS target FROM documents")
def pairs_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two TSV files of one id column, joined on it."""
    docs = table(spark, sf_dir, "documents")
    left, right = scratch(spark, "pairs"), scratch(spark, "pairs")
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), _flat()).alias("value")).write.text(left)
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit(""))).alias("value")).write.text(right)
    return S.read_pairs(spark, left, right).select("id", F.md5("source").alias("source"), F.md5("target").alias("target"))


#: Of the documents table, as it lies, for each part that a language's texts are dealt to. A part is read as one row.
_PACKED_BYTES = 16 << 20


@query(f"SELECT lang, count(*) AS n, sum({_HEAD.format(_FLAT)})::BIGINT AS texts FROM documents GROUP BY lang")
def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in gzip files by language, unpacked as archives. A language has a file for every _PACKED_BYTES of the table."""
    path = scratch(spark, "packed")
    docs = table(spark, sf_dir, "documents")
    parts = 1 + table_bytes(docs) // _PACKED_BYTES
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4 * parts))
    docs.select("lang", _flat().alias("value"), part.alias("part")).repartition(parts, "lang", "part").drop("part").write.partitionBy("lang").option("compression", "gzip").text(path)
    got = S.read_archives(spark, f"{path}/lang=*").select(F.regexp_extract("archive", "lang=([^/]*)/", 1).alias("lang"), F.explode(F.split(F.regexp_replace(F.col("content").cast("string"), "\n$", ""), "\n", -1)).alias("line"))
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(_head(F.col("line"))).alias("texts"))


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS id, string_split(w[1], ',')[1] || array_to_string(w[2:], '') AS label FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM benchmark)")
def continued_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as a dictionary file whose words break its lines, read block by block."""
    rows = B.running_starts(table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit(1).alias("one")), "item_id", "one", "id")
    line = F.concat_ws(",", F.col("id").cast("string"), F.replace("text", F.lit(" "), F.lit("\n")))
    path = scratch(spark, "continued")
    # One file, as a dictionary is; the header comes before id 0.
    rows.select("id", line.alias("value")).unionByName(spark.createDataFrame([(-1, "id,label")], "id long, value string")).orderBy("id").coalesce(1).select("value").write.text(path)
    return S.read_continued(spark, path)


@query("SELECT conv_id * 1000 + turn AS idx, md5(translate(text, chr(9)||chr(10)||chr(13), '   ')) AS first, md5(role) AS second, md5(role) AS target FROM conversations")
def predictions_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as beams of two and their roles as targets, in the line-aligned files of an evaluation."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), T.words(F.translate("text", "\t\n\r", "   ")).alias("w"), "role", F.lit(1).alias("one"))
    rows = B.running_starts(turns, "key", "one", "idx").select("key", "idx", F.array("w", F.array("role")).alias("beam"), F.array("role").alias("target"), F.lit(0.5).alias("score"), F.lit("t").alias("provenance"))
    path = scratch(spark, "evaluation")
    W.write_evaluation(rows, path)
    got = S.read_predictions(spark, f"{path}/predictions", f"{path}/targets")
    said = rows.select("idx", F.col("key"))
    return got.join(said, "idx").select(F.col("key").alias("idx"), F.md5(F.get("beam", F.lit(0))).alias("first"), F.md5(F.get("beam", F.lit(1))).alias("second"), F.md5("target").alias("target"))


@query("SELECT kind, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation, (VALUES ('array'), ('lines')) k(kind)")
def json_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a file with one JSON array and as JSON lines."""
    rows = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    lines, array = scratch(spark, "lines"), scratch(spark, "array")
    rows.write.json(lines)
    rows.coalesce(1).agg(F.to_json(F.collect_list(F.struct("n_name", "n_regionkey"))).alias("value")).write.text(array)  # 25 rows
    schema = "n_name string, n_regionkey bigint"
    both = S.read_json_lines(spark, lines, schema).withColumn("kind", F.lit("lines")).unionByName(S.read_json_array(spark, array, schema).withColumn("kind", F.lit("array")))
    return both.select("kind", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


@query("SELECT c_custkey AS key, len(string_split(c_name, '#')) AS n_name, 3::BIGINT AS n_ast, md5(c_mktsegment) AS segment FROM customer")
def paths_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of AST paths."""
    bar = lambda c: F.replace(c, F.lit("#"), F.lit("|"))
    field = F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit("A|B|C"), F.translate("c_mktsegment", " ,|", "___"))
    path = scratch(spark, "paths")
    table(spark, sf_dir, "customer").select(F.concat_ws(" ", F.translate(bar(F.col("c_name")), " ,", "__"), field, F.lit(""), F.lit("two,fields")).alias("value")).write.text(path)
    p = F.get("paths", F.lit(0))
    return S.read_paths(spark, path).where("size(paths) = 1").select(F.get(p["start"], F.lit(0)).cast("bigint").alias("key"), F.size("name").cast("bigint").alias("n_name"), F.size(p["ast"]).cast("bigint").alias("n_ast"), F.md5(F.get(p["end"], F.lit(0))).alias("segment"))


@query("SELECT step, split, metric, value FROM (SELECT 1::BIGINT AS step, o_orderstatus AS split, 'rows' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 2 UNION ALL SELECT 2, o_orderstatus, 'total', round(sum(o_totalprice), 2) FROM orders GROUP BY 2)")
def measurements_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of measurements that two steps append to."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("split"))
    path = scratch(spark, "measurements")
    for step, metric, value in ((1, "rows", F.count(F.lit(1)).cast("double")), (2, "total", F.sum("o_totalprice"))):
        W.append_measurements(orders.agg(value.cast("double").alias("value")).select(F.lit(step).cast("long").alias("step"), "split", F.lit(metric).alias("metric"), "value"), path)
    return spark.read.parquet(path).select("step", "split", "metric", F.when(F.col("metric") == "total", F.round("value", 2)).otherwise(F.col("value")).alias("value"))


@query("SELECT shard, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id % 4 AS shard, doc_id FROM documents) WHERE shard <> 2 GROUP BY shard")
def shards_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a result by name, of which one is not there yet."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id"), scratch(spark, "shards")
    for k in (0, 1, 3):
        W.write_shard(docs.where(F.col("doc_id") % 4 == k), path, "docs", k, 4)
    done = [k for k in range(4) if k not in W.shards_to_do(spark, path, "docs", 4)]
    out = None
    for k in done:
        one = spark.read.parquet(f"{path}/{W.shard_name('docs', k, 4)}").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(k).cast("bigint").alias("shard"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'n' || n_nationkey AS prefix, n_name AS left, CAST(n_regionkey AS VARCHAR) AS right FROM nation")
def file_pairs_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with two files a nation, joined by the beginnings of their names."""
    def files(batches):
        import pyarrow as pa

        from graphprep.sources.files import system_of

        system, folder = system_of(path)
        for b in batches:
            for r in b.to_pylist():
                for end, value in (("_name.txt", r["n_name"]), ("_region.txt", str(r["n_regionkey"]))):
                    with system.open_output_stream(f"{folder}/n{r['n_nationkey']}{end}") as f:
                        f.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([2 * b.num_rows])], names=["n"])

    path = scratch(spark, "file-pairs")
    spark.createDataFrame([], "value string").write.text(path)  # the folder
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").mapInArrow(files, "n long").agg(F.sum("n")).collect()
    return S.read_file_pairs(spark, f"{path}/n*", "_name.txt", "_region.txt")
