"""The supplied tables as examples: which table stands in for which raw source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions.text import label_class, pointer, token, words
from graphprep.operators.builders import chain_examples
from graphprep.operators.rules import split_of



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_bytes(rows: DataFrame) -> int:
    """The optimizer's estimate; of a table as it lies, the bytes of its files."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Of a table, as it lies, for each four shards of a split that it is written to. A task writes a shard.
_FOUR_SHARDS_BYTES = 64 << 20


def shards_of(rows: DataFrame) -> int:
    """Shards of a split for the rows of a table: four, and four more for every _FOUR_SHARDS_BYTES, so that none grows with the table."""
    return 4 * (1 + table_bytes(rows) // _FOUR_SHARDS_BYTES)


#: Below so many bytes a core, by the optimizer's estimate, a table may lie in fewer pieces than there are cores, or in a few more, so
#: that most cores wait for the last ones; and of a piece that it is dealt to.
_SPREAD_BYTES, _PIECE_BYTES = 128 << 20, 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a small table dealt to all cores by the first column: a file with one row group is read by one task, and what
    follows would stay there. Large tables come in many pieces and stay as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    size = table_bytes(rows)
    return rows.repartition(max(n, size // _PIECE_BYTES), rows.columns[0]) if size < n * _SPREAD_BYTES else rows


def document_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as token chains. Output: the words of the text's last line as tokens, and the source as class."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).withColumn("split", split_of(F.col("doc_id")))
    last = F.transform(words(F.element_at(F.split("text", "\n", -1), -1)), token)
    out = F.concat(last, F.array(label_class(F.col("source"))))
    return chain_examples(docs, words(F.col("text")), out).drop("text")


def pointed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as token chains with a pointer to the middle word and the first word as token."""
    items = table(spark, sf_dir, "benchmark").withColumn("_w", words(F.col("text")))
    out = F.array(pointer(F.floor(F.size("_w") / 2)), token(F.element_at("_w", 1)))
    return chain_examples(items, F.col("_w"), out).drop("_w")
