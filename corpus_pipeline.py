"""The corpus pipeline: toxicity filter, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.llm.common import discard, materialize, written
from graphprep.llm.linededup import dedup_lines
from graphprep.llm.neardup_texts import drop_near_duplicates
from graphprep.llm.packing import WINDOW, pack
from graphprep.llm.pii import replace_entities
from graphprep.llm.queries import TOXICITY_LABELS, surrogate_key, toxicity_labels
from graphprep.llm.toxicity import fit, predict
from graphprep.llm.wordbpe import token_pieces


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go. The chain is fitted on the labelled ones among docs."""
    chain = fit(docs, toxicity_labels(spark, sf_dir), list(TOXICITY_LABELS))
    return predict(docs, chain).where("not is_toxic").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more found in three documents or more stay in the largest doc_id only."""
    return _counted(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies (Jaccard index of five-word shingles 0.8 or more) the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates."""
    return _counted(replace_entities(docs, surrogate_key(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 2048."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        pieces = token_pieces(docs, f.read(), WINDOW, with_ids=False)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read by the next; what a stage has left besides goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written(spark)
        made = stage(spark, docs, sf_dir)
        left = written(spark) - before
        docs = materialize(made, f"pipeline-{name}")
        discard(spark, left)
    return STAGES[-1][1](spark, docs, sf_dir)
