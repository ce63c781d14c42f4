"""Decoding with the state that a model reads: what was chosen as text and id, and which nodes could be copied for it.

States are rows (example_id, step, head, choice, text, token_id, copies, done). A token's text comes from the vocabulary, a copied
node's from the node; a pointer has none. copies are all nodes of the example whose text is the chosen one: by an inverted index of
node texts, since node ids can stand for several subtokens or for none of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.schema import DONE, OOV_ID

STATE = ["example_id", "step", "head", "choice", "text", "token_id", "copies", "done"]


def text_index(features: DataFrame) -> DataFrame:
    """Rows (example_id, text, nodes): where each text stands among an example's nodes, ascending."""
    each = features.select("example_id", F.posexplode_outer("node_texts").alias("node", "text")).where("text is not null")
    return each.groupBy("example_id", "text").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def chosen_text(choices: DataFrame, features: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add text to rows (example_id, head, choice). An id that the vocabulary does not have is an error."""
    own = vocab.where("kind = 'output_token'").select(F.col("id").alias("choice"), F.col("token").alias("_token"))  # bounded by its size parameter
    found = choices.join(features.select("example_id", "node_texts"), "example_id").join(F.broadcast(own), "choice", "left")
    unknown = F.raise_error(F.concat(F.lit("no token has the id "), F.col("choice").cast("string"))).cast("string")
    text = F.when(F.col("head") == "token", F.coalesce("_token", unknown)).when(F.col("head") == "copy", F.get("node_texts", F.col("choice")))
    return found.withColumn("text", text).drop("_token", "node_texts")


def next_states(choices: DataFrame, features: DataFrame, index: DataFrame, vocab: DataFrame) -> DataFrame:
    """States of the choices (example_id, step, head, choice): text, its id in the output vocabulary, what could be copied, and whether it
    ends the output."""
    own = vocab.where("kind = 'output_token'").select(F.col("token").alias("text"), F.col("id").alias("_id"))
    found = chosen_text(choices, features, vocab).join(F.broadcast(own), "text", "left").join(index, ["example_id", "text"], "left")
    done = (F.col("head") != "pointer") & (F.col("text") == DONE)
    return found.withColumns({"token_id": F.coalesce("_id", F.lit(OOV_ID)), "copies": F.coalesce("nodes", F.array().cast("array<int>")), "done": F.coalesce(done, F.lit(False))}).select(*STATE)


def decode(features: DataFrame, vocab: DataFrame, choose: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """All states of all examples, step 0 before anything is chosen, until DONE or `most` steps.

    choose(states) takes the states that are not done and gives (example_id, head, choice), a row for each: a model's next output. Steps are
    few and known, so the whole is one plan; each joins the index once, which is partitioned by example as the states are.
    """
    index = text_index(features)
    none = F.lit(None).cast("string")
    now = features.select("example_id", F.lit(0).alias("step"), none.alias("head"), F.lit(None).cast("int").alias("choice"), none.alias("text"), F.lit(OOV_ID).alias("token_id"), F.array().cast("array<int>").alias("copies"), F.lit(False).alias("done"))
    every = now
    for step in range(1, most + 1):
        made = choose(now.where("not done")).select("example_id", F.lit(step).alias("step"), "head", F.col("choice").cast("int").alias("choice"))
        now = next_states(made, features, index, vocab)
        every = every.unionByName(now)
    return every


def outputs(states: DataFrame, with_labels: bool = False, features: DataFrame | None = None) -> DataFrame:
    """Rows (example_id, said): what was chosen as words, up to DONE: texts as they are, POINTER(id), or POINTER(id,label)."""
    rows = states.where("step > 0 and not done")
    if with_labels:
        rows = rows.join(features.select("example_id", "node_texts"), "example_id")
        at = F.concat(F.lit("POINTER("), F.col("choice").cast("string"), F.lit(","), F.get("node_texts", F.col("choice")), F.lit(")"))
    else:
        at = F.concat(F.lit("POINTER("), F.col("choice").cast("string"), F.lit(")"))
    rows = rows.withColumn("word", F.when(F.col("head") == "pointer", at).otherwise(F.col("text")))
    held = rows.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("step", "word"))).alias("x"))  # `most` steps
    return held.select("example_id", F.array_join("x.word", " ").alias("said"))
