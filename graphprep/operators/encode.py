"""Vocabularies, integer encoding, copy and pointer pairs, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphprep.functions.text import linearise
from graphprep.schema import OOV_ID, RESERVED


def token_counts(examples: DataFrame) -> DataFrame:
    """Rows (kind, token, cnt) over node types, node labels, edge types and output words, in one pass."""
    every = F.concat(
        F.transform("nodes.type", lambda t: F.struct(F.lit("node_type").alias("kind"), t.alias("token"))),
        F.transform("nodes.label", lambda t: F.struct(F.lit("node_label").alias("kind"), t.alias("token"))),
        F.transform("edges.type", lambda t: F.struct(F.lit("edge_type").alias("kind"), t.alias("token"))),
        F.transform(linearise(F.col("output")), lambda t: F.struct(F.lit("output_token").alias("kind"), t.alias("token"))),
    )
    return examples.select(F.explode(every).alias("x")).groupBy("x.kind", "x.token").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(counts: DataFrame, most: int) -> DataFrame:
    """Rows (kind, token, id): reserved tokens first, then the most frequent; ties by token. most counts the reserved ones."""
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cnt"), "token"))
    # The bare rank is what is filtered, so that each task keeps its best rows before they meet.
    best = counts.where(~F.col("token").isin(*RESERVED)).withColumn("_rank", rank).where(F.col("_rank") <= most - len(RESERVED))
    ranked = best.withColumn("id", (F.col("_rank") + len(RESERVED) - 1).cast("int"))
    fixed = counts.select("kind").distinct().select("kind", F.posexplode(F.array(*map(F.lit, RESERVED))).alias("id", "token"))
    return ranked.select("kind", "token", "id").unionByName(fixed.select("kind", "token", "id"))


def lookup(tokens: DataFrame, vocab: DataFrame, kind: str, column: str = "token") -> DataFrame:
    """Add id to long-form rows; OOV where the vocabulary has none. A vocabulary is bounded by its size parameter."""
    own = vocab.where(F.col("kind") == kind).select(F.col("token").alias(column), "id")
    return tokens.join(F.broadcast(own), column, "left").withColumn("id", F.coalesce("id", F.lit(OOV_ID)))


def copy_pairs(output: Column, labels: Column) -> Column:
    """Structs (output, node) of each output token and each node with the same label, by output, then node. Stays in the row."""

    def found(names: Column) -> Column:
        at = lambda o: F.filter(F.transform(names, lambda x, j: F.when((o["kind"] == "token") & (x == o["token"]), j)), lambda j: j.isNotNull())
        return F.flatten(F.transform(output, lambda o, i: F.transform(at(o), lambda j: F.struct(i.alias("output"), j.alias("node")))))

    return once(labels, found)


def copy_pairs_joined(examples: DataFrame, key: str) -> DataFrame:
    """Rows (key, output, node): what copy_pairs() finds, by a hash join on (key, token); better where outputs are long."""
    out = examples.select(key, F.posexplode_outer("output").alias("output", "o")).where("o.kind = 'token'").select(key, "output", F.col("o.token").alias("token"))
    labels = examples.select(key, F.posexplode_outer("nodes.label").alias("node", "token"))
    return out.join(labels, [key, "token"]).select(key, "output", "node")


def copy_pairs_of_words(rows: DataFrame, key: str, output: Column, words: Column) -> DataFrame:
    """Rows (key, output, node) of equal words of an output and of the nodes, before either is made an example: escaping keeps
    different words different, so that raw ones can be compared."""
    out = rows.select(key, F.posexplode_outer(output).alias("output", "token")).where("token is not null")
    nodes = rows.select(key, F.posexplode_outer(words).alias("node", "token")).where("token is not null")
    return out.join(nodes, [key, "token"]).select(key, "output", "node")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda an outer expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pointer_pairs(output: Column) -> Column:
    found = F.transform(output, lambda o, i: F.struct(i.alias("output"), o["pointer"].alias("node")))
    return F.filter(found, lambda x: x["node"].isNotNull())


def is_possible(ids: Column, copyable: Column) -> Column:
    """Whether every output is in the vocabulary or can be copied."""
    return ~F.exists(F.transform(ids, lambda x, i: (x == OOV_ID) & ~F.array_contains(copyable, i)), lambda bad: bad)


def pad(values: Column, size: int, filler: object) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def mask(at: Column, n: Column) -> Column:
    """1 at the given places among n, else 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(at, i).cast("int"))).otherwise(F.array().cast("array<int>"))
