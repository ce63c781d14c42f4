"""Numeric kernels on long-form rows and arrays of doubles: what a graph model computes, as joins and aggregates.

Dense layers, recurrent updates and training belong to a numeric library that takes the batches; here is what has the shape of
a query: messages along edges, attention over allowed pairs, embeddings, output choices and scores.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprep.schema import OOV_ID, PAD_ID

#: Stands for a score that is not to be chosen.
NEVER = -1e9


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def log_sum_exp(a: Column) -> Column:
    """Of an array that has an entry, without overflow."""
    most = F.array_max(a)
    return F.log(F.aggregate(F.zip_with(a, F.array_repeat(most, F.size(a)), lambda x, m: F.exp(x - m)), F.lit(0.0), lambda s, v: s + v)) + most


def row_times(x: Column, w: Column) -> Column:
    """The vector x times a matrix given by its rows."""
    scaled = F.zip_with(w, x, lambda r, v: F.transform(r, lambda c: c * v))
    return F.aggregate(F.slice(scaled, F.lit(2), F.greatest(F.size(scaled) - 1, F.lit(0))), F.element_at(scaled, 1), add)


def sum_vectors(rows: DataFrame, by: list[str], vector: str, out: str) -> DataFrame:
    """Sum of vectors by group, and how many there are (n). Groups are summed place by place before they meet, so none is held."""
    long = rows.select(*by, F.posexplode(vector).alias("_i", "_x"))
    sums = long.groupBy(*by, "_i").agg(F.sum("_x").alias("_x"), F.count(F.lit(1)).alias("_n"))
    held = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"), F.max("_n").alias("n"))
    return held.select(*by, F.col("_v._x").alias(out), "n")


def typed_messages(edges: DataFrame, states: DataFrame, kernels: DataFrame) -> DataFrame:
    """Rows (node, message) of nodes with edges (src, dst, type) that come in: over the types, the sum of the senders' states
    (node, h) times the type's kernel, plus the number of edges times its bias. kernels (type, w, b) has a row for each type."""
    sent = edges.join(states.select(F.col("node").alias("src"), "h"), "src")
    sums = sum_vectors(sent, ["dst", "type"], "h", "h").join(F.broadcast(kernels), "type")  # a kernel for each edge type
    part = add(row_times(F.col("h"), F.col("w")), F.transform("b", lambda v: v * F.col("n")))
    return sum_vectors(sums.select("dst", part.alias("m")), ["dst"], "m", "message").select(F.col("dst").alias("node"), "message")


def attend(pairs: DataFrame, queries: DataFrame, keys: DataFrame, values: DataFrame, heads: int = 1) -> DataFrame:
    """Rows (query, h): for each head the mean of the values of the pairs' keys, weighted by softmax of scaled products.

    pairs (query, key) is the mask: what is not in it is not seen, and a query without pairs gets no row. Its column bias, if
    there is one, leans the score of a pair by bias times the sum of the key. queries, keys and values are rows (node, h).
    """
    biased = "bias" in pairs.columns
    named = lambda rows, n, c: rows.select(F.col("node").alias(n), F.col("h").alias(c))
    rows = pairs.select("query", "key", *(["bias"] if biased else [])).join(named(queries, "query", "_q"), "query").join(named(keys, "key", "_k"), "key").join(named(values, "key", "_v"), "key")
    size = F.size("_q") / heads
    cut = lambda c, i: F.slice(c, (i * size + 1).cast("int"), size.cast("int"))

    def score(i: Column) -> Column:
        s = dot(cut(F.col("_q"), i), cut(F.col("_k"), i)) / F.sqrt(size)
        return s + total(cut(F.col("_k"), i)) * F.col("bias") if biased else s

    each = rows.select("query", F.explode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda i: F.struct(i.alias("head"), score(i).alias("s"), cut(F.col("_v"), i).alias("v")))).alias("x")).select("query", "x.*")
    most = each.groupBy("query", "head").agg(F.max("s").alias("m"))
    scaled = each.join(most, ["query", "head"]).withColumn("e", F.exp(F.col("s") - F.col("m")))
    mass = scaled.groupBy("query", "head").agg(F.sum("e").alias("z"))
    mixed = sum_vectors(scaled.select("query", "head", F.transform("v", lambda v: v * F.col("e")).alias("v")), ["query", "head"], "v", "v").join(mass, ["query", "head"])
    held = mixed.select("query", "head", F.transform("v", lambda v: v / F.col("z")).alias("v")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("head", "v"))).alias("h"))
    return held.select("query", F.flatten("h.v").alias("h"))


def mean_of(vectors: Column) -> Column:
    """Mean of an array of subtoken vectors, with a little in the denominator as for nodes that have none."""
    s = F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), F.element_at(vectors, 1), add)
    return F.transform(s, lambda v: v / (F.size(vectors) + 1e-5))


def place_encoding(place: Column, longest: int, size: int) -> Column:
    """Sines, then cosines, of a place from 0 at size / 2 wavelengths up to `longest`; of an absent place (null or negative) zeros."""
    half = F.sequence(F.lit(0), F.lit(size // 2 - 1))
    angle = lambda i: 2 * pi * (place + 1) / F.pow(F.lit(float(longest)), i * 2.0 / size)
    found = F.concat(F.transform(half, lambda i: F.sin(angle(i))), F.transform(half, lambda i: F.cos(angle(i))))
    return F.when(place >= 0, found).otherwise(F.array_repeat(F.lit(0.0), size))


def only(scores: Column, candidates: Column) -> Column:
    """Scores with those of other places than the candidates ruled out."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(candidates, i), s).otherwise(F.lit(NEVER)))


def output_logprob(tokens: Column, copies: Column, pointers: Column, token_id: Column, copy_at: Column, pointer_at: Column, oov: int = OOV_ID, pad: int = PAD_ID) -> Column:
    """Log probability of the wanted output under one softmax over all three heads' scores.

    The token counts unless it is out of the vocabulary or a pointer is wanted; copies count from the places copy_at, pointers
    to the places pointer_at. Padding has log probability 0.
    """
    own = F.when((F.size(pointer_at) == 0) & (token_id != oov), F.array(F.get(tokens, token_id))).otherwise(F.array().cast("array<double>"))
    at = lambda scores, places: F.transform(places, lambda i: F.get(scores, i))
    ways = F.concat(own, at(copies, copy_at), at(pointers, pointer_at))
    found = F.when(F.size(ways) > 0, log_sum_exp(ways)).otherwise(F.lit(NEVER)) - log_sum_exp(F.concat(tokens, copies, pointers))
    return F.when(token_id == pad, 0.0).otherwise(found)


def choose(tokens: Column, copies: Column, pointers: Column, noise: Column | None = None) -> Column:
    """The likeliest choice as a struct (head, choice), the first of equals. noise, an array over all scores, makes it a sample."""
    every = F.concat(tokens, copies, pointers)
    scores = every if noise is None else add(every, noise)
    k = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    t, c = F.size(tokens), F.size(copies)
    head = F.when(k < t, "token").when(k < t + c, "copy").otherwise("pointer")
    return F.struct(head.alias("head"), F.when(k < t, k).when(k < t + c, k - t).otherwise(k - t - c).alias("choice"))


def gumbel(n: Column, temperature: float, seed: int, *key: Column) -> Column:
    """Noise by hash of (seed, key, place) that turns the likeliest choice into a draw from the softmax at a temperature."""
    uniform = lambda i: (F.pmod(F.xxhash64(F.lit(seed), *key, i), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: -F.log(-F.log(uniform(i))) * temperature)


def sequence_scores(steps: DataFrame) -> DataFrame:
    """Rows (seq, score, n_steps) of rows (seq, step, logprob, done): the sum up to and with the first step that is done."""
    end = steps.where("done").groupBy("seq").agg(F.min("step").alias("_end"))
    kept = steps.join(end, "seq", "left").where(F.col("_end").isNull() | (F.col("step") <= F.col("_end")))
    return kept.groupBy("seq").agg(F.sum("logprob").alias("score"), F.count(F.lit(1)).alias("n_steps"))


def decode_loop(start: DataFrame, advance: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """All states of sequences (seq, at, step, done) that advance() moves on until they are done or have made `most` steps.

    A loop on the driver with all sequences in each step; steps are few and known, so the whole is one plan.
    """
    now = start.select("seq", "at", "step", "done")
    every = now
    for _ in range(most):
        now = advance(now.where("not done"))
        every = every.unionByName(now)
    return every
