"""Prediction metrics as row expressions and aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprep.functions.text import safe_ratio


def compared(preds: Column, targets: Column, most: int = 1) -> Column:
    """What each array of tokens in preds has in common with an array: a struct (tp, fp, fn, hits) for each, null where preds or targets is null.

    tp and fp count predicted tokens that are, and are not, among the target's; fn target tokens that are not predicted; repeats count.
    hits[n - 1] is the number of n-grams that both have, each at most as often as either, for n up to `most`. targets has an array for
    each of preds. A null among tokens is a border: it counts as no token and no n-gram goes over it. Tokens become numbers batch by batch and are sorted: n log n in the tokens, in Python, without a shuffle.
    """
    def run(preds: pa.Array, targets: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        if len(preds) == 0:
            return pa.array([], kind)
        none = pc.or_(pc.is_null(preds), pc.is_null(targets))
        sides = [pc.if_else(none, pa.scalar(None, x.type), x) for x in (preds, targets)]
        places = pc.fill_null(pc.list_value_length(sides[0]), 0).to_numpy()
        if (places != pc.fill_null(pc.list_value_length(sides[1]), 0).to_numpy()).any():
            raise ValueError("a target is wanted for each prediction")
        lists = [x.flatten() for x in sides]
        sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]).astype(np.int64)
        pairs = len(lists[0])
        tokens = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        codes, wide = pc.fill_null(tokens.indices, -1).to_numpy().astype(np.int64), len(tokens.dictionary) + 1
        owner = np.repeat(np.arange(2 * pairs), sizes)  # the predictions, then the targets
        ends = np.cumsum(sizes)[owner]
        at = np.arange(len(codes))
        grams, found = (owner % max(pairs, 1)) * wide, {}
        for n in range(1, most + 1):
            at = at[at + n <= ends[at]]
            at = at[codes[at + n - 1] >= 0]
            keys = grams[at] + codes[at + n - 1]
            kinds, first, number = np.unique(keys, return_index=True, return_inverse=True)
            pair = owner[at] % max(pairs, 1)
            mine = owner[at] < pairs
            a, b = (np.bincount(number[m], minlength=len(kinds)) for m in (mine, ~mine))
            of = pair[first]
            count = lambda x: np.bincount(of, weights=x, minlength=pairs).astype(np.int64)  # noqa: B023, E731
            if n == 1:
                found |= {"tp": count(np.where(b > 0, a, 0)), "fp": count(np.where(b > 0, 0, a)), "fn": count(np.where(a > 0, 0, b))}
            found[n] = count(np.minimum(a, b))
            # The next n-gram is this one's number, which tells the pair as well, and a token more.
            grams = np.zeros(len(codes), np.int64)
            grams[at] = number * wide
        hits = np.stack([found[n] for n in range(1, most + 1)], 1).ravel()
        arrays = [pa.array(found[k].astype(np.int32)) for k in ("tp", "fp", "fn")]
        arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(pairs + 1, dtype=np.int32) * most), pa.array(hits.astype(np.int32))))
        each = pa.StructArray.from_arrays(arrays, names=["tp", "fp", "fn", "hits"])
        starts = pa.array(np.r_[0, np.cumsum(places)].astype(np.int32), mask=np.r_[none.to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(starts, each)

    kind = pa.list_(pa.struct([("tp", pa.int32()), ("fp", pa.int32()), ("fn", pa.int32()), ("hits", pa.list_(pa.int32()))]))
    return F.arrow_udf(run, "array<struct<tp:int,fp:int,fn:int,hits:array<int>>>")(preds, targets)


def overlap(pred: Column, target: Column) -> tuple[Column, Column, Column]:
    """True positives and false positives by predicted token (repeats count), false negatives by target token."""
    found = F.element_at(compared(F.array(pred), F.array(target)), 1)
    return found["tp"], found["fp"], found["fn"]


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return p, r, safe_ratio(2 * p * r, p + r)


def matches(pred: Column, target: Column) -> Column:
    """Place by place, false beyond the end of the shorter."""
    return F.zip_with(pred, target, lambda a, b: F.coalesce(a == b, F.lit(False)))


def runs(flags: Column) -> tuple[Column, Column]:
    """Longest run of true, and the expected length of correct tokens: over runs of true the sum of (n + 1) / 2 * n / size."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("twice"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x, s["now"] + 1).otherwise(0)
        # n * (n + 1) grows by 2 * n when a run comes to n.
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"), (s["twice"] + 2 * now).alias("twice"))

    done = F.aggregate(flags, start, step)
    return done["best"], safe_ratio(done["twice"], 2 * F.size(flags))


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def joined(lists: Column) -> Column:
    """Arrays of tokens as one, a border (null) behind each."""
    return F.flatten(F.transform(lists, lambda x: F.concat(x, F.array(F.lit(None).cast("string")))))


def gram_count(lists: Column, n: int) -> Column:
    """N-grams of arrays of tokens."""
    return F.aggregate(lists, F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(F.size(x) - (n - 1), F.lit(0)))


def clipped_counts(pairs: DataFrame, key: list[str], pred: str, target: str, most: int = 4) -> DataFrame:
    """Rows (n, hits, total): clipped n-gram hits and n-grams of the predictions over all pairs, for n up to `most`.

    An n-gram's hits are clipped to its number in the target of the same row; rows of one key count as one. Rows meet by their key; n-grams
    are counted where these lie.
    """
    rows = pairs.groupBy(*key).agg(F.collect_list(pred).alias("_p"), F.collect_list(target).alias("_t"))
    p, t = F.col("_p"), F.col("_t")
    hits = F.element_at(compared(F.array(joined(p)), F.array(joined(t)), most), 1)["hits"]
    grams = lambda c: F.array(*[gram_count(c, n) for n in range(1, most + 1)])
    each = rows.select(hits.alias("hits"), grams(p).alias("total"), grams(t).alias("wanted"))
    sums = each.agg(*[F.sum(F.col(c)[n]).cast("bigint").alias(f"{c}_{n}") for c in ("hits", "total", "wanted") for n in range(most)])
    cells = F.array(*[F.struct(F.lit(n + 1).alias("n"), *[F.col(f"{c}_{n}").alias(c) for c in ("hits", "total", "wanted")]) for n in range(most)])
    return sums.select(F.inline(cells)).where("total + wanted > 0").select("n", "hits", "total")


def bootstrap_bounds(b: int, ci: int) -> tuple[int, int]:
    """Places (from 0) of the lower and upper bound among b sorted values."""
    return b * (100 - ci) // 100, -(-b * ci // 100) - 1
