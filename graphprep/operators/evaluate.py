"""Metric sets over predictions: rows (idx, beam, target), beam an array of texts, best first.

A set (MetricSet) is numbers of each row, and values of their sums. Called with a DataFrame and grouping columns (none: one result
over all) it gives rows (..., metric, value). Since only sums count, a sample is the same numbers with other weights: bootstrap() and
bootstrap_in_blocks() judge each row once, whatever the number of samples. What a set cannot judge (a target that is not of its form,
several beams where it takes one) is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.functions.text import bleu_tokens, parse_error_location, parse_pointer, remove_prefix, safe_ratio, strip, words
from graphprep.operators.encode import once
from graphprep.operators.metrics import bootstrap_bounds, compared, gram_count, joined, matches, overlap, prf, runs
from graphprep.schema import CLASS_PREFIX, RESERVED

Metrics = Callable[..., DataFrame]
#: Stands for a precision of zero inside a logarithm: the smallest normal double.
TINY = 2.2250738585072014e-308


def _one_beam() -> Column:
    return F.when(F.size("beam") == 1, F.element_at("beam", 1)).otherwise(F.raise_error(F.lit("one prediction is wanted for each target")))


def _metrics(rows: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row for each value of one aggregate row."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])
    return rows.select(*by, F.explode(cells).alias("x")).select(*by, "x.metric", "x.value")


def _sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


class MetricSet:
    """counts(pred, keys, **options) gives rows of the keys and of numbers; values(**options) makes metrics of the numbers' sums,
    by their names. A metric that is null does not occur."""

    def __init__(self, counts: Callable[..., DataFrame], values: Callable[..., dict[str, Column]]) -> None:
        self.counts, self.values, self.__doc__ = counts, values, counts.__doc__

    def __call__(self, pred: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
        keys = [*by, *(["idx"] if "idx" in pred.columns and "idx" not in by else [])]
        rows = self.counts(pred, keys, **options)
        sums = rows.groupBy(*by).agg(*[_sum(c).alias(c) for c in rows.columns if c not in keys])
        return _metrics(sums, by, self.values(**options)).where("value is not null")


def _token_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 over all tokens of the set. Reserved tokens in predictions don't count."""
    p = F.filter(words(_one_beam()), lambda t: ~t.isin(*RESERVED))
    rows = pred.withColumns({"_p": p, "_t": words(F.col("target"))})
    tp, fp, fn = overlap(F.col("_p"), F.col("_t"))
    return rows.select(*keys, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def _token_values() -> dict[str, Column]:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return {"precision": p, "recall": r, "f1_score": f}


token_prf = MetricSet(_token_counts, _token_values)


def _name_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of precision, recall and F1 by row, of the beam with the best F1 (the first of equals), and how often that beam is the target.

    Case counts for the exact match only; predicted tokens are a set.
    """
    low = lambda c: F.transform(words(c), F.lower)
    target = low(F.col("target"))
    found = compared(F.transform("beam", lambda b: F.array_distinct(low(b))), F.transform("beam", lambda _: target))

    def score(x: Column, i: Column) -> Column:
        p, r, f = prf(x["tp"], x["fp"], x["fn"])
        return F.struct(f.alias("f"), (-i).alias("i"), p.alias("p"), r.alias("r"), (F.get("beam", i) == F.col("target")).cast("int").alias("same"))

    best = F.array_max(F.transform("_x", score))
    rows = pred.withColumn("_x", found).withColumn("_b", best)
    return rows.select(*keys, F.lit(1).alias("n"), *[F.col(f"_b.{k}").alias(k) for k in ("p", "r", "f", "same")])


def _name_values() -> dict[str, Column]:
    return {name: safe_ratio(F.col(k), F.col("n")) for name, k in (("precision", "p"), ("recall", "r"), ("f1_score", "f"), ("exact_match_percentage", "same"))}


name_prf = MetricSet(_name_counts, _name_values)


def _bleu(hits: Sequence[Column], totals: Sequence[Column], guessed: Column, wanted: Column) -> Column:
    """Geometric mean of the clipped precisions and the brevity penalty; 0 where no word is right."""
    n = len(hits)
    logs = sum((F.log(F.greatest(h.cast("double"), F.lit(TINY)) / F.greatest(t, F.lit(1))) for h, t in zip(hits, totals, strict=True)), F.lit(0.0))
    short = F.when(guessed > wanted, 1.0).otherwise(F.exp(1 - wanted / F.greatest(guessed, F.lit(1))))
    return F.when(hits[0] == 0, 0.0).otherwise(short * F.exp(logs / n))


def _summary_counts(pred: DataFrame, keys: Sequence[str], top_n: int = 1, choose: int = 4) -> DataFrame:
    """BLEU-1 to BLEU-4 of the whole set, in per cent, of the beam place among the first top_n whose BLEU-`choose` is best.

    Of equal places the first counts. Rows of one idx count as one. N-grams are counted where their texts lie.
    """
    row = F.struct("beam", "target")
    met = pred.groupBy(*keys).agg(F.collect_list(row).alias("_rows")) if "idx" in keys else pred.select(*keys, F.array(row).alias("_rows"))
    sides = {}
    for r in range(top_n):
        there = F.filter("_rows", lambda x: F.size(x["beam"]) > r)  # noqa: B023
        sides[f"_p{r}"] = F.transform(there, lambda x: words(F.get(x["beam"], F.lit(r))))  # noqa: B023
        sides[f"_t{r}"] = F.transform(there, lambda x: words(x["target"]))
    met = met.select(*keys, *[c.alias(k) for k, c in sides.items()])
    found = compared(F.array(*[joined(F.col(f"_p{r}")) for r in range(top_n)]), F.array(*[joined(F.col(f"_t{r}")) for r in range(top_n)]), 4)
    met = met.withColumn("_x", found)
    places = [(r, n) for r in range(top_n) for n in range(1, 5)]
    hit = [F.col("_x")[r]["hits"][n - 1].alias(f"h_{r}_{n}") for r, n in places]
    tried = [gram_count(F.col(f"_p{r}"), n).alias(f"t_{r}_{n}") for r, n in places]
    long = [gram_count(F.col(f"_{c}{r}"), 1).alias(f"l{c}_{r}") for c in "pt" for r in range(top_n)]
    return met.select(*keys, *hit, *tried, *long)


def _summary_values(top_n: int = 1, choose: int = 4) -> dict[str, Column]:
    def place(r: int) -> Column:
        of = [100 * _bleu([F.col(f"h_{r}_{k}") for k in range(1, n + 1)], [F.col(f"t_{r}_{k}") for k in range(1, n + 1)], F.col(f"lp_{r}"), F.col(f"lt_{r}")) for n in range(1, 5)]
        return F.struct(of[choose - 1].alias("of"), F.lit(-r).alias("first"), *[c.alias(f"bleu_{n}") for n, c in enumerate(of, 1)])

    best = F.array_max(F.array(*[place(r) for r in range(top_n)]))
    return {f"bleu_{n}": F.when(best["of"] > 0, best[f"bleu_{n}"]).otherwise(0.0) for n in range(1, 5)}


summary_bleu = MetricSet(_summary_counts, _summary_values)


def _misuse_counts(pred: DataFrame, keys: Sequence[str], pointed: bool = True) -> DataFrame:
    """Whole outputs, place and repair, place alone, repair alone, and rows without a bug, of targets NO_BUG or a place and a repair."""
    form = F.rlike("target", F.lit(r"^POINTER\(" if pointed else r"^ERROR_LOCATION_"))
    target = F.when((F.col("target") == "NO_BUG") | form, F.col("target")).otherwise(F.raise_error(F.concat(F.lit("not a target of misused variables: "), "target")))
    rows = pred.select(*keys, _one_beam().alias("p"), target.alias("t"))
    bug, same = F.col("t") != "NO_BUG", F.col("p") == F.col("t")
    rest = lambda c: F.slice(words(F.col(c)), F.lit(2), F.greatest(F.size(words(F.col(c))) - 1, F.lit(0)))
    flags = {"bugs": bug, "same": same, "both": same & bug, "free": same & ~bug, "loc": bug & (F.element_at(words(F.col("p")), 1) == F.element_at(words(F.col("t")), 1)), "rep": bug & (rest("p") == rest("t"))}
    return rows.select(*keys, F.lit(1).alias("n"), *[_flag(c).alias(k) for k, c in flags.items()])


def _misuse_values(pointed: bool = True) -> dict[str, Column]:
    c = F.col
    return {"seq_acc": safe_ratio(c("same"), c("n")), "loc_and_rep_acc": safe_ratio(c("both"), c("bugs")), "bug_free_class_acc": safe_ratio(c("free"), c("n") - c("bugs")), "loc_acc": safe_ratio(c("loc"), c("bugs")), "rep_acc": safe_ratio(c("rep"), c("bugs"))}


misuse_accuracy = MetricSet(_misuse_counts, _misuse_values)
_EDITS = {"add_acc": "add_node", "rep_val_acc": "replace_val", "rep_type_acc": "replace_type", "del_acc": "del_node"}


def _edit_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of edits found by any beam, in all and by operation. Targets of other operations count in all and are never right."""
    op, hit = F.element_at(words(F.col("target")), 1), F.array_contains("beam", F.col("target"))
    cells = [x for name, o in _EDITS.items() for x in (_flag(op == o).alias(f"n_{name}"), _flag((op == o) & hit).alias(f"h_{name}"))]
    return pred.select(*keys, F.lit(1).alias("n"), _flag(op.isin(*_EDITS.values()) & hit).alias("h"), *cells)


def _edit_values() -> dict[str, Column]:
    return {"total_acc": safe_ratio(F.col("h"), F.col("n")), **{name: safe_ratio(F.col(f"h_{name}"), F.col(f"n_{name}")) for name in _EDITS}}


edit_accuracy = MetricSet(_edit_counts, _edit_values)


def _class_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of targets that any beam equals."""
    return pred.select(*keys, F.lit(1).alias("n"), _flag(F.array_contains("beam", F.col("target"))).alias("h"))


class_accuracy = MetricSet(_class_counts, lambda: {"class_acc": safe_ratio(F.col("h"), F.col("n"))})


def _known_counts(pred: DataFrame, keys: Sequence[str], classes: Sequence[str] = ()) -> DataFrame:
    """Accuracy over all, over each class that occurs, and the mean of these. Targets must carry CLASS_ and be of the known classes."""
    target = strip(F.col("target"))
    known = target.contains(CLASS_PREFIX) & remove_prefix(target, CLASS_PREFIX).isin(*classes)
    rows = pred.select(*keys, F.when(known, target).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), target))).alias("c"), (strip(_one_beam()) == target).cast("int").alias("ok"))
    own = [(i, remove_prefix(F.col("c"), CLASS_PREFIX) == c) for i, c in enumerate(classes)]
    return rows.select(*keys, *[_flag(o).alias(f"n_{i}") for i, o in own], *[F.when(o, F.col("ok")).otherwise(0).alias(f"h_{i}") for i, o in own], F.when(F.col("c").isNotNull(), 1).alias("n"), F.col("ok").alias("h"))


def _known_values(classes: Sequence[str] = ()) -> dict[str, Column]:
    ratios = [F.when(F.col(f"n_{i}") > 0, safe_ratio(F.col(f"h_{i}"), F.col(f"n_{i}"))) for i in range(len(classes))]
    there = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in ratios), F.lit(0))
    mean = safe_ratio(sum((F.coalesce(r, F.lit(0.0)) for r in ratios), F.lit(0.0)), there)
    return {"accuracy": safe_ratio(F.col("h"), F.col("n")), "mean_per_class_accuracy": mean, **{f"accuracy_{CLASS_PREFIX}{c}": r for c, r in zip(classes, ratios, strict=True)}}


known_class_accuracy = MetricSet(_known_counts, _known_values)


def _repair_counts(pred: DataFrame, keys: Sequence[str], parse: Callable[[Column], Column] = parse_pointer, raw_total: int = 0, raw_total_buggy: int = 0) -> DataFrame:
    """Classification, localisation and repair of misused variables; place 1 means free of bugs.

    A prediction that names no place is a syntax error and wrong in everything but whole equality, which it cannot reach
    either. raw_total and raw_total_buggy, both or none, give the shares of rows that were cut off before as well.
    """
    if bool(raw_total) != bool(raw_total_buggy):
        raise ValueError("raw_total and raw_total_buggy go together")
    p, t = strip(_one_beam()), strip(F.col("target"))
    rows = pred.select(*keys, p.alias("p"), t.alias("t")).withColumns({"a": parse(F.col("t")), "b": parse(F.col("p"))})
    rows = rows.withColumn("a", F.when(F.col("a").isNotNull(), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("not a target of repairs: "), "t"))))
    a, b, same = F.col("a"), F.col("b"), F.col("p") == F.col("t")
    bug, ok = b != 1, b.isNotNull()
    flags = {"buggy": a != 1, "bad": ~ok, "same": ok & same, "tp": bug & (a != 1), "true": ok & (bug == (a != 1)), "loc": bug & (a == b), "rep": bug & same}
    return rows.select(*keys, F.lit(1).alias("n"), *[_flag(c).alias(k) for k, c in flags.items()])


def _repair_values(parse: Callable[[Column], Column] = parse_pointer, raw_total: int = 0, raw_total_buggy: int = 0) -> dict[str, Column]:
    c = F.col
    out = {
        "total": c("n"), "total_buggy": c("buggy"), "true": safe_ratio(c("true"), c("n")), "sequence_accuracy": safe_ratio(c("same"), c("n")), "true_positive": safe_ratio(c("tp"), c("buggy")), "localized": safe_ratio(c("loc"), c("buggy")),
        "localized_and_repaired": safe_ratio(c("rep"), c("buggy")), "total_localized_but_not_repaired": c("loc") - c("rep"), "total_syntax_errors": c("bad"),
    }
    if raw_total:
        share = lambda k, n: safe_ratio(c(k), F.lit(n))
        out |= {"raw_true": share("true", raw_total), "raw_true_positive": share("tp", raw_total_buggy), "raw_localized": share("loc", raw_total_buggy), "raw_localized_and_repaired": share("rep", raw_total_buggy)}
    return out


repair_metrics = MetricSet(_repair_counts, _repair_values)


def sentence_bleu(pred: Column, target: Column) -> Column:
    """BLEU of two token arrays by n-grams up to 4, or as long as the shorter one is. Two empty ones are equal."""
    a, b = F.size(pred), F.size(target)
    most = F.greatest(F.least(F.lit(4), a, b), F.lit(1))
    found = F.element_at(compared(F.array(pred), F.array(target), 4), 1)["hits"]
    hits, totals = [found[n] for n in range(4)], [F.greatest(a - n + 1, F.lit(0)) for n in range(1, 5)]
    by_n = F.when(most == 1, _bleu(hits[:1], totals[:1], a, b)).when(most == 2, _bleu(hits[:2], totals[:2], a, b)).when(most == 3, _bleu(hits[:3], totals[:3], a, b)).otherwise(_bleu(hits, totals, a, b))
    return F.when((a == 0) & (b == 0), 1.0).when(a == 0, 0.0).otherwise(by_n)


def _completion_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means of the expected and the longest run of right tokens, of the beam with the best expectation, and BLEU of the first beam."""
    target = words(F.col("target"))

    def score(b: Column, i: Column) -> Column:
        def of(done: Column) -> Column:
            longest, expected = runs(done)
            return F.struct(expected.alias("e"), (-i).alias("i"), longest.alias("l"))

        return once(matches(words(b), target), of)

    best = F.array_max(F.transform("beam", score))
    rows = pred.withColumns({"_b": best, "_p": bleu_tokens(F.element_at("beam", 1)), "_t": bleu_tokens(F.col("target"))})
    return rows.select(*keys, F.lit(1).alias("n"), F.col("_b.e").alias("e"), F.col("_b.l").alias("l"), (100 * sentence_bleu(F.col("_p"), F.col("_t"))).alias("bleu"))


def _completion_values() -> dict[str, Column]:
    return {"average_expected_successive_tokens": safe_ratio(F.col("e"), F.col("n")), "average_max_successive_tokens": safe_ratio(F.col("l"), F.col("n")), "bleu": safe_ratio(F.col("bleu"), F.col("n"))}


completion_metrics = MetricSet(_completion_counts, _completion_values)


#: Classes by task; the names of the tasks are those under which results are asked for.
EXCEPTION_CLASSES = tuple("AssertionError AttributeError DoesNotExist HTTPError IOError ImportError IndexError KeyError KeyboardInterrupt NameError NotImplementedError OSError ObjectDoesNotExist RuntimeError StopIteration SystemExit TypeError UnicodeDecodeError ValidationError ValueError".split())
EVALUATORS: dict[str, Metrics] = {
    "code2seq_dataset": token_prf,
    "convattn_dataset": name_prf,
    "funcom_dataset": summary_bleu,
    "great_var_misuse_dataset": misuse_accuracy,
    "great_var_misuse_unpointed_dataset": partial(misuse_accuracy, pointed=False),
    "cubert_exception_classification_dataset": partial(known_class_accuracy, classes=EXCEPTION_CLASSES),
    "cubert_variable_misuse_classification_dataset": partial(known_class_accuracy, classes=("Correct", "Variable misuse")),
    "cubert_variable_misuse_repair_dataset": repair_metrics,
    "cubert_variable_misuse_repair_unpointed_dataset": partial(repair_metrics, parse=parse_error_location),
    "cubert_variable_misuse_repair_nocopy_dataset": repair_metrics,
    "cubert_variable_misuse_repair_unpointed_nocopy_dataset": partial(repair_metrics, parse=parse_error_location),
    "cubert_swapped_operand_classification_dataset": partial(known_class_accuracy, classes=("Correct", "Swapped operands")),
    "cubert_function_docstring_classification_dataset": partial(known_class_accuracy, classes=("Correct", "Incorrect")),
    "cubert_wrong_operator_classification_dataset": partial(known_class_accuracy, classes=("Correct", "Wrong binary operator")),
    "hoppity_single_ast_diff_dataset": edit_accuracy,
    "ogb_code_dataset": name_prf,
    "manysstubs4j_dataset": class_accuracy,
    "retrieve_and_edit_dataset": completion_metrics,
}


def evaluate(pred: DataFrame, name: str, **options) -> DataFrame:
    """The metrics of a task by name."""
    if name not in EVALUATORS:
        raise ValueError(f"no metrics for {name}")
    return EVALUATORS[name](pred, **options)


def _opened(metrics: Metrics) -> tuple[MetricSet, dict]:
    return (metrics.func, metrics.keywords) if isinstance(metrics, partial) else (metrics, {})


def _bounds(sums: DataFrame, values: dict[str, Column], samples: int, intervals: Sequence[int]) -> DataFrame:
    """Rows (metric, ci, lower, upper) of sums by sample."""
    found = _metrics(sums, ["sample"], values).where("value is not null").groupBy("metric").agg(F.array_sort(F.collect_list("value")).alias("v"))  # `samples` values
    bounds = [F.struct(F.lit(ci).alias("ci"), F.col("v")[lo].alias("lower"), F.col("v")[hi].alias("upper")) for ci in intervals for lo, hi in [bootstrap_bounds(samples, ci)]]
    return found.select("metric", F.explode(F.array(*bounds)).alias("x")).select("metric", "x.ci", "x.lower", "x.upper")


def _hash_draw(seed: int) -> Callable[[Column, Column, int], Column]:
    return lambda sample, at, n: F.pmod(F.xxhash64(F.lit(seed), sample, at), F.lit(n))


#: Draws that one task makes, at most.
TASK_DRAWS = 1_000_000


def draws(spark: SparkSession, n: int, samples: int, draw: Callable[[Column, Column, int], Column]) -> DataFrame:
    """Rows (sample, idx), n for each sample.

    The optimizer takes them for n rows, few enough for a broadcast: what they meet must be hinted as the side to build on.
    """
    each = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n * samples // TASK_DRAWS))).select(F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), F.col("id"))
    return each.select("sample", draw(F.col("sample"), F.col("id"), max(1, n)).alias("idx"))


def bootstrap(pred: DataFrame, metrics: Metrics, samples: int, intervals: Sequence[int], seed: int = 42, draw: Callable[[Column, Column, int], Column] | None = None) -> DataFrame:
    """Rows (metric, ci, lower, upper): bounds of each metric over samples drawn with replacement, each draw by a hash.

    idx must run from 0 without gaps. draw(sample, at, n) gives the row of a sample's draw. Rows are judged once; their numbers
    meet the draws, and a sample's numbers are summed where they meet. Work and shuffle grow with rows times samples: for many
    rows see bootstrap_in_blocks(). draws() never sends them to all executors.
    """
    if any(not 50 <= ci < 100 for ci in intervals):
        raise ValueError("intervals lie from 50 to 99")
    judge, options = _opened(metrics)
    n = pred.count()
    rows = judge.counts(pred, ["idx"], **options)
    drawn = draws(pred.sparkSession, n, samples, draw or _hash_draw(seed))
    sums = drawn.join(rows.hint("shuffle_hash"), "idx").groupBy("sample").agg(*[_sum(c).alias(c) for c in rows.columns if c != "idx"])
    return _bounds(sums, judge.values(**options), samples, intervals)


#: Rows that one task of bootstrap_in_blocks() draws from.
BLOCK_ROWS = 100_000


def bootstrap_in_blocks(pred: DataFrame, metrics: Metrics, samples: int, intervals: Sequence[int], seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """bootstrap() in one pass over rows (idx, ...), without a row for each draw; idx only deals the rows to blocks.

    How many of a sample's n draws fall in each block is one multinomial draw over the blocks' sizes, the same in all tasks; how often each
    row of a block is drawn is another one over the block. Together that is n draws with replacement over all rows. Rows of a
    block with equal numbers are drawn as one. Only sums by block and sample are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    if any(not 50 <= ci < 100 for ci in intervals):
        raise ValueError("intervals lie from 50 to 99")
    judge, options = _opened(metrics)
    rows = judge.counts(pred, ["idx"], **options)
    names = [c for c in rows.columns if c != "idx"]
    blocks = max(1, -(-pred.count() // block_rows))
    block = F.pmod(F.xxhash64(F.lit(seed), "idx"), F.lit(blocks)).cast("int")
    sizes = {r[0]: r[1] for r in pred.groupBy(block.alias("block")).count().collect()}  # a number for each block
    share = np.array([sizes.get(k, 0) for k in range(blocks)])

    def drawn(table: pa.Table) -> pa.Table:
        own = table.column("block")[0].as_py()
        numbers = np.stack([table.column(c).cast(pa.float64()).fill_null(0.0).to_numpy() for c in names], 1)
        kinds, many = np.unique(numbers, axis=0, return_counts=True)
        out = np.empty((samples, len(names)))
        for s in range(samples):
            here = np.random.default_rng([seed, s]).multinomial(share.sum(), share / share.sum())[own]
            times = np.random.default_rng([seed, s, own]).multinomial(here, many / many.sum())
            out[s] = np.einsum("i,ij->j", times.astype(float), kinds)
        return pa.table({"sample": np.arange(samples, dtype=np.int32), **{c: out[:, k] for k, c in enumerate(names)}})

    parts = rows.select(block.alias("block"), *names).groupBy("block").applyInArrow(drawn, ", ".join(["sample int", *[f"`{c}` double" for c in names]]))
    sums = parts.groupBy("sample").agg(*[_sum(c).alias(c) for c in names])
    return _bounds(sums, judge.values(**options), samples, intervals)


def report(metrics: DataFrame, total: Column | None = None) -> DataFrame:
    """Lines `name: value`, values with five places, as text rows (line)."""
    lines = metrics.select(F.format_string("%s: %.5f", "metric", "value").alias("line"))
    return lines if total is None else metrics.sparkSession.range(1).select(F.format_string("total: %d", total).alias("line")).union(lines)


def output_accuracy(rows: DataFrame, by: Sequence[str] = (), oov: int = 0, pad: int = 1) -> DataFrame:
    """Counters of right outputs among tokens, copies and pointers: rows (seq, head, choice, token_id, copies, pointers), a row for each place.

    head and choice say what was chosen: token, copy or pointer, and which. Padding does not count. A token is right if it is
    the wanted one, is in the vocabulary and no pointer is wanted. Place-wise counts over pointers and over the others, and
    sequences right in all, in their pointers and in the others; a sequence without such places is right in them.
    """
    pointing = F.size("pointers") > 0
    real = F.col("token_id") != pad
    right = (
        F.when(F.col("head") == "token", (F.col("choice") == F.col("token_id")) & (F.col("token_id") != oov) & ~pointing).when(F.col("head") == "copy", F.array_contains("copies", F.col("choice"))).otherwise(F.array_contains("pointers", F.col("choice")))
    )
    marked = rows.withColumns({"_right": F.coalesce(right, F.lit(False)), "_po": pointing, "_real": real})
    ok, po, is_real = F.col("_right"), F.col("_po"), F.col("_real")
    each = marked.groupBy(*by, "seq").agg(
        F.count_if(is_real & ok).alias("element_correct"), F.count_if(is_real).alias("element_attempts"), F.count_if(is_real & po & ok).alias("pointer_correct"), F.count_if(is_real & po).alias("pointer_attempts"),
        F.count_if(is_real & ~po & ok).alias("toco_correct"), F.count_if(is_real & ~po).alias("toco_attempts"), F.count_if(is_real & ok & (F.col("head") == "token")).alias("token_correct"),
    )
    sums = ["element_correct", "element_attempts", "pointer_correct", "pointer_attempts", "toco_correct", "toco_attempts", "token_correct"]
    whole = lambda a: F.count_if(F.col(f"{a}_correct") == F.col(f"{a}_attempts"))
    s = each.groupBy(*by).agg(*[_sum(c).alias(c) for c in sums], whole("element").alias("seq_correct"), F.count(F.lit(1)).alias("seq_attempts"), whole("pointer").alias("pointer_seq_correct"), whole("toco").alias("toco_seq_correct"))
    return _metrics(s, by, {f"num_{c}": F.col(c) for c in [*sums, "seq_correct", "seq_attempts", "pointer_seq_correct", "toco_seq_correct"]})


def accuracy_report(counters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines `name,value`: sequence and element accuracy, and how many of both there were."""
    wide = counters.groupBy(*by).pivot("metric", ["num_seq_correct", "num_seq_attempts", "num_element_correct", "num_element_attempts"]).agg(F.first("value"))
    ratio = lambda k: safe_ratio(F.col(f"num_{k}_correct"), F.col(f"num_{k}_attempts"))
    lines = [F.format_string("seq_accuracy,%.5f", ratio("seq")), F.format_string("element_accuracy,%.5f", ratio("element")), F.format_string("num_sequences,%d", F.col("num_seq_attempts").cast("bigint")), F.format_string("num_elements,%d", F.col("num_element_attempts").cast("bigint"))]
    return wide.select(*by, F.posexplode(F.array(*lines)).alias("place", "line"))
