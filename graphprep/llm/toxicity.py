"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. The model of a category is a logistic regression over words and word beginnings,
each scaled by its log ratio between the category and the rest, and over the log odds of all categories before it. For
training those log odds are out of fold: what a model fitted on the other folds says of a document. So later models learn
how far earlier predictions can be trusted, not how well they fit their own training rows.

The fit reads a bounded sample of labelled documents, taken by a hash of the doc_id: features are counted on at most
COUNTED_ROWS of them, and of these at most SAMPLE_ROWS fit the weights of SELECTED features, those with the largest G
statistics. Where doc_ids repeat, all rows of a drawn one belong to the sample, up to twice SAMPLE_ROWS rows in all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from graphprep.llm.common import map_batches, materialize, text_bytes, worker_cache

#: Labelled documents whose features are counted, and those of them that the weights are fitted on, at most.
COUNTED_ROWS, SAMPLE_ROWS = 60_000, 20_000
SELECTED = 3072
FOLDS = 3
#: A feature counts when it is in so many labelled documents, and its G statistic is over this.
LEAST_DOCS, LEAST_G = 3, 12.0
#: Code points of the word beginnings that are features beside the word.
BEGINNINGS = (4, 6)
#: Entries that the fit looks at in one go.
BLOCK_ENTRIES = 1 << 19
FLUSH, CACHE_WORDS = 150_000, 120_000
_EDGES = ".,;:!?\"'()[]{}<>*%$&#|-_=+~`/\\"


def word_features(word: str) -> list[int]:
    """Hashes of a word and its beginnings. Punctuation at its ends doesn't count."""
    w = word.strip(_EDGES)
    if not w:
        return []
    digest = xxhash.xxh3_64_intdigest
    return [digest("=" + w) >> 1, *[digest(f"{n}{w[:n]}") >> 1 for n in BEGINNINGS if len(w) >= n]]


def text_features(text: str) -> set[int]:
    cache = worker_cache("toxicity", CACHE_WORDS)
    out: set[int] = set()
    for w in set(text.lower().split()):
        f = cache.get(w)
        if f is None:
            f = cache[w] = word_features(w)
        out.update(f)
    return out


@dataclass
class Chain:
    """features: hash -> number; one entry a category in scales, weights (features, then earlier log odds), biases, cuts."""

    categories: list[str]
    features: dict[int, int] = field(default_factory=dict)
    scales: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def log_odds(self, rows: list[list[int]]) -> np.ndarray:
        """For each row of feature numbers the log odds of every category, each fed with those before it."""
        out = np.zeros((len(rows), len(self.categories)))
        flat, starts = _flat(rows)
        for k in range(len(self.categories)):
            w = self.weights[k]
            out[:, k] = self.biases[k] + _row_sums((self.scales[k] * w[: len(self.scales[k])])[flat], starts) + out[:, :k] @ w[len(self.scales[k]) :]
        return out


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def _only(flat: np.ndarray, starts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries whose feature is used, row by row."""
    keep = used[flat] if flat.size else np.zeros(0, bool)
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(flat: np.ndarray, starts: np.ndarray, scale: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = 1e-3, turns: int = 80) -> tuple[np.ndarray, float]:
    """Accelerated gradient steps on the mean logistic loss plus a ridge. dense: the earlier categories' log odds."""
    n, k = len(y), len(scale)
    w, bias = np.zeros(k + dense.shape[1]), 0.0
    if not n or y.min() == y.max():
        return w, float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else -20.0

    def row_sums(by_feature: np.ndarray) -> np.ndarray:
        return np.concatenate([_row_sums(by_feature[flat[starts[lo] : starts[hi]]], starts[lo : hi + 1] - starts[lo]) for lo, hi in blocks])

    def column_sums(by_row: np.ndarray) -> np.ndarray:
        return sum((np.bincount(flat[starts[lo] : starts[hi]], weights=np.repeat(by_row[lo:hi], np.diff(starts[lo : hi + 1])), minlength=k) for lo, hi in blocks), np.zeros(k))

    cuts = np.unique(np.r_[np.searchsorted(starts[:-1], np.arange(0, int(starts[-1]) + 1, BLOCK_ENTRIES)), n])
    blocks = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if cuts[0] == 0 else list(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
    # The loss curves by at most a quarter of the largest squared row; half of the mean is taken, and shrunk if it overshoots.
    squares = row_sums(scale**2) + (dense**2).sum(axis=1) + 1
    rate = 4 / max(1.0, float(np.quantile(squares, 0.9)))
    ahead, ahead_bias, last = w.copy(), bias, np.inf
    for turn in range(turns):
        margin = row_sums(scale * ahead[:k]) + dense @ ahead[k:] + ahead_bias
        loss = float(np.logaddexp(0, np.where(y, -margin, margin)).mean() + ridge * (ahead @ ahead) / 2)
        if loss > last * 1.05:
            rate, ahead, ahead_bias, last = rate / 2, w.copy(), bias, np.inf
            continue
        last = min(last, loss)
        off = (_sigmoid(margin) - y) / n
        grad = np.concatenate([scale * column_sums(off), dense.T @ off]) + ridge * ahead
        new, new_bias = ahead - rate * grad, ahead_bias - rate * float(off.sum())
        push = turn / (turn + 3)
        ahead, ahead_bias = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def _best_cut(odds: np.ndarray, y: np.ndarray) -> float:
    """The log odds over which a document counts as the category: best F1 on out-of-fold predictions, midway between neighbours."""
    if not y.any():
        return np.inf
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)[-1]
    low = odds[order[best + 1]] if best + 1 < len(y) else odds[order[best]] - 2
    return float((odds[order[best]] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], folds: int = FOLDS, counted: int = COUNTED_ROWS, sample: int = SAMPLE_ROWS, selected: int = SELECTED) -> Chain:
    """Fit the chain on docs (doc_id, text) and labels (doc_id and a boolean column for each category, in this order).

    At most `counted` labels, drawn by hash of the doc_id, take part: features are chosen and weighed by all of these, and the
    weights are fitted on at most `sample` of them.

    Rows of labels with a null doc_id or a null category are left out; several rows for one doc_id count as true where any
    is. Labels without a document, and documents without labels, are not used. Without labelled documents, or with all of
    one kind, a category's probability is its rate, and nothing is over its cut where none is true.
    """
    names = [f"_label{i}" for i in range(len(categories))]
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)]).dropna().groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(counted), "toxicity-labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}
        rows = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            for kind, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), pa.array(list(c.keys()), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["kind", "feature", "n"])
            held.clear()
            rows = 0

        for b in batches:
            bits = sum(b.column(2 + i).to_numpy().astype(np.int64) << i for i in range(width))
            for t, kind in zip(text_bytes(b.column(1)), bits.tolist(), strict=True):
                c = held.setdefault(kind, Counter())
                c[-1] += 1  # the documents themselves
                c.update(text_features(t.decode("utf-8", "replace")))
                rows = max(rows, len(c))
                if rows > FLUSH:
                    yield from out()
        yield from out()

    # kind: which categories a document has, as bits.
    cells = map_batches(texts.select("doc_id", "text", *names), count, "kind int, feature long, n long", caches="toxicity")
    sums = cells.groupBy("feature").agg(*[F.sum(F.when(F.shiftright("kind", i) % 2 == 1, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(width)], F.sum("n").alias("n"))
    sums = materialize(sums, "toxicity-counts")
    totals = sums.where("feature = -1").first()
    chain = Chain(list(categories))
    if totals is None:
        for _ in categories:
            chain.scales.append(np.zeros(0))
            chain.weights.append(np.zeros(len(chain.weights)))
            chain.biases.append(-20.0)
            chain.cuts.append(np.inf)
        return chain
    docs_n = int(totals["n"])
    pos = [int(totals[f"n{i}"]) for i in range(width)]

    def g_of(i: int) -> F.Column:
        a, n = F.col(f"n{i}").cast("double"), F.col("n").cast("double")
        cells = [(a, n * pos[i] / docs_n), (n - a, n * (docs_n - pos[i]) / docs_n), (pos[i] - a, (docs_n - n) * pos[i] / docs_n), (docs_n - pos[i] - n + a, (docs_n - n) * (docs_n - pos[i]) / docs_n)]
        return sum((F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))

    strength = F.greatest(*[F.col(f"g{i}") for i in range(width)], F.lit(0.0))
    best = sums.where((F.col("feature") >= 0) & (F.col("n") >= LEAST_DOCS)).withColumns({f"g{i}": g_of(i) for i in range(width)}).withColumn("g", strength).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(selected).toPandas()
    chain.features = {int(f): i for i, f in enumerate(best["feature"])}
    n = best["n"].to_numpy(np.float64)
    scales = []
    for i in range(width):
        a = best[f"n{i}"].to_numpy(np.float64)
        ratio = np.log((a + 0.5) / (pos[i] + 1)) - np.log((n - a + 0.5) / (docs_n - pos[i] + 1))
        scales.append(np.where(best[f"g{i}"].to_numpy(np.float64) >= LEAST_G, ratio, 0.0))  # features of other categories say nothing here
    sent = docs.sparkSession.sparkContext.broadcast(chain.features)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_numbers(t.decode("utf-8", "replace"), sent.value) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(rows, pa.list_(pa.int32()))], names=["turn", *names, "found"])

    # The sample is drawn before the text is read again; its bound is the parameter `sample`.
    drawn = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sampled = texts.join(F.broadcast(drawn), "doc_id")
    rows = map_batches(sampled.select(F.xxhash64("doc_id").alias("turn"), "text", *names), project, "turn long, " + ", ".join(f"{x} int" for x in names) + ", found array<int>", caches="toxicity").orderBy("turn").limit(2 * sample).toArrow()
    found = rows.column("found").combine_chunks()
    every = found.flatten().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())]).astype(np.int64)
    fold = (rows.column("turn").to_numpy() >> 7) % folds
    earlier = np.zeros((rows.num_rows, 0))
    for i in range(width):
        y = rows.column(names[i]).to_numpy().astype(bool)
        odds = np.zeros(rows.num_rows)
        flat, starts = _only(every, bounds, scales[i] != 0)
        for f in range(folds):
            train = np.flatnonzero(fold != f)
            sizes = np.diff(starts)
            part = flat[np.repeat(fold != f, sizes)]
            w, bias = fit_logistic(part, np.concatenate([[0], np.cumsum(sizes[train])]), scales[i], earlier[train], y[train])
            k = len(scales[i])
            all_odds = bias + _row_sums((scales[i] * w[:k])[flat], starts) + earlier @ w[k:]
            odds[fold == f] = all_odds[fold == f]
        w, bias = fit_logistic(flat, starts, scales[i], earlier, y)
        chain.scales.append(scales[i])
        chain.weights.append(w)
        chain.biases.append(bias)
        chain.cuts.append(_best_cut(odds, y))
        earlier = np.column_stack([earlier, odds])
    return chain


def _numbers(text: str, features: dict[int, int]) -> list[int]:
    return sorted(features[f] for f in text_features(text) if f in features)


def predict(docs: DataFrame, chain: Chain, prefix: str = "p_", verdict: str = "is_") -> DataFrame:
    """Add p_<category> (double) and is_<category> (boolean) for each category to every row of docs.

    Null texts count as empty and have the categories' base rates. All columns stay; columns that bear the new names
    already are replaced.
    """
    fields = [StructField(prefix + c, DoubleType(), False) for c in chain.categories] + [StructField(verdict + c, BooleanType(), False) for c in chain.categories]
    kept = docs.drop(*[f.name for f in fields])
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for b in batches:
            odds = chain.log_odds([_numbers(t.decode("utf-8", "replace"), chain.features) for t in text_bytes(b.column("text"))])
            p = _sigmoid(odds)
            made = [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(odds[:, k] > chain.cuts[k]) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *[f.name for f in fields]])

    return map_batches(kept, run, StructType([*kept.schema.fields, *fields]), caches="toxicity")
