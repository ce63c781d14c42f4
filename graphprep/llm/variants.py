"""Grouping of spelling variants by search schemes on FM-indexes of the delimited vocabulary.

Words are near if one code point inserted, deleted or replaced makes one of the other. Of a word and a near one either the
first half is the same at both beginnings, or the second half at both ends. A search follows each scheme:

- first half exactly, from the delimiter at the beginning to the right, then on to the right with one error;
- second half exactly, from the delimiter at the end to the left, then on to the left with one error.

The index is bidirectional in that one FM-index extends to the right and one to the left, and since a half always begins at a
delimiter, a search never has to turn. A pattern is an interval of suffix ranks; a step to a symbol is the symbol's rank at
both ends, found in the sorted list of (symbol, row) pairs of the Burrows-Wheeler transform. All words of a shard search at
once, as arrays of intervals. What the second scheme finds that has the same first half is left to the first one, and errors
stand as far along as they can, so that each near word is found once.

Shards hold the words that share halves: a word goes to the shards of the halves that words of its length, of one less and of
one more would match, and searches in those of its own. Halves that very many words share are dealt to several shards, each of
which all their words search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import give_back, materialize, ship

LEAST_CHARS, LEAST_COUNT, FACTOR = 5, 3, 2
#: Words that one shard indexes, on average and of one half.
SHARD_WORDS = 40_000
#: Intervals that one step of a search holds.
AT_ONCE = 1_000_000
_RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the runs whose checksum this divides, one code point is deleted.
DAMAGED = 97


def counted_words(docs: DataFrame, damaged: int = DAMAGED, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the runs of letters of all texts, A-Z lower-cased, at least so long and so frequent.

    Where `damaged` divides h, the CRC-32 of <doc_id>:<run>, the run's code point h % length is left out before it is counted;
    0 leaves all as they are. Null texts have no words, and a null doc_id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).where(F.char_length("run") >= least_chars)
    if damaged:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        cut = F.expr("concat(substring(run, 1, CAST(h % char_length(run) AS INT)), substring(run, CAST(h % char_length(run) AS INT) + 2))")
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_count) & (F.char_length("word") >= least_chars))


class WordIndex:
    """FM-index of words between delimiters, to which patterns are given from their last symbol to the first.

    Symbols are 1 for the delimiter and from 2 on for characters. Delimiters differ in order, so that suffixes are told apart by
    what stands before the first delimiter, and a row's symbol is the one in front of its suffix.
    """

    def __init__(self, words: list[np.ndarray]) -> None:
        text = np.concatenate([np.ones(1, np.int64), *[x for w in words for x in (w, np.ones(1, np.int64))]])
        self.n, self.words = len(text), len(words)
        ends = np.flatnonzero(text == 1)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        depth = 1
        while True:
            after = np.zeros(self.n, np.int64)
            after[:-depth] = rank[depth:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(self.n, np.int64)
            new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
            rank, depth = new, 2 * depth
            if rank.max() == self.n - 1 or depth >= self.n:
                break
        before = np.where(order > 0, text[order - 1], 0)
        self.wide = self.n + 1
        self.pairs = before[by := np.argsort(before, kind="stable")] * self.wide + by
        self.symbols = [int(x) for x in np.unique(before) if x > 1]
        self.at = np.cumsum(text == 1)[order] - 1  # the word that a suffix begins in

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of suffixes that begin with the symbol, how many go on with suffixes below the row, behind all of smaller symbols."""
        return np.searchsorted(self.pairs, symbol * self.wide + row)

    def begun(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals of suffixes the words that begin there: (number of the interval, word)."""
        a, b = np.searchsorted(self.pairs, self.wide + lo), np.searchsorted(self.pairs, self.wide + hi)
        many = b - a
        which = np.repeat(np.arange(len(lo)), many)
        spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
        return which, self.at[self.pairs[spot] - self.wide]


def near_by_halves(index: WordIndex, queries: list[np.ndarray], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of the index's words that begin with the query's first `half` symbols and have one error in the rest.

    The index has the words turned round, so that prepending symbols goes on in the queries' direction.
    """
    sizes = np.array([len(q) for q in queries], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([*queries, np.zeros(2, np.int64)])
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def moved(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = index.step(symbol, lo), index.step(symbol, hi)
        some = np.flatnonzero(lo < hi)
        return q[some], lo[some], hi[some], some

    def finish(q: np.ndarray, i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The rest of the queries, exactly, to the delimiter."""
        while len(q):
            over = i == sizes[q]
            which, word = index.begun(lo[over], hi[over])
            found.append((q[over][which], word))
            q, i, lo, hi = (x[~over] for x in (q, i, lo, hi))
            q, lo, hi, some = moved(q, lo, hi, flat[starts[q] + i])
            i = i[some] + 1

    q, lo, hi = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), index.words + 1)
    i = np.zeros(len(queries), np.int64)
    while (go := i < halves[q]).any():
        stay = ~go
        mq, mlo, mhi, some = moved(q[go], lo[go], hi[go], flat[starts[q[go]] + i[go]])
        i = np.r_[i[stay], i[go][some] + 1]
        q, lo, hi = np.r_[q[stay], mq], np.r_[lo[stay], mlo], np.r_[hi[stay], mhi]
    symbols = np.array(index.symbols, np.int64)
    while len(q):
        inside = i < sizes[q]
        now = np.where(inside, flat[starts[q] + i], 0)
        last = np.where(i + 1 < sizes[q], flat[starts[q] + i + 1], 0)
        gone = inside & (now != last)  # a deleted symbol is the last of its run
        finish(q[gone], i[gone] + 1, lo[gone], hi[gone])
        step = max(1, AT_ONCE // max(1, len(symbols)))
        for a in range(0, len(q), step):
            part = slice(a, a + step)
            many = len(q[part])
            wide = lambda x: np.repeat(x[part], len(symbols))  # noqa: E731, B023
            c = np.tile(symbols, many)
            other = np.flatnonzero(c != wide(now))
            cq, clo, chi, some = moved(wide(q)[other], wide(lo)[other], wide(hi)[other], c[other])
            at, within = wide(i)[other][some], wide(inside)[other][some]
            finish(cq, at, clo, chi)  # one more symbol, not the one that comes next
            finish(cq[within], at[within] + 1, clo[within], chi[within])  # another symbol
        q, i, lo, hi, now = (x[inside] for x in (q, i, lo, hi, now))
        q, lo, hi, some = moved(q, lo, hi, now)
        i = i[some] + 1
    return np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]]), np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])


def _search(table: pa.Table) -> pa.Table:
    """Near words within one shard: rows (word, n_near, form, form_n) of the words that search there and find any."""
    words = np.array(table.column("word").to_pylist(), object)
    counts, turned = table.column("n").to_numpy(), bool(table.column("turned")[0].as_py())
    asks, indexed = table.column("asks").to_numpy(zero_copy_only=False), table.column("indexed").to_numpy(zero_copy_only=False)
    entries = sorted({w: int(c) for w, c in zip(words[indexed], counts[indexed], strict=True)}.items())  # in the order of code points
    queries = sorted({w for w in words[asks]})
    out: tuple[list, ...] = ([], [], [], [])
    if entries and queries:
        alphabet = {c: k for k, c in enumerate(sorted({c for w, _ in entries for c in w} | {c for w in queries for c in w}), 2)}
        coded = lambda w: np.array([alphabet[c] for c in w], np.int64)
        index = WordIndex([coded(w if turned else w[::-1]) for w, _ in entries])
        halves = np.array([len(w) - len(w) // 2 if turned else len(w) // 2 for w in queries], np.int64)
        q, x = near_by_halves(index, [coded(w[::-1] if turned else w) for w in queries], halves)
        if turned:  # the other scheme finds those with the same first half
            apart = np.array([queries[a][: len(queries[a]) // 2] != entries[b][0][: len(queries[a]) // 2] for a, b in zip(q.tolist(), x.tolist(), strict=True)], bool)
            q, x = q[apart], x[apart]
        n = np.array([c for _, c in entries])[x]
        order = np.lexsort((x, -n, q))
        q, x, n = q[order], x[order], n[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
        near = np.diff(np.append(first, len(q)))
        out = ([queries[k] for k in q[first]], near, [entries[k][0] for k in x[first]], n[first])
    arrays = [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())]
    return pa.Table.from_arrays(arrays, names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (word, n_near, form, form_n) of words (word, n), each once, that have near ones: how many, and the most frequent (of
    equal ones the first in code-point order)."""
    size = F.char_length("word")
    sides = []
    for turned in (False, True):
        lengths = F.array_distinct(F.transform(F.array(size - 1, size, size + 1), lambda x: (F.ceil(x / 2) if turned else F.floor(x / 2)).cast("int")))
        own = (F.ceil(size / 2) if turned else F.floor(size / 2)).cast("int")
        rows = words.select("word", "n", F.lit(turned).alias("turned"), F.explode(lengths).alias("half"), own.alias("own"))
        half = F.expr("right(word, half)") if turned else F.expr("left(word, half)")
        sides.append(rows.select("word", "n", "turned", F.xxhash64("turned", "half", half).alias("key"), (F.col("half") == F.col("own")).alias("asks")))
    rows = materialize(sides[0].unionByName(sides[1]), "variants-halves")
    shards = max(1, rows.count() // (2 * shard_words))
    hot = rows.groupBy("key").count().where(F.col("count") > shard_words).select("key", F.ceil(F.col("count") / shard_words).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # no more of them than shards
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))
    dealt = dealt.select("word", "n", "turned", "asks", (F.col("part") == F.col("mine")).alias("indexed"), F.when(F.col("parts") > 1, F.struct("key", "part")).alias("alone"), F.pmod("key", F.lit(shards)).alias("shard"))
    dealt = dealt.withColumn("shard", F.when(F.col("alone").isNotNull(), F.xxhash64("alone", "shard")).otherwise(F.col("shard"))).drop("alone")
    ship(words.sparkSession)

    def search(table: pa.Table) -> pa.Table:
        try:
            return _search(table)
        finally:
            give_back()

    found = dealt.groupBy("shard", "turned").applyInArrow(search, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of forms (word, form): the last of the forms that follow one another, by pointer jumping. Forms must not go in circles."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        now = jumped.select("word", "root")
        if not jumped.where("moved").take(1):
            return now


def group_variants(docs: DataFrame, damaged: int = 0, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of docs (doc_id, text, ...); other columns are not read.

    A word's form is its most frequent near word if that is at least `factor` times as frequent, its root the last of the forms
    from it on, or itself. Empty tables and texts without words give no rows; repeated rows of documents count again.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or forms could go in circles")
    words = materialize(counted_words(docs, damaged, least_chars, least_count), "variants-words")
    near = materialize(near_words(words), "variants-near")
    led = words.join(near, "word", "left")
    good = F.col("form_n") >= factor * F.col("n")
    led = led.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    led = materialize(led, "variants-forms")
    found = led.join(roots(led.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
