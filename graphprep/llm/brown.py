"""Class-based bigram language model with classes from exchange clustering (Brown et al.), and its scores.

Model. Every training word w has a class c(w). P(w | before) = (1 - u) * P(c(w) | h) * n(w) / n(c(w)), where h is the class of
the word before; an unknown word has probability u = (n1 + 1) / (N + 2), n1 being the number of words seen once.
P(c | h) = (n(h, c) + PRIOR * n(c) / N) / (n(h) + PRIOR); behind an unknown word it is n(c) / N. The end of a text is a word
with a class of its own; it also stands before the first word. The probabilities of all known words and of "unknown" add up to
1 after every history.

Clustering. Exchange moves a word to the class that raises the likelihood of the class bigrams most. The FREQUENT most
frequent words are moved in several sweeps: a sweep counts, over all training text, with which classes each of them occurs
on either side, and then moves word after word against these counts. Every other word then makes its exchange step, all of
them at once and wherever they are, by the classes on both its sides. From there on all words are alike: each stands in its
own class, as history too. FREQUENT bounds what is sent to executors and held by the driver, not what is counted.

Texts are coded once, in chunks of CHUNK_TOKENS: the chunk's words, and its texts as numbers of these. All later passes read
the codes. A chunk's words meet their counts and classes by a shuffle by word and another one back to the chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprep.llm.common import map_batches, materialize, text_bytes

CLASSES = 48
FREQUENT = 1 << 14
SWEEPS = 3
PRIOR = 20.0
#: Tokens of a chunk, about, and rows of chunks' words that one task settles.
CHUNK_TOKENS, TASK_WORDS = 2_000_000, 250_000
#: Of a row group of chunks: a chunk fills one, so that a task holds one or two of them, however many it reads.
GROUP_BYTES = 8 << 20
#: Cells of counts that one row carries, packed.
CELLS = 1 << 15
#: How often a class stands beside a word: its cell and the number, packed.
_MET = np.dtype([("cell", "<u2"), ("n", "<u4")])
#: The end of a text as a word. A word cannot hold a space.
END = b" "


@dataclass
class BrownModel:
    """words (word, n, cls): all training words; of the most frequent ones names, counts and classes; the rest: numbers of the classes."""

    words: DataFrame
    names: list[bytes]
    word_counts: np.ndarray
    word_class: np.ndarray
    pair: np.ndarray  # n(h, c), the end's class last
    total: int
    distinct: int
    once: int

    @property
    def class_counts(self) -> np.ndarray:
        return self.pair.sum(axis=0)

    @property
    def unknown(self) -> float:
        return (self.once + 1) / (self.total + 2)

    def transitions(self) -> np.ndarray:
        """log10 of (1 - u) * P(c | h); the last row is the history of unknown words."""
        prior = self.class_counts / max(1, self.total)
        rows = np.vstack([self.pair, np.zeros_like(self.pair[:1])])
        with np.errstate(divide="ignore"):
            return np.log10((1 - self.unknown) * (rows + PRIOR * prior) / (rows.sum(axis=1, keepdims=True) + PRIOR))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(left: np.ndarray, right: np.ndarray, counts: np.ndarray, cls: np.ndarray, classes: int, fixed: int) -> np.ndarray:
    """One sweep. left[w, c], right[w, c]: how often class c stands before and behind word w. Classes from `classes` on (the
    end, other words) take and give no words. Words move in the order of their number; the first `fixed` stay."""
    cls = cls.copy()
    wide = left.shape[1]
    before, behind = np.zeros((wide, wide)), np.zeros((wide, wide))  # n(h, c) by left contexts, n(c, next) by right contexts
    np.add.at(before.T, cls, left)
    np.add.at(behind, cls, right)
    size = np.bincount(cls, weights=counts, minlength=wide)
    members = np.bincount(cls, minlength=wide)
    for w in range(fixed, len(cls)):
        own = cls[w]
        if members[own] < 2:
            continue
        i, j = np.flatnonzero(left[w]), np.flatnonzero(right[w])
        x, y, n = left[w, i], right[w, j], counts[w]
        before[i, own] -= x
        behind[own, j] -= y
        size[own] -= n
        a, b, s = before[i, :classes], behind[:classes, j], size[:classes]
        gain = (_phi(a + x[:, None]) - _phi(a)).sum(axis=0) + (_phi(b + y[None, :]) - _phi(b)).sum(axis=1) - 2 * (_phi(s + n) - _phi(s))
        best = int(np.argmax(gain))
        if gain[best] <= gain[own] + 1e-9:
            best = own
        before[i, best] += x
        behind[best, j] += y
        size[best] += n
        members[own] -= 1
        members[best] += 1
        cls[w] = best
    return cls


def _pack(values: np.ndarray) -> bytes:
    """Non-negative numbers in little room: byte by byte, first the lowest bytes of all, and zstd."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = [(values >> (8 * k)).astype(np.uint8) for k in range(width)]
    return bytes([width]) + pa.compress(np.concatenate(planes), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    """The n numbers of _pack()."""
    planes = np.frombuffer(pa.decompress(raw[1:], raw[0] * n, codec="zstd"), np.uint8).reshape(raw[0], n)
    out = planes[0].astype(np.int64)
    for k in range(1, raw[0]):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def code(docs: DataFrame) -> DataFrame:
    """Rows (chunk, words, n, ids, sizes, doc_ids, held) of docs (doc_id, held_out, text), one for each chunk of texts.

    words[0] is END; n: occurrences in texts that are not held out; ids: the words' numbers, END behind each text, packed;
    sizes, doc_ids, held: of each text. Null texts count as empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        ids, sizes, doc_ids, held = [], [], [], []

        def out() -> pa.RecordBatch:
            nonlocal number
            flat, out_of = np.array(ids, np.int32), np.array(held, bool)
            n = np.bincount(flat[np.repeat(~out_of, sizes)], minlength=len(words))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            made = [pa.array([number]), one(list(words), pa.binary()), one(n.astype(np.int32), pa.int32()), pa.array([_pack(flat)], pa.binary()), one(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(doc_ids)), one(held, pa.bool_())]
            number += 1
            words.clear()
            for x in (ids, sizes, doc_ids, held):
                x.clear()
            return pa.RecordBatch.from_arrays(made, names=["chunk", "words", "n", "ids", "sizes", "doc_ids", "held"])

        for b in batches:
            start = 0
            for k, (t, h) in enumerate(zip(text_bytes(b.column(2)), b.column(1).to_pylist(), strict=True), 1):
                if not words:
                    words[END]
                ws = t.lower().split()
                ids.extend(map(words.__getitem__, ws))
                ids.append(0)
                sizes.append(len(ws) + 1)
                held.append(h)
                if len(ids) >= CHUNK_TOKENS:
                    doc_ids.append(b.column(0).slice(start, k - start))
                    start = k
                    yield out()
            if start < b.num_rows:
                doc_ids.append(b.column(0).slice(start))
        if ids:
            yield out()

    schema = f"chunk long, words array<binary>, n array<int>, ids binary, sizes array<int>, doc_ids array<{kind}>, held array<boolean>"
    return materialize(map_batches(docs.select("doc_id", "held_out", "text"), run, schema, caches="brown"), "brown-coded", "zstd", GROUP_BYTES)


def _bigrams(ids: bytes, sizes: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words before and of the words, over all texts that are not held out."""
    each = sizes.to_numpy()
    now = _unpack(ids, int(each.sum()))
    before = np.concatenate([np.zeros(min(1, len(now)), np.int64), now[:-1]])
    own = np.repeat(~np.array(held.to_pylist(), bool), each)
    return before[own], now[own]


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Of each chunk of a batch (words, ids, sizes, held): its words and bigrams."""
    for k in range(b.num_rows):
        yield b.column("words")[k].values.to_pylist(), *_bigrams(b.column("ids")[k].as_py(), b.column("sizes")[k].values, b.column("held")[k].values)


def _context_counts(coded: DataFrame, words: dict[bytes, int], cls: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """left[w, c], right[w, c] over all training text; the last class is that of all other words. Their size is FREQUENT times the classes.

    A task sends its counts as CELLS to a row, packed, and not a row for each of them: every task has most of the cells.
    """
    sent = coded.sparkSession.sparkContext.broadcast((words, np.append(cls, wide - 1)))
    n = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cls = sent.value
        tables = np.zeros(2 * n * wide, np.int64)
        for b in batches:
            for own, p, c in _chunks(b):
                f = np.array([words.get(w, -1) for w in own], np.int64)
                p, c = f[p], f[c]
                known = c >= 0
                tables += np.bincount(c[known] * wide + cls[p[known]], minlength=2 * n * wide)
                known = p >= 0
                tables += np.bincount(n * wide + p[known] * wide + cls[c[known]], minlength=2 * n * wide)
        blocks = {lo: part for lo in range(0, len(tables), CELLS) if (part := tables[lo : lo + CELLS]).any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(map(_pack, blocks.values()), pa.binary())], names=["start", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lo, part in zip(b.column("start").to_pylist(), b.column("counts").to_pylist(), strict=True):
                more = _unpack(part, min(CELLS, 2 * n * wide - lo))
                sums[lo] = sums[lo] + more if lo in sums else more
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["start", "counts"])

    counted = map_batches(coded.select("words", "ids", "sizes", "held"), run, "start long, counts binary", caches="brown")
    got = map_batches(counted.repartition("start"), add, "start long, counts binary", caches="brown").toArrow()
    out = np.zeros(2 * n * wide)
    for lo, part in zip(got.column("start").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[lo : lo + CELLS] += np.frombuffer(part, np.int64)
    both = out.reshape(2, n, wide)
    return both[0], both[1]


def _other_words(coded: DataFrame, words: dict[bytes, int], cls: np.ndarray, side: int) -> DataFrame:
    """Rows (word, chunk, id, n, met), one for each chunk and word of it that is not a frequent one: how often each class stands
    before it (cells from 0) and behind it (cells from `side`)."""
    sent = coded.sparkSession.sparkContext.broadcast((words, np.append(cls, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cls = sent.value
        for b in batches:
            for k, (own, p, c) in enumerate(_chunks(b)):
                f = np.array([words.get(w, -1) for w in own], np.int64)
                kp, kc = cls[f[p]], cls[f[c]]
                one, two = (kc < 0) & (kp >= 0), (kp < 0) & (kc >= 0)
                met = np.concatenate([c[one].astype(np.int64) * (2 * side) + kp[one], p[two].astype(np.int64) * (2 * side) + side + kc[two]])
                cells, counts = np.unique(met, return_counts=True)
                spots = np.flatnonzero(f < 0)
                ends = np.searchsorted(cells, (np.r_[spots, len(own)]) * (2 * side)).astype(np.int32)
                n = b.column("n")[k].values.to_numpy()[spots]
                packed = np.empty(len(cells), _MET)
                packed["cell"], packed["n"] = cells % (2 * side), counts
                met = pa.Array.from_buffers(pa.binary(), len(spots), [None, pa.py_buffer(ends * np.int32(_MET.itemsize)), pa.py_buffer(packed)])
                made = [pa.array(own, pa.binary()).take(pa.array(spots)), pa.array(np.full(len(spots), b.column("chunk")[k].as_py())), pa.array(spots.astype(np.int32)), pa.array(n), met]
                whole = pa.RecordBatch.from_arrays(made, names=["word", "chunk", "id", "n", "met"])
                yield from (whole.slice(lo, 10_000) for lo in range(0, whole.num_rows, 10_000))

    return map_batches(coded.select("chunk", "words", "n", "ids", "sizes", "held"), run, "word binary, chunk long, id int, n int, met binary", caches="brown")


def _settled(rows: DataFrame, tasks: int, toward: np.ndarray, by_chunk: bool) -> DataFrame:
    """_other_words() rows to the words' counts and classes: rows (word, n, cls), or for each chunk (chunk, ids, ns, classes).

    toward[cell, c]: what an occurrence of the cell's class beside a word says for class c. Words without training text are left out.
    """
    sent = rows.sparkSession.sparkContext.broadcast(toward)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toward = sent.value
        wide = len(toward)
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if b.num_rows:
                w = np.fromiter(map(number.__getitem__, b.column("word").to_pylist()), np.int64, b.num_rows)
                packed = b.column("met").to_pylist()
                met = np.frombuffer(b"".join(packed), _MET)
                owner = np.repeat(w, np.fromiter(map(len, packed), np.int64, len(packed)) // _MET.itemsize)
                parts.append((w, b.column("chunk").to_numpy(), b.column("id").to_numpy(), b.column("n").to_numpy(), owner, met["cell"].astype(np.int64), met["n"]))
        if not parts:
            return
        w, chunk, ids, n, owner, cells, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        total = np.bincount(w, weights=n, minlength=len(number)).astype(np.int64)
        cls = np.zeros(len(number), np.uint8)
        order = np.argsort(owner, kind="stable")
        owner, cells, counts = owner[order], cells[order], counts[order]
        for lo in range(0, len(number), 20_000):
            hi = min(lo + 20_000, len(number))
            a, z = np.searchsorted(owner, [lo, hi])
            table = np.bincount((owner[a:z] - lo) * wide + cells[a:z], weights=counts[a:z], minlength=(hi - lo) * wide)
            cls[lo:hi] = (table.reshape(hi - lo, wide) @ toward).argmax(axis=1)
        if not by_chunk:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()).take(pa.array(seen)), pa.array(total[seen]), pa.array(cls[seen].astype(np.int32))], names=["word", "n", "cls"])
            return
        seen = np.flatnonzero(total[w])
        if not len(seen):
            return
        seen = seen[np.argsort(chunk[seen], kind="stable")]
        starts = np.flatnonzero(np.r_[True, chunk[seen][1:] != chunk[seen][:-1]])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(seen)], strict=True):
            own = seen[lo:hi]
            packed = [ids[own].tobytes(), total[w[own]].tobytes(), cls[w[own]].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([chunk[own[0]]]), *(pa.array([x], pa.binary()) for x in packed)], names=["chunk", "ids", "ns", "classes"])

    schema = "chunk long, ids binary, ns binary, classes binary" if by_chunk else "word binary, n long, cls int"
    return map_batches(rows.repartition(tasks, "word"), run, schema, caches="brown")


def _classified(coded: DataFrame, known: DataFrame, frequent: dict[bytes, tuple[int, int]], unseen: int, denominator: float) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, base, log_n, classes), one for each text: sums over its tokens, and their classes.

    known (chunk, ids, ns, classes): counts and classes of the chunks' words; those of the frequent ones are sent, and met before
    the shuffle, so that no words go through it. `unseen` is the class of unknown words.
    """
    kind = coded.schema["doc_ids"].dataType.elementType.simpleString()
    sent = coded.sparkSession.sparkContext.broadcast(frequent)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = f"chunk long, kind int, ids binary, ns binary, classes binary, words int, sizes array<int>, doc_ids array<{kind}>, held array<boolean>"
    given = known.select("chunk", F.lit(0).alias("kind"), "ids", "ns", "classes", none("words", "int"), none("sizes", "array<int>"), none("doc_ids", f"array<{kind}>"), none("held", "array<boolean>"))

    def wordless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk its frequent words as a row of `known`, and the chunk with the number of its words."""
        frequent = sent.value
        for b in batches:
            for k in range(b.num_rows):
                words = b.column("words")[k].values.to_pylist()
                met = [(i, *frequent[w]) for i, w in enumerate(words) if w in frequent]
                ids, ns, classes = (np.array([x[j] for x in met], t).tobytes() for j, t in enumerate((np.int32, np.int64, np.uint8)))
                texts = [pa.concat_arrays([pa.nulls(1, x.type), x]) for x in (b.column(c).slice(k, 1) for c in ("sizes", "doc_ids", "held"))]
                made = [pa.array([b.column("chunk")[k].as_py()] * 2), pa.array([0, 1], pa.int32()), pa.array([ids, b.column("ids")[k].as_py()], pa.binary()), pa.array([ns, None], pa.binary()), pa.array([classes, None], pa.binary()), pa.array([None, len(words)], pa.int32()), *texts]
                yield pa.RecordBatch.from_arrays(made, names=["chunk", "kind", "ids", "ns", "classes", "words", "sizes", "doc_ids", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        chunk = None
        for b in batches:
            for k in range(b.num_rows):
                get = lambda c: b.column(c)[k]  # noqa: B023, E731
                if get("chunk").as_py() != chunk:
                    chunk, held = get("chunk").as_py(), []
                if not get("kind").as_py():
                    held.append(tuple(np.frombuffer(get(c).as_py(), t) for c, t in (("ids", np.int32), ("ns", np.int64), ("classes", np.uint8))))
                    continue
                words = get("words").as_py()
                n, cls = np.zeros(words, np.int64), np.full(words, unseen, np.uint8)
                for ids, ns, classes in held:
                    n[ids], cls[ids] = ns, classes
                sizes = get("sizes").values.to_numpy()
                tokens = _unpack(get("ids").as_py(), int(sizes.sum()))
                starts = np.cumsum(sizes) - sizes
                sums = lambda by_word: np.add.reduceat(by_word[tokens], starts)  # noqa: B023, E731
                codes, ends = cls[tokens].tobytes(), np.r_[starts, len(tokens)].tolist()
                made = [
                    get("doc_ids").values, get("held").values, pa.array(sizes.astype(np.int64)), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(np.log10((n + 1) / denominator))), pa.array(sums(np.log10(np.maximum(n, 1)))),
                    pa.array([codes[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "log_n", "classes"])

    # A chunk or two a task, at any size.
    rows = map_batches(coded.select("chunk", "words", "ids", "sizes", "doc_ids", "held"), wordless, both, caches="brown")
    met = rows.union(given).repartition(max(1, coded.count()), "chunk").sortWithinPartitions("chunk", "kind")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, log_n double, classes binary"
    return materialize(map_batches(met, run, schema, caches="brown"), "brown-classes", "zstd")


def _class_bigrams(classified: DataFrame, wide: int) -> np.ndarray:
    """n(h, c) over texts that are not held out; the last class is the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(wide * wide, np.int64)
        for b in batches:
            # Each text ends in an end, so the class before a text's first token is the end's wherever it stands.
            c = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).astype(np.int64)
            if len(c):
                table += np.bincount(np.r_[wide - 1, c[:-1]] * wide + c, minlength=wide * wide)
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], names=["cell", "n"])

    pair = np.zeros(wide * wide)
    for cell, n in map_batches(classified.where("not held_out").select("classes"), run, "cell long, n long", caches="brown").groupBy("cell").agg(F.sum("n")).collect():  # wide^2 rows
        pair[cell] = n
    return pair.reshape(wide, wide)


def _scored(classified: DataFrame, model: BrownModel) -> DataFrame:
    """The result rows of score(): the classes' steps, and the words' shares of their classes."""
    wide = len(model.pair)
    trans = np.nan_to_num(np.hstack([model.transitions(), np.full((wide + 1, 1), np.log10(model.unknown))]), neginf=0.0)
    with np.errstate(divide="ignore"):
        share = np.nan_to_num(np.append(np.log10(np.maximum(model.class_counts, 1)), 0.0))
    step = trans - share[None, :]
    step[:, wide] = np.log10(model.unknown)
    sent = classified.sparkSession.sparkContext.broadcast(step)
    kind = classified.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = sent.value.ravel()
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column("n_tokens").to_numpy()
            starts = np.cumsum(sizes) - sizes
            c = np.frombuffer(b"".join(b.column("classes").to_pylist()), np.uint8).astype(np.int64)
            before = np.r_[wide - 1, c[:-1]]
            before[starts] = wide - 1
            score = np.add.reduceat(step[before * (wide + 1) + c], starts) + b.column("log_n").to_numpy()
            made = [*b.columns[:4], pa.array(np.full(len(sizes), model_total)), b.column("base"), pa.array(score), pa.array(10.0 ** (-score / sizes))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    model_total = int(model.total)
    return map_batches(classified, run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", caches="brown")


def _fit(coded: DataFrame, classes: int, frequent: int, sweeps: int, by_chunk: bool) -> tuple[BrownModel, DataFrame | None]:
    """A model without class bigrams yet; with by_chunk the chunks' words instead of the model's table of words."""
    if not 0 < classes < 254:
        raise ValueError("classes must be from 1 to 253")
    counts = coded.select(F.explode(F.arrays_zip("words", "n")).alias("x")).where("x.n > 0").groupBy(F.col("x.words").alias("word")).agg(F.sum("x.n").alias("n"))
    counts = materialize(counts, "brown-words")
    total, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(frequent - 1).toArrow()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    names = [END, *top.column("word").to_pylist()]
    words = {w: i for i, w in enumerate(names)}
    n_of = np.concatenate([[ends["n"] if ends else 0], top.column("n").to_numpy()]).astype(np.float64)
    end_class, side = classes, classes + 1
    # At first the words are dealt out by frequency.
    cls = np.append([end_class], (np.arange(len(names) - 1)) % classes).astype(np.int64)
    for _ in range(sweeps):
        left, right = _context_counts(coded, words, cls, side + 1)
        cls = exchange(left, right, n_of, cls, classes, fixed=1)
    # The exchange criterion for one more word: what its neighbours' classes say for each class, by the bigrams of the frequent words.
    pair = np.zeros((side, side))
    np.add.at(pair.T, cls, _context_counts(coded, words, cls, side + 1)[0][:, :side])
    size = np.bincount(cls, weights=n_of, minlength=side)[:classes]
    toward = np.vstack([np.log((pair[:, :classes] + 0.5) / (size + 0.5 * side)), np.log((pair[:classes].T + 0.5) / (size + 0.5 * side))])
    cells = coded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    others = _settled(_other_words(coded, words, cls, side), 1 + cells // TASK_WORDS, toward, by_chunk)
    spark = coded.sparkSession
    own = [(bytearray(w), int(n), int(c)) for w, n, c in zip(names, n_of, cls, strict=True) if n]
    table = spark.createDataFrame(own, "word binary, n long, cls int")
    model = BrownModel(table, names, n_of, cls, np.zeros((side, side)), int(total), int(distinct), int(once))
    if by_chunk:
        return model, others
    model.words = table.union(materialize(others, "brown-others"))
    return model, None


def _frequent(model: BrownModel) -> dict[bytes, tuple[int, int]]:
    return {w: (int(n), int(c)) for w, n, c in zip(model.names, model.word_counts, model.word_class, strict=True) if n}


def train(docs: DataFrame, classes: int = CLASSES, frequent: int = FREQUENT, sweeps: int = SWEEPS) -> BrownModel:
    """Fit on all texts of docs (text). Null texts count as empty: an end alone. No rows: a model that knows nothing."""
    coded = code(docs.select(F.lit(0).alias("doc_id"), F.lit(False).alias("held_out"), "text"))
    model, _ = _fit(coded, classes, frequent, sweeps, by_chunk=False)
    model.pair = _class_bigrams(_looked_up(coded, model), classes + 1)
    return model


def _looked_up(coded: DataFrame, model: BrownModel) -> DataFrame:
    """Coded texts with the counts and classes that their words have in a model's table."""
    each = coded.select("chunk", F.posexplode("words").alias("id", "word")).join(model.words, "word")
    kind = "chunk long, ids binary, ns binary, classes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            starts = np.flatnonzero(np.r_[True, chunk[order][1:] != chunk[order][:-1]]).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
                own = order[lo:hi]
                packed = [b.column(c).to_numpy()[own].astype(t).tobytes() for c, t in (("id", np.int32), ("n", np.int64), ("cls", np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk[own[0]]]), *(pa.array([x], pa.binary()) for x in packed)], names=["chunk", "ids", "ns", "classes"])

    known = map_batches(each.select("chunk", "id", "n", "cls"), run, kind, caches="brown")
    return _classified(coded, known, _frequent(model), len(model.pair), float(model.total + model.distinct + 1))


def _flagged(docs: DataFrame, held_out: F.Column | None) -> DataFrame:
    return docs.select("doc_id", (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), "text")


def score(docs: DataFrame, model: BrownModel, held_out: F.Column | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one for each row of docs.

    Null texts count as empty. Rows with equal or null doc_ids stay apart; other columns are not read. An empty table gives an
    empty result.
    """
    return _scored(_looked_up(code(_flagged(docs, held_out)), model), model)


def train_and_score(docs: DataFrame, held_out: F.Column, classes: int = CLASSES, frequent: int = FREQUENT, sweeps: int = SWEEPS) -> tuple[DataFrame, BrownModel]:
    """score() of all rows of docs under the model of those that are not held out, in fewer passes than train() and score() take.

    The model's table of words has the frequent ones only. Null as held_out counts as false.
    """
    coded = code(_flagged(docs, held_out))
    model, known = _fit(coded, classes, frequent, sweeps, by_chunk=True)
    classified = _classified(coded, known, _frequent(model), classes + 1, float(model.total + model.distinct + 1))
    model.pair = _class_bigrams(classified, classes + 1)
    return _scored(classified, model), model
