"""Token ids of a word-level BPE tokenizer (tokenizers library), by way of a cache of words.

The tokenizer drops white space and splits at it, and its normaliser works character by character or on combining
sequences that white space ends. A text's ids are therefore the ids of its parts between ASCII white space, one after
another. Parts are encoded once and kept. Of a part not met before, ASCII signs at its end behind an ASCII letter or digit
are split off, as the tokenizer always splits there, and both halves are looked up. Halves of letters alone are one
word each, so many of them go through the library in one text, and the ids that end a word tell them apart. Parts that may
hold one of the tokenizer's added tokens are encoded whole.
"""

from __future__ import annotations

from array import array

import numpy as np

from graphprep.llm.common import give_back, worker_cache

#: Parts, and halves of parts, kept by one Python worker.
CACHE_PARTS, CACHE_HALVES = 300_000, 200_000
#: Words that go through the library in one text, and texts that it takes at once.
JOINED, AT_ONCE = 200, 50
#: Signs split off at the end of a part. The apostrophe is not among them: the tokenizer splits contractions at it.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_END = "</w>"


class WordEncoder:
    """Encodes bytes of UTF-8 text to little-endian unsigned 32-bit ids, as one bytes object."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(definition)
        vocab = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(_WORD_END)]] = True
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]

    def plain(self, parts: list[bytes]) -> list[bytes]:
        """One part after another through the library."""
        out: list[bytes] = []
        for lo in range(0, len(parts), AT_ONCE * JOINED):
            texts = [p.decode("utf-8", "replace") for p in parts[lo : lo + AT_ONCE * JOINED]]
            out += [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def letters(self, words: list[bytes]) -> list[bytes]:
        """Words of letters, many in one text. Each gives one end of a word at least; if there are more, they go one by one."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for lo in range(0, len(groups), AT_ONCE):
            part = groups[lo : lo + AT_ONCE]
            for group, e in zip(part, self.whole.encode_batch_fast([b" ".join(g).decode() for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
                if len(ends) != len(group):  # or a tokenizer that does not mark the ends of words
                    out += self.plain(group)
                    continue
                raw = ids.tobytes()
                starts = [0, *ends.tolist()]
                out += [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        return out

    def parts(self, parts: list[bytes]) -> list[bytes]:
        cache = worker_cache("wordbpe-halves", CACHE_HALVES)
        cache[b""] = b""
        heads = [p.rstrip(_SIGNS) for p in parts]
        # Signs come off behind an ASCII letter or digit alone. The tokenizer lower-cases; with letters of ASCII that can be done before.
        heads = [(h.lower() if h.isalpha() else h) if h[-1:].isalnum() else p for h, p in zip(heads, parts, strict=True)]
        every = b" ".join(parts)
        if any(t in every for t in self.added):
            heads = [p if any(t in p for t in self.added) else h for h, p in zip(heads, parts, strict=True)]
        tails = [p[len(h) :] for h, p in zip(heads, parts, strict=True)]
        missing = {*heads, *tails}.difference(cache)
        words, others = [], []
        for h in missing:
            (words if h.isalpha() or not h.isascii() and h.decode("utf-8", "replace").isalpha() else others).append(h)
        cache.update(zip(words, self.letters(words), strict=True))
        cache.update(zip(others, self.plain(others), strict=True))
        get = cache.__getitem__
        return [a + b if b else a for a, b in zip(map(get, heads), map(get, tails), strict=True)]

    def __call__(self, raws: list[bytes]) -> list[bytes]:
        cache = worker_cache("wordbpe", CACHE_PARTS)
        cut = [r.split() for r in raws]
        missing = list(set().union(*cut).difference(cache))
        cache.update(zip(missing, self.parts(missing), strict=True))
        get = cache.__getitem__
        return [b"".join(map(get, ps)) for ps in cut]


def token_pieces(docs, definition: str, window: int, end_id: int = 0, with_ids: bool = True):
    """Rows (doc_id, piece, start, length, ids_crc32, ids): each text's ids and end_id, cut every `window` ids.

    definition is the tokenizer's JSON text, not its path: executors need no file. ids are little-endian unsigned 32-bit
    numbers in a binary column, left out without with_ids. Null texts count as empty and give end_id alone. Rows with null or repeated doc_ids are
    encoded like any other; other columns are not read.
    """
    import zlib
    from collections.abc import Iterator

    import pyarrow as pa

    from graphprep.llm.common import map_batches, text_bytes

    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    end, step = array("I", [end_id]).tobytes(), 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(encode(text_bytes(b.column(1).slice(lo, 1000))), lo):
                    x += end
                    for p, at in enumerate(range(0, len(x), step)):
                        part = x[at : at + step]
                        rows.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                made = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                give_back()

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""), caches="wordbpe")


def encoder_of(definition: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("wordbpe-encoder")
    if cache.get("definition") != definition:
        worker_cache("wordbpe").clear()
        cache.update(definition=definition, encoder=WordEncoder(definition))
        give_back()
    return cache["encoder"]
