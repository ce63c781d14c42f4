"""CSV files of ids and labels whose line breaks are not escaped, read block by block.

Whether a line opens a row follows from the id that comes next, which follows from all lines before. A block of a file is
therefore read as a function from the next id at its beginning to that at its end: an id k at the beginning leads to the
first line that begins with k, from there to the next one that begins with k + 1, and so on. Ids that lead to the same end are kept
as ranges, so that a block is one range and one more for each line that only looks like a row. The functions of a file's blocks
are composed in order, which gives the next id at the beginning of each block, and a second pass reads all blocks at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPENS = re.compile(r"(0|[1-9][0-9]{0,17}),")


def block_function(ids: list[int]) -> list[tuple[int, int, int]]:
    """Ranges (first, last, end) of ids that lead to an end, of a block whose lines begin with these ids. Others lead to themselves."""
    ends: dict[int, int] = {}
    for k in reversed(ids):
        ends[k] = ends.get(k + 1, k + 1)
    out: list[tuple[int, int, int]] = []
    for k in sorted(ends):
        if out and out[-1][1] == k - 1 and out[-1][2] == ends[k]:
            out[-1] = (out[-1][0], k, ends[k])
        else:
            out.append((k, k, ends[k]))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Lines by block, in order; a block's lines come one after another."""
    from itertools import groupby

    rows = ((f, a, v) for b in batches for f, a, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for key, part in groupby(rows, key=lambda r: r[:2]):
        lines = (r[2] for r in part)
        if key[1] == 0:
            next(lines, None)  # the header
        yield key, lines


def read_continued(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, label) of a CSV of ids from 0 and labels whose line breaks are not escaped.

    A line that begins with the next id and a comma opens a row and gives what stands before its next comma; any other line
    belongs to the row before, without a break. The first line is a header. Ids of several files run from 0 in each.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), part in _runs(batches):
            found = block_function([int(m[1]) for m in map(_OPENS.match, part) if m]) or [(-1, -1, -1)]
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array([block] * len(found), pa.int64()), *[pa.array([r[k] for r in found], pa.int64()) for k in range(3)]], names=["file", "block", "first", "last", "end"])

    begins: list[tuple[str, int, int]] = []
    at, ranges = ("", -1), []

    def follow() -> None:
        """From one block to the next."""
        known = begins[-1][2]
        now[0] = next((end for a, b, end in ranges if a <= known <= b), known)

    now = [0]
    for r in lines.mapInArrow(functions, "file string, block long, first long, last long, end long").orderBy("file", "block", "first").toLocalIterator():
        if (r[0], r[1]) != at:
            if begins:
                follow()
            now[0] = now[0] if r[0] == at[0] else 0
            at, ranges = (r[0], r[1]), []
            begins.append((r[0], r[1], now[0]))
        ranges.append(tuple(r[2:]))
    sent = {(f, b): k for f, b, k in begins}  # a number for each block

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), part in _runs(batches):
            ids, texts, n = [sent[file, block] - 1], [[]], sent[file, block]
            for line in part:
                m = _OPENS.match(line)
                if m and int(m[1]) == n:
                    ids.append(n)
                    texts.append([line[m.end() :].split(",", 1)[0]])
                    n += 1
                else:
                    texts[-1].append(line)
                if len(ids) > 10_000:
                    yield batch(file, block, ids[:-1], texts[:-1])
                    ids, texts = ids[-1:], texts[-1:]
            yield batch(file, block, ids, texts)

    def batch(file: str, block: int, ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
        some = [k for k in range(len(ids)) if ids[k] >= 0]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array([block] * len(some), pa.int64()), pa.array([ids[k] for k in some], pa.int64()), pa.array(["".join(texts[k]) for k in some], pa.string())], names=["file", "block", "id", "text"])

    pieces = lines.mapInArrow(labels, "file string, block long, id long, text string")
    whole = pieces.groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x"))  # a piece for each block that a row spans
    return whole.select(F.col("id").cast("int").alias("id"), F.array_join("x.text", "").alias("label"))
