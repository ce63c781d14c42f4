"""Repeated strings against their definition."""

import random

import numpy as np
import pytest

from graphprep.llm import suffixes


def by_definition(rows, length):
    """rows (doc_id, text), each doc_id once: what remove_repeats gives."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            x = raw[p : p + length]
            if x in seen:
                covered[p : p + length] = True
            seen.add(x)
        out[i] = (len(raw), int(covered.sum()), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~covered]))
    return out


def found(df, *args, **kwargs):
    return [(x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept))) for x in suffixes.remove_repeats(df, *args, **kwargs).collect()]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [text(r.randint(60, 400)) for _ in range(12)]

    def cut():
        p = r.choice(passages)
        return p[r.randint(0, 40) : len(p) - r.randint(0, 40)]

    def changed():
        p, k = r.choice(passages), r.randint(0, 50)
        return p[:k] + "X" + p[k + 1 :]

    make = [lambda: text(r.randint(0, 90)), lambda: r.choice(passages), cut, changed]
    out = [(i * 3, "".join(r.choice(make)() for _ in range(r.randint(0, 6)))) for i in range(150)]
    # One passage in a third of all documents, copies, runs of one byte and of two, and the edges.
    out += [(500 + i, text(50) + passages[0] + text(20)) for i in range(80)]
    return [*out, (1000, None), (1001, ""), (1002, "a" * 700), (1003, "ab" * 400), (1004, out[5][1]), (1005, out[5][1]), (7, "a" * 150)]


@pytest.mark.parametrize(("length", "gram", "sent"), [(100, 40, None), (30, 8, 0), (64, 33, 0)])
def test_repeats_by_definition(spark, rows, monkeypatch, length, gram, sent):
    if sent is not None:  # runs meet the texts in joins
        monkeypatch.setattr(suffixes, "SENT_ROWS", sent)
    want = by_definition(rows, length)
    assert sum(v[1] > 0 for v in want.values()) > 100
    assert dict(found(spark.createDataFrame(rows, "doc_id long, text string"), length, gram)) == want


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    r = random.Random(2)
    base = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, base), (2, "x" + base[1000:150_000] + "y"), (3, base[:99]), (4, base[:100])]
    want = {1: (200_000, 0, 0), 2: (149_002, 149_000, 1), 3: (99, 0, 0), 4: (100, 100, 1)}
    cut = lambda n: [list(suffixes.runs_of([base.encode()], 100, 40)) for suffixes.SEGMENT in (n,)][0]
    monkeypatch.setattr(suffixes, "SEGMENT", 7000)
    parts = cut(7000)
    assert sum(x[4].sum() for x in parts) == 200_000 - 99
    assert len({i for x in parts for s, n in zip(x[3], x[4]) for i in range(s, s + n)}) == 200_000 - 99
    monkeypatch.undo()
    assert {i: v[:3] for i, v in found(spark.createDataFrame(rows, "doc_id long, text string"))} == want


def test_repeated_and_null_ids_and_clashing_columns(spark):
    a, b = "abcdefghij" * 3 + "0123456789" * 2, "the quick brown fox jumps over the lazy dog again"
    rows = [(2, a, "n"), (2, a, "m"), (2, b, "n"), (None, b, "n"), (None, None, "n"), (3, a + b, "n")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, tag string, n_bytes int, _repeats_runs int")
    out = suffixes.remove_repeats(df, 30, 8)
    assert out.columns == ["doc_id", "text", "tag", "kept", "n_bytes", "n_removed", "n_spans"] and out.count() == 6
    got = {(x.doc_id, x.text, x.tag): (x.n_bytes, x.n_removed) for x in out.collect()}
    own = by_definition([(0, a)], 30)[0][1]  # a repeats itself
    assert got[2, a, "n"] == got[2, a, "m"] == (len(a), own)
    assert got[None, b, "n"] == (len(b), 0) and got[2, b, "n"] == (len(b), len(b)) and got[None, None, "n"] == (0, 0)
    assert got[3, a + b, "n"] == (len(a + b), len(a + b))


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_identifiers_name_their_bytes():
    r = np.random.default_rng(0)
    raw = r.integers(0, 3, 5000).astype(np.uint8)
    for gram in (8, 11, 16, 40):
        ids, names = suffixes.identifiers(raw, gram), {}
        for p, x in enumerate(ids.tolist()):
            assert names.setdefault(raw[p : p + gram].tobytes(), x) == x
        assert len(set(names.values())) == len(names)


def test_folders_of_other_threads_stay(spark):
    """What a query leaves is its own to delete, whatever runs beside it."""
    from concurrent.futures import ThreadPoolExecutor

    from graphprep.llm import common

    before = common.written(spark)
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: common.materialize(spark.range(3), "other")).result()
    own = common.materialize(spark.range(4), "own")
    assert len(common.written(spark) - before) == 1
    common.discard(spark, common.written(spark) - before)
    assert other.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(own._graphprep_path).count()
