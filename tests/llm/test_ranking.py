"""Ranked search against its definition."""

import math
import random
from collections import Counter

import pytest
import regex

from graphprep.llm import ranking

TERM = regex.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def by_definition(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    many, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * c + 1))) for t, c in df.items()}
    out = set()
    for q, text in set(items):
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * many // max(1, total)
            s = sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if t in b)
            if s > 0:
                scored.append((-s, -1 if i is None else i, i))
        out |= {(q, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(6)
    words = ["alpha", "Beta", "gamma9", "Éa", "éa", "日本", "x", "7"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\x7f", "_"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # a class larger than any result
    docs += [(2000 + i, " ".join(reversed(terms(docs[7][1])))) for i in range(30)]
    docs += [(3000, None), (3001, ""), (3002, "-- \x00"), (5, docs[5][1]), (None, text(20)), (3003, "alpha " * 100_000)]
    items = [(i, text(r.randint(0, 12))) for i in range(25)] + [(100, docs[7][1]), (101, None), (102, "unseen"), (3, "alpha"), (4, "beta w1"), (4, "beta w1")]
    return docs, items


@pytest.mark.parametrize(("top", "block", "at_once"), [(50, 2000, 4_000_000), (7, 6, 300)])
def test_ranks_by_definition(spark, tables, monkeypatch, top, block, at_once):
    docs, items = tables
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", block)
    monkeypatch.setattr(ranking, "AT_ONCE", at_once)
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n int, hash int").repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    got = [tuple(x) for x in ranking.rank_documents(d, i, top).collect()]
    want = by_definition(docs, items, top)
    assert set(got) == want and len(got) == len(want)
    assert any(x[2] >= 1000 for x in got)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert ranking.rank_documents(none, items).count() == 0
    assert ranking.rank_documents(some, items.where("item_id > 1")).count() == 0
    assert [tuple(x) for x in ranking.rank_documents(some, items).collect()] == [(1, 1, 1, by_score()) for _ in range(1)]


def by_score():
    w = math.floor(1000 * math.log(4 / 3))
    return 2 * (w * (1_000_000_000 // (1000 + 20 * 100)))
