"""Spelling variants against their definition."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from graphprep.llm import variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_definition(rows, damaged=97, least_chars=5, least_count=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, t in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_chars and c >= least_count}
    around = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in around.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    stems = ["".join(r.choice("abcdéÀß") for _ in range(r.randint(4, 9))) for _ in range(60)]

    def word():
        w = stems[min(int(r.expovariate(0.08)), 59)]
        k = r.randint(0, len(w))
        return r.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + r.choice("abx") + w[k:], w[:k] + "e" + w[k + 1 :], w + w[-1:]])

    out = [(i, " ".join(word() for _ in range(r.randint(0, 200))) + r.choice([".", "", " x÷y×z 12"])) for i in range(150)]
    return [*out, (1000, None), (1001, ""), (3, out[3][1]), (None, out[5][1]), (1002, ("x" * 70_000 + " ") * 3 + "x" * 69_999)]


@pytest.mark.parametrize(("shard_words", "damaged"), [(variants.SHARD_WORDS, 7), (5, 97)])
def test_variants_by_definition(spark, rows, monkeypatch, shard_words, damaged):
    """Also with halves that very many words share, for shards of five words."""
    monkeypatch.setattr(variants.near_words, "__defaults__", (shard_words,))
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = variants.group_variants(df, damaged).collect()
    want = by_definition(rows, damaged)
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want and len(got) == len(want) > 100
    assert sum(v[0] is not None for v in want.values()) > 30 and any(v[0] and v[0] != v[1] for v in want.values())


def test_no_words(spark):
    assert variants.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group_variants(spark.createDataFrame([(1, "12 ab"), (2, None)], "doc_id long, text string")).count() == 0


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w30"), ("b", "c")]
    got = dict(variants.roots(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "a": "w37", "b": "c"}
    with pytest.raises(ValueError):
        variants.group_variants(spark.createDataFrame([], "doc_id long, text string"), factor=1)


def test_index_counts_what_it_extends():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(200)})
    index = variants.WordIndex([np.array([ord(c) - 95 for c in w]) for w in words])
    text = "$" + "$".join(words) + "$"
    for pattern in ("a", "ab", "bca", "cc", "abcabc"):
        lo, hi = np.array([0]), np.array([len(words) + 1])  # from the delimiter to the left
        for c in pattern:
            lo, hi = index.step(np.array([ord(c) - 95]), lo), index.step(np.array([ord(c) - 95]), hi)
        assert hi[0] - lo[0] == len(regex.findall(regex.escape(pattern[::-1] + "$"), text, overlapped=True))
        assert sorted(words[k] for k in index.begun(lo, hi)[1]) == [w for w in words if w == pattern[::-1]]
