"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import bisect
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

random.seed(3)
VOCABULARY = ["".join(random.choices(string.ascii_lowercase, k=random.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


LONG_LINE = "this passage is shared by many documents here"


def fixture():
    rows = [(i, prose(5 + 7 * (i % 9), i)) for i in range(40)]
    rows += [(100 + i, f"Head {i}\n  {LONG_LINE.upper()}\t\nend {prose(6, 500 + i)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "Été 中文 naïve \U0001f600"), (204, prose(4000, 9)), (205, prose(4000, 9)), (206, "a" * 5000)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[3][1].upper())]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators use inside.
    schema = "doc_id long, text string, key string, shard int, size long, word string, node long, n long"
    return spark.createDataFrame([(i, t, "x", 1, 2, "w", 3, 4) for i, t in fixture()], schema).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_components_in_tasks_and_in_rounds(spark):
    from graphprep.llm.common import components

    r = random.Random(5)
    ids = [(r.randrange(1 << 62) - (1 << 61)) for _ in range(3000)]
    path = list(zip(ids[:1000], ids[1:1000]))  # one component, its ids in no order
    pairs = [(ids[1000 + r.randrange(2000)], ids[1000 + r.randrange(2000)]) for _ in range(1500)]
    hub = [(1 << 62, x) for x in range(500)]
    every = path + pairs + hub + hub[:20] + [(7_000, 7_000)]
    label = {x: x for e in every if e[0] != e[1] for x in e}
    for _ in label:
        before = dict(label)
        for a, b in every:
            if a != b:
                label[a] = label[b] = label[label[a]] = label[label[b]] = min(label[a], label[b], label[label[a]], label[label[b]])
        if label == before:
            break
    want = {k: v for k, v in label.items() if k != v}
    edges = spark.createDataFrame([*every, (None, 3), (4, None)], "a long, b long").repartition(4)
    for task_edges in (1 << 18, 300):  # all in one task; steps of joins until few enough, or the same, are left
        assert {x.id: x.component for x in components(edges, task_edges=task_edges).collect() if x.id != x.component} == want
    assert components(edges.where("a is null")).count() == 0


def test_components_of_few_edges_need_few_jobs(spark):
    """Each round of joins cost the driver some ten stages; with 211 shuffle partitions most of the pipeline's tasks were these."""
    from graphprep.llm.common import components

    edges = spark.range(2000).selectExpr("id as a", "id + 1 as b").repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("components", "few edges")
    try:
        assert components(edges).count() == 2000
        assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 8
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)


def test_brown_scores(docs, none):
    from graphprep.llm.brown import score, train

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    for frequent in (40, 10_000):  # most words rare, or none
        got = {r.doc_id: r for r in score(docs, train(docs.where(~held), classes=4, frequent=frequent, sweeps=2), held).collect()}
        texts = dict(fixture())
        out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
        c = Counter(w for i, t in texts.items() if not out[i] for w in [*tokens(t), None])
        n, v = sum(c.values()), len(c)
        assert set(got) == set(texts)
        for i, t in texts.items():
            ws = [*tokens(t), None]
            assert got[i].held_out == out[i] and got[i].n_tokens == len(ws) and got[i].n_known == sum(c[w] > 0 for w in ws) and got[i].train_tokens == n
            assert abs(got[i].base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
            assert got[i].score < 0 and math.isfinite(got[i].score)
    model = train(docs, classes=4, frequent=10_000, sweeps=2)
    # After any history the known words and "unknown" have probability one in all.
    mass = (10 ** model.transitions()[:, model.word_class] * (model.word_counts / model.class_counts[model.word_class])).sum(axis=1) + model.unknown
    assert np.allclose(mass, 1)
    assert score(none, train(none)).count() == 0
    assert score(docs, train(none)).where("score is null or isnan(score)").count() == 0


@pytest.mark.parametrize("frequent", [25, 10_000])  # most words make one step, or all are swept
def test_brown_scores_by_brute_force(docs, monkeypatch, frequent):
    from graphprep.llm import brown

    monkeypatch.setattr(brown, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(brown, "TASK_WORDS", 100)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = brown.train(docs.where(~held), classes=5, frequent=frequent, sweeps=2)
    found = {bytes(r.word): (r.n, r.cls) for r in model.words.collect()}
    texts = {i: [*(w.encode() for w in tokens(t)), b" "] for i, t in fixture()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in texts.items() if not out[i] for w in ws)
    assert {w: n for w, (n, _) in found.items()} == c
    total, unknown = sum(c.values()), (sum(n == 1 for n in c.values()) + 1) / (sum(c.values()) + 2)
    pair, size = Counter(), Counter()
    for i, ws in texts.items():
        if not out[i]:
            kinds = [found[w][1] for w in ws]
            pair.update(zip([5, *kinds], kinds))
            size.update(kinds)
    past = Counter()
    for (h, _), n in pair.items():
        past[h] += n

    def want(ws):
        s, h = 0.0, 5
        for w in ws:
            if w in found:
                n, k = found[w]
                s += math.log10((1 - unknown) * (pair[h, k] + brown.PRIOR * size[k] / total) / (past[h] + brown.PRIOR) * n / size[k])
                h = k
            else:
                s, h = s + math.log10(unknown), None
        return s

    for got in (brown.score(docs, model, held), brown.train_and_score(docs, held, classes=5, frequent=frequent, sweeps=2)[0]):
        got = {r.doc_id: r.score for r in got.collect()}
        assert all(abs(got[i] - want(ws)) < 1e-6 for i, ws in texts.items())


def test_brown_edge_rows(spark):
    from graphprep.llm.brown import score, train, train_and_score

    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 2), (None, None, 3), (None, "", 4), (2, "zz " * 3000, 5)], "doc_id long, text string, score int")
    for rows in (score(df, train(df, classes=3, sweeps=1)).collect(), train_and_score(df, F.lit(None).cast("boolean"), classes=3, sweeps=1)[0].collect()):
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in rows) == [("1", 3, 3), ("1", 3, 3), ("2", 3001, 3001), ("None", 1, 1), ("None", 1, 1)]
    assert train_and_score(df.where("false"), F.lit(False))[0].count() == 0


def test_brown_packs_what_it_shuffles(spark):
    """Counts go packed, and words do not go with the codes: what passes shuffles is less than the texts."""
    import time

    from graphprep.llm.brown import _pack, _unpack, train_and_score

    for values in ([], [0], [255, 0, 256], [7, 2**31, 2**40]):
        assert _unpack(_pack(np.array(values, np.int64)), len(values)).tolist() == values
    r = np.random.default_rng(5)
    texts = [(i, " ".join(f"word{k % 30_000:x}" for k in r.zipf(1.25, 1000).tolist())) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8).cache()
    df.count()

    def sent():
        time.sleep(2)  # until the listener has the last tasks
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = sent()
    assert train_and_score(df, F.col("doc_id") % 7 == 2, frequent=2000)[0].count() == len(texts)
    assert sent() - before < 1.5 * sum(len(t) for _, t in texts)


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                found.setdefault(k, set()).add(i)
    top = {k: max(v) for k, v in found.items() if len(v) >= min_docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if top.get(key(x), i) == i) for i, t in rows}


def test_line_dedup(docs, none):
    from graphprep.llm.linededup import dedup_lines

    want = brute_lines(fixture())
    kept = dedup_lines(docs, stats=True)
    assert kept.columns[: len(docs.columns)] == docs.columns
    for r in kept.collect():
        assert (r.text or "") == want[r.doc_id]
    assert dedup_lines(none).count() == 0


def test_line_dedup_deals_hot_shards_and_keys(docs, monkeypatch):
    from graphprep.llm import linededup

    monkeypatch.setattr(linededup, "TASK_REFS", 2)
    monkeypatch.setattr(linededup, "HOT_DOCS", 3)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
    want = brute_lines(fixture())
    assert {r.doc_id: r.text or "" for r in linededup.dedup_lines(docs).collect()} == want


def test_line_dedup_edge_rows(spark):
    from graphprep.llm.linededup import dedup_lines

    line = "a line of more than twenty characters"
    rows = [(1, line, "x"), (1, f"{line}\nmore", "y"), (2, line.upper(), "z"), (3, f"  {line}\t", None), (None, line, "n"), (4, None, "e"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone_keys string")
    got = {(r.doc_id, r.text, r._gone_keys) for r in dedup_lines(df).collect()}
    # Equal doc_ids are one document; a row without doc_id keeps its lines; the clashing column stays.
    assert got == {(1, "", "x"), (1, "more", "y"), (2, "", "z"), (3, f"  {line}\t", None), (None, line, "n"), (4, None, "e"), (5, "", "e")}


def test_line_index_counts_its_keys(docs):
    from graphprep.llm.linededup import build_index, delete_documents, insert_documents

    whole = build_index(docs)
    grown = insert_documents(build_index(docs.where("doc_id < 103")), docs.where("doc_id >= 103"))
    n = lambda ix: ix.filters.agg({"n_keys": "sum"}).first()[0] or 0
    assert n(grown) == n(whole) == whole.counts.count()
    assert n(delete_documents(grown, docs.select("doc_id"))) == 0


def test_line_index_is_reversible(docs, spark):
    from graphprep.llm.linededup import build_index, delete_documents, drop_lines, insert_documents

    first, later = docs.where("doc_id < 103"), docs.where("doc_id >= 103")
    index = insert_documents(build_index(first), later)
    texts = lambda ix, d: {r.doc_id: r.text or "" for r in drop_lines(d, ix).collect()}
    assert texts(index, docs) == brute_lines(fixture())
    back = delete_documents(index, later.select("doc_id"))
    assert texts(back, first) == brute_lines([r for r in fixture() if r[0] < 103])


def test_cuckoo_filter():
    from graphprep.llm.linededup import CuckooFilter

    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = CuckooFilter(len(h))
    assert f.insert(h) and f.contains(h).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.05
    assert CuckooFilter(table=f.tobytes()).contains(h[2500:]).all()


def test_golay_keys_meet_within_two_bits():
    from graphprep.llm.simhash import golay_keys

    r = np.random.default_rng(0)
    v = r.integers(0, 1 << 23, 4000)
    a, ra = golay_keys(v)
    for flips in (1, 2):
        w = v.copy()
        for _ in range(flips):
            w ^= 1 << r.integers(0, 23, len(v))
        b, rb = golay_keys(w)
        assert ((a[:, :, None] == b[:, None, :]) & ra[:, :, None] & rb[:, None, :]).any(axis=(1, 2)).all()


def groups_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("paired", [256, 1])
def test_simhash(docs, none, monkeypatch, paired):
    from graphprep.llm import simhash

    monkeypatch.setattr(simhash, "PAIRED", paired)
    want = {}
    for i, t in fixture():
        w = tokens(t)
        s = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = groups_of(list(want), lambda a, b: bin(want[a] ^ want[b]).count("1") <= 2)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i].fp % (1 << 64) == want[i] and got[i].component_id == comp[i] for i in want) and len(got) == len(want)
    assert simhash.near_duplicates(none).count() == 0


def test_near_texts(spark):
    from graphprep.llm.neardup_texts import drop_near_duplicates, group_near_duplicates

    rows, n = [], 0
    for g in range(12):
        base = prose(120, 1000 + g).split(" ")
        for c in range(6):
            w = list(base)
            for k in range(c % 4):
                w[10 + 23 * k] = f"edit{g}x{c}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(900, None), (901, ""), (902, prose(3, 4)), (903, prose(3, 4))]
    sh = lambda t: {" ".join(w[j : j + 5]) for w in [tokens(t)] for j in range(max(1, len(w) - 4))} if tokens(t) else set()
    sets = {i: sh(t) for i, t in rows}
    like = lambda a, b: (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    want = groups_of(list(sets), like)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in group_near_duplicates(df).collect()} == want
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == set(want.values())


def test_near_texts_with_passages_changed(spark):
    from graphprep.llm.neardup_texts import group_near_duplicates

    rows, bands = [], Counter()
    sets = {}
    for g in range(150):
        r = random.Random(9000 + g)
        base = prose(r.randint(40, 900), 2000 + g).split()
        # The passage's share of the text that makes the wanted index: what stays over all.
        goal, kind, other = r.uniform(0.79, 0.96), g % 3, prose(400, 6000 + g).split()
        more, at = other[: int(len(base) * (1 / goal - 1))], r.randint(5, len(base) - 5)
        changed = [base + more, base[: int(len(base) * goal)], base[:at] + more + base[at:]][kind]
        for k, w in enumerate((base, changed)):
            rows.append((2 * g + k, " ".join(w)))
            ws = tokens(rows[-1][1])
            sets[2 * g + k] = {" ".join(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))}
        a, b = sets[2 * g], sets[2 * g + 1]
        bands[kind, min(3, int((len(a & b) / len(a | b) - 0.75) / 0.05))] += 1
    assert all(bands[kind, band] >= 5 for kind in range(3) for band in (1, 2, 3))
    want = groups_of(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in group_near_duplicates(df).collect()} == want


def test_sharding(docs, none):
    from graphprep.llm.sharding import assign

    rows = assign(docs.unionByName(docs.where("doc_id = 5")), shards=5, vnodes=16).collect()
    texts = dict(fixture())
    assert len(rows) == len(texts) + 1
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert assign(none).count() == 0


def test_sharding_follows_the_ring(docs):
    """One after another, each to the first shard clockwise with room."""
    from graphprep.llm.sharding import PLACES, assign, ring_orders

    place = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(PLACES)).alias("p")).collect()}
    rows = sorted(assign(docs, shards=4, vnodes=8).collect(), key=lambda r: r.arrival)
    orders, room = ring_orders(4, 8), [len(rows) // 4 + (s < len(rows) % 4) for s in range(4)]
    for r in rows:
        s = next(s for s in orders[place[r.doc_id]] if room[s])
        room[s] -= 1
        assert r.shard == s


def test_sharding_moves_little(docs):
    from graphprep.llm.sharding import assign

    a, b = ({r.doc_id: r.shard for r in assign(docs, shards=k, vnodes=64).collect()} for k in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.6 * len(a)


def test_byte_bpe(docs):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    from graphprep.llm.bytebpe import decode, encode, read_ranks

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    t = read_ranks(path)
    odd = [(1000, " lead"), (1001, "trail "), (1002, "two  spaces\n\nand  lines \n x"), (1003, "it's we'll I'd nbsp wide"), (1004, "\x1cfs\x1dgs <|endoftext|>"), (1005, "tab\there\r\nnext"), (1006, "\n"), (1007, "a \n b")]
    rows = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    texts = dict(fixture() + odd)
    for r in decode(encode(rows, t, P.PATTERN), t).collect():
        raw = texts[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(raw), r.doc_id
        assert bytes(r.decoded) == raw.encode()


def test_png():
    from graphprep.llm.media import ROW, appearance_hash, payload_of, read_png, unfilter, write_png

    for raw in (b"", b"x", b"abc" * 1000, bytes(range(256)) * 30):
        p = payload_of(raw)
        assert len(p) % ROW == 0 and p.startswith(raw)
        blob = write_png(p)
        assert read_png(blob).tobytes() == p and len(appearance_hash(read_png(blob))) == 8
        for bad in (blob[:-3], blob[:40] + bytes([blob[40] ^ 1]) + blob[41:], b"GIF" + blob[3:], blob + b"x"):
            with pytest.raises((ValueError, zlib.error)):
                read_png(bad)
    # All five row filters, by the definition.
    r = np.random.default_rng(0)
    want = r.integers(0, 256, (10, 12)).astype(np.uint8)
    coded = np.zeros((10, 13), np.uint8)
    for y in range(10):
        coded[y, 0] = kind = y % 5
        for x in range(12):
            a = int(want[y, x - 3]) if x >= 3 else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded[y, 1 + x] = (int(want[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
    assert (unfilter(coded, 3) == want).all()


def test_media_columns(docs, spark):
    from graphprep.llm.media import payload_of, read_media, with_media

    texts = dict(fixture())
    made = with_media(docs)
    assert set(docs.columns) < set(made.columns)
    for r in read_media(made, "doc_id").collect():
        raw = (texts[r.key] or "").encode()
        assert bytes(r.payload) == payload_of(raw) and r.n_bytes == len(raw) and r.error is None
    bad = spark.createDataFrame([(1, bytearray(b"junk"), 3), (2, None, 0)], "doc_id long, media binary, media_payload_bytes long")
    assert all(r.payload is None and r.error for r in read_media(bad, "doc_id").collect())


def best_fit_decreasing(lengths, window=2048):
    """Number of windows, piece by piece."""
    spaces = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(spaces, x)
        bisect.insort(spaces, (spaces.pop(i) if i < len(spaces) else window) - x)
    return len(spaces)


def packed_windows(spark, rows):
    """Check a packing of rows (doc_id, piece, length); its number of windows."""
    from graphprep.llm.packing import pack

    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long")).collect()
    assert Counter((x.doc_id, x.piece, x.length) for x in got) == Counter(rows)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing(spark):
    from graphprep.llm.packing import pack

    r = random.Random(5)
    rows = [(i, p, r.choice([1, 7, 60, r.randint(1, 2048), 2048, 700, 700])) for i in range(400) for p in range(r.randint(1, 2))]
    rows += [(9999, 0, 300)] * 5
    assert packed_windows(spark, rows) <= best_fit_decreasing(x[2] for x in rows)
    assert pack(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0


def test_packing_needs_no_more_than_best_fit(spark):
    for seed, (mean, spread) in enumerate(((6.5, 0.5), (6.0, 1.0), (6.9, 0.3))):
        r = np.random.default_rng(seed)
        lengths = np.clip(r.lognormal(mean, spread, 4000).astype(int), 1, 2048).tolist()
        most = best_fit_decreasing(lengths)
        assert -(-sum(lengths) // 2048) <= packed_windows(spark, [(i, 0, x) for i, x in enumerate(lengths)]) <= most


def test_column_generation_reaches_its_gap():
    from graphprep.llm.packing import GAP, SMALL_PART, WINDOW, _inverse, _knapsack, _simplex

    r = random.Random(11)
    sizes = np.array(sorted(r.sample(range(WINDOW // SMALL_PART + 1, 1400), 125), reverse=True))
    demand = np.array([float(r.randint(50, 150)) for _ in sizes])
    columns, _ = _simplex(np.diag(WINDOW // sizes), demand, WINDOW, sizes)
    assert _knapsack(_inverse(columns).sum(axis=0), sizes, WINDOW)[0] <= 1 + GAP + 1e-9


def test_token_pieces(docs):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    from graphprep.llm.wordbpe import token_pieces

    path = P.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    with open(path) as f:
        got = token_pieces(docs, f.read(), 64).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == 64 * r.piece and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    for i, text in fixture():
        assert np.frombuffer(ids[i], "<u4").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_are_encoded_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    from graphprep.llm.wordbpe import WordEncoder

    with open(P.path("word_bpe_49k.json")) as f:
        definition = f.read()
    t, encode, r = tokenizers.Tokenizer.from_str(definition), WordEncoder(definition), random.Random(3)
    some = ["a", "B", "é", "'s", "'", "’", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", " ", "\n", "\t", "9", "12", ",", "...", "!", "\u0301", "ß", "İ", "日本", "\u00a0", "\x1c", "½", "_", "don't", "I'LL", "x'd,", "\x00", "é,", "١"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    for text, got in zip(texts, encode([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_toxicity_chain(spark, none):
    from graphprep.llm.toxicity import fit, predict

    rows, labels = [], []
    for i in range(600):
        rude, sloppy = i % 4 == 0, i % 3 == 0
        text = prose(40, 3000 + i) + (f" {random.Random(i).choice(['idiotz', 'moronz', 'scumz'])}" if rude else "") + (" zzjunk zzspam" if sloppy else "")
        rows.append((i, text, "keep"))
        if i < 400:
            labels.append((i, sloppy, rude))
    rows += [(1000, None, "keep"), (1001, "", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_rude string")
    marked = spark.createDataFrame([*labels, (None, True, True), (5, None, True)], "doc_id long, sloppy boolean, rude boolean")
    chain = fit(docs, marked, ["sloppy", "rude"])
    got = {r.doc_id: r for r in predict(docs, chain).collect()}
    held = [i for i in range(400, 600)]
    assert np.mean([got[i].is_rude == (i % 4 == 0) for i in held]) > 0.97
    assert np.mean([got[i].is_sloppy == (i % 3 == 0) for i in held]) > 0.97
    assert not got[1000].is_rude and not got[1001].is_rude and len(got) == len(rows)
    empty = fit(none, marked, ["sloppy", "rude"])
    assert predict(docs, empty).where("is_rude").count() == 0 and predict(none, chain).count() == 0


def test_vectors(spark):
    from graphprep.llm import neardup_vectors as V

    r = np.random.default_rng(4)
    base = r.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + r.normal(scale=0.15, size=(20, 24)), base[:5] * 3, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None] * 24), (504, [float("inf")] * 24)]
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.95
    comp = groups_of(range(len(x)), lambda a, b: near[a, b])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for tile in (1500, 7):
        V.TILE_ROWS = tile
        got = {g.vec_id: g for g in V.near_duplicates(df).collect()}
        assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == comp[i] for i in range(len(x)))
        assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(500, 505))
    V.TILE_ROWS = 8192
    assert V.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_surrogates(spark, none):
    from graphprep.llm.pii import replace_entities

    rows = [
        (1, "mail ann.34@mail7.example.com or ANN.34@MAIL7.EXAMPLE.COM now"),
        (2, "again ann.34@mail7.example.com; +1 (017) 555-7713 and 4111111111111111, 4111 1111 1111 1111."),
        (3, "ip 240.56.125.154. key = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" ssn 123-45-6789"),
        (4, "Frau Anna Becker met Mr. Ivan Petrov and Господин Иван Петров; Mr. Petrov left"),
        (5, "clean text, version 3.0 of 2024"),
        (6, None),
        (7, ""),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, kind string, canon string")
    got = {r.doc_id: r for r in replace_entities(df, "k", count="n").collect()}
    assert got[5].text == rows[4][1] and got[6].text is None and got[7].text == "" and got[6].n == got[7].n == got[5].n == 0
    a, b = re.findall(r"\S+@\S+", got[1].text)
    assert b == a.upper() and a in got[2].text and "mail7" not in got[1].text and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example", a)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{16}, \d{4} \d{4} \d{4} \d{4}\.", got[2].text)
    one, two = re.search(r"(\d{16}), ([\d ]{19})", got[2].text).groups()
    assert two.replace(" ", "") == one != "4111111111111111"
    digits = [int(d) for d in one][::-1]
    assert sum(digits[0::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    assert "240.56.125.154" not in got[3].text and "2abc3ff2" not in got[3].text and "123-45-6789" not in got[3].text
    assert re.search(r"^Frau [A-Z][a-z]+na [A-Z][a-z]+ met Mr\. [A-Z][a-z]+n [A-Z]\w+ and Господин [А-Я][а-я]+н [А-Я]", got[4].text)
    petrov = re.search(r"Mr\. \w+ (\w+) and", got[4].text)[1]
    assert f"Mr. {petrov} left" in got[4].text
    again = {r.doc_id: r.text for r in replace_entities(df, "other").collect()}
    assert again[1] != got[1].text
    assert replace_entities(none, "k").count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_surrogates_stay_distinct(spark, monkeypatch, most):
    """Short addresses crowd their format; all get surrogates of their own, none of them an address of the table."""
    from graphprep.llm import pii

    monkeypatch.setattr(pii, "CONSTANT_EXCEPTIONS", most)
    mails = [f"{c}{d}@x1.example.com" for c in "abcdefghijklmnopqr" for d in range(10)]
    df = spark.createDataFrame([(i, f"to {m} end") for i, m in enumerate(mails)], "doc_id long, text string")
    got = [r.text.split(" ")[1] for r in pii.replace_entities(df, "k").collect()]
    assert len(set(got)) == len(mails) and not set(got) & set(mails)


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(60, 7000 + i), "en", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " tail", "en", "s", 0)]
    rows += [(200 + i, prose(60, 8000 + i) + f" idiotz {i} idiotz", "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(range(60))


def test_account_numbers_keep_their_check(spark):
    from graphprep.llm.pii import replace_entities

    def right(iban):
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1

    given = ["GB82WEST12345698765432", "DE89370400440532013000", "FR1420041010050500013M02606", "GB82WEST12345698765433", "DE88370400440532013000"]
    rows = spark.createDataFrame([(i, f"pay {x} now") for i, x in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: r.text.split()[1] for r in replace_entities(rows, "k").collect()}
    for i, x in enumerate(given):
        assert got[i] != x and got[i][:2] == x[:2] and len(got[i]) == len(x) and right(got[i]) == right(x) == (i < 3)


def test_surrogates_by_brute_force(spark):
    regex = pytest.importorskip("regex")
    from graphprep.llm import pii

    r, texts = random.Random(8), []
    make = [
        lambda: f"{r.choice('abcde')}{r.randint(1, 30)}@mail{r.randint(1, 3)}.org",
        lambda: f"{r.randint(100, 130)}-555-{r.randint(1000, 1050)}",
        lambda: f"{r.randint(100, 120)}-{r.randint(10, 20)}-{r.randint(1000, 1020)}",
        lambda: f"10.0.{r.randint(0, 3)}.{r.randint(0, 20)}",
        lambda: f"{r.choice(['Mr.', 'Mrs.', 'Frau', 'Herr'])} {r.choice(['Anna', 'Otto', 'Ivan'])} {r.choice(['Petrov', 'Stone', 'Muller'])}",
        lambda: "plain words",
    ]
    for _ in range(300):
        texts.append(" ; ".join(r.choice(make)() for _ in range(r.randint(0, 5))))
    texts += ["", None, "x" * 300_000 + " a1@mail1.org", "Mr. Ivan Petrov", "Mr. Ivan Petrov"]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, _pii_found string")
    got = {r.doc_id: r for r in pii.replace_entities(rows, "key", count="n").collect()}
    find = regex.compile(pii.ANY)
    made = {}
    for i, t in enumerate(texts):
        spots = [m.group() for m in find.finditer(t or "")]
        assert got[i].n == len(spots) and got[i]._pii_found == "kept" and (got[i].text is None) == (t is None)
        gaps = find.split(t or "")
        rest = got[i].text or ""
        for gap, m in zip(gaps, [*spots, None]):
            assert rest.startswith(gap)
            rest = rest[len(gap) :]
            if m is not None:
                after = gaps[gaps.index(gap) + 1] if gap else None
                new = regex.match(r"(?:(?! ; ).)*", rest).group()
                made.setdefault(m, set()).add(new)
                rest = rest[len(new) :]
        assert rest == ""
    # One surrogate for each entity, none for two of them, none that is an entity itself.
    assert all(len(v) == 1 for v in made.values())
    values = [next(iter(v)) for v in made.values()]
    assert len(set(values)) == len(values) and not set(values) & set(made)


def test_toxicity_by_brute_force(spark):
    from graphprep.llm.toxicity import fit, predict, text_features

    r = random.Random(4)
    rows = [(i, prose(30, i) + (" vile scum" if i % 5 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 5 == 0, r.random() < 0.3) for i, _ in rows], "doc_id long, toxic boolean, odd boolean")
    chain = fit(df, labels, ["toxic", "odd"])
    got = {x.doc_id: x for x in predict(df, chain).collect()}
    for i, t in rows:
        odds = []
        for k in range(2):
            known = [chain.features[f] for f in text_features(t) if f in chain.features]
            w, s = chain.weights[k], chain.scales[k]
            odds.append(chain.biases[k] + sum(s[f] * w[f] for f in known) + sum(o * v for o, v in zip(odds, w[len(s) :])))
        for name, o, cut in zip(("toxic", "odd"), odds, chain.cuts):
            assert abs(got[i]["p_" + name] - 1 / (1 + math.exp(-max(-40, min(40, o))))) < 1e-9 and got[i]["is_" + name] == (o > cut)
    assert sum(got[i].is_toxic == (i % 5 == 0) for i, _ in rows) >= 195


def test_appearance_by_the_definition():
    from graphprep.llm import media

    raw = media.payload_of((prose(400, 1) * 3).encode())
    samples = media.read_png(media.write_png(raw))
    grey = samples.astype(float).mean(axis=2)
    h, w = grey.shape
    g = media.GRID
    cell = lambda n, k: (k * n // g, max((k + 1) * n // g, k * n // g + 1))
    grid = [[grey[cell(h, y)[0] : cell(h, y)[1], cell(w, x)[0] : cell(w, x)[1]].mean() for x in range(g)] for y in range(g)]
    low = []
    for u in range(media.LOW):
        for v in range(media.LOW):
            low.append(sum(grid[y][x] * math.cos(math.pi * u * (2 * y + 1) / (2 * g)) * math.cos(math.pi * v * (2 * x + 1) / (2 * g)) for y in range(g) for x in range(g)))
    middle = float(np.median(np.round(low[1:], 6)))
    assert media.appearance_hash(samples) == np.packbits([round(x, 6) > middle for x in low]).tobytes()


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() against a plain chain of its stages: the same documents stay, with the same texts, packed whole."""
    import corpus_pipeline
    from graphprep.llm import common
    from graphprep.llm.pii import replace_entities
    from graphprep.llm.queries import surrogate_key
    from graphprep.llm.wordbpe import token_pieces

    public_tokenizers = pytest.importorskip("public_tokenizers")
    r = random.Random(12)
    line = "the same licence line stands in very many files"
    rows = []
    for i in range(90):
        words = prose(r.randint(40, 200), 400 + i).split()
        words = ["".join(c for c in w if c != "\n") for w in words]
        rows.append((i, " ".join(words) + (f"\n{line}" if i % 4 == 0 else "") + (" write to jo@mail.org" if i % 9 == 0 else "")))
    for k, (i, t) in enumerate(rows[:30]):  # near copies: a passage appended, cut or changed
        w = t.split(" ")
        cut = {0: [*w, *prose(max(1, len(w) // 10), 900 + k).split()], 1: w[: int(len(w) * 0.9)], 2: [*w[:5], "changed", *w[6:]]}[k % 3]
        rows.append((100 + i, " ".join(cut)))
    rows += [(200, None), (201, "")]
    table = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = common.written(spark)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Nothing is toxic here, so all documents come to the second stage.
    texts = brute_lines(rows)
    sh = lambda t: {" ".join(w[j : j + 5]) for w in [tokens(t)] for j in range(max(1, len(w) - 4))} if tokens(t) else set()
    sets = {i: sh(t) for i, t in texts.items()}
    comp = groups_of(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = [i for i in texts if comp[i] == i]
    assert {x.doc_id for x in got} == set(kept) and 60 < len(kept) < len(rows) - 10
    left = spark.createDataFrame([(i, texts[i]) for i in kept], "doc_id long, text string")
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        want = token_pieces(replace_entities(left, surrogate_key(spark)), f.read(), 2048)
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in want.collect())
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(sum(n for _, n in v) <= 2048 for v in by.values()) and len(by) <= best_fit_decreasing(x.length for x in got)
    # What the stages left behind has gone, but for their results.
    new = {p.rsplit("/", 1)[1] for p in common.written(spark) - before}
    assert not any(p.startswith(("near-", "line-", "toxicity-", "edges-")) for p in new)


def test_wide_rows_have_row_groups_of_their_own(spark):
    """A reader of chunks holds one or two, however many a file has."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from graphprep.llm.common import drop, materialize

    rows = spark.range(0, 12, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 20000), i -> sha2(string(id * 20000 + i), 256)), '') as binary)").alias("b"))
    made = materialize(rows, "wide", "zstd", 1 << 19)
    files = glob.glob(made._graphprep_path.removeprefix("file://") + "/*.parquet")
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) == 12
    assert {(r.id, r.n) for r in made.select("id", F.length("b").alias("n")).collect()} == {(i, 1280000) for i in range(12)}
    drop(spark, made)
