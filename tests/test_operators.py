"""Worked cases on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import builders as B
from graphprep.operators import encode as E
from graphprep.operators import metrics as M
from graphprep.operators import rules as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def words(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def test_chain_has_both_directions(spark):
    ex = B.chain_examples(spark.range(1), words("a", "b", "a"), F.array(T.token(F.lit("b")))).first()
    assert [(e.src, e.dst, e.type) for e in ex.edges] == [(0, 1, "NEXT_TOKEN"), (1, 0, "REVERSED_NEXT_TOKEN"), (1, 2, "NEXT_TOKEN"), (2, 1, "REVERSED_NEXT_TOKEN")]
    assert (ex.n_nodes, ex.n_edges, ex.n_edge_types) == (3, 4, 2)


def test_empty_chain(spark):
    ex = B.chain_examples(spark.range(1), F.lit(None).cast("array<string>"), F.array(T.token(F.lit("x")))).first()
    assert (ex.n_nodes, ex.n_edges) == (0, 0)


def test_linearise(spark):
    out = F.array(T.token(F.lit("x")), T.pointer(F.lit(3)), T.label_class(F.lit("K")))
    r = one(spark, a=T.linearise(out), b=T.linearise(out, done=False, with_ids=True))
    assert r.a == ["x", "POINTER", "CLASS_K", "DONE"] and r.b == ["x", "POINTER(3)", "CLASS_K"]


def test_copy_pairs_take_tokens_only(spark):
    out = F.array(T.token(F.lit("a")), T.label_class(F.lit("a")), T.token(F.lit("b")))
    got = one(spark, p=E.copy_pairs(out, words("a", "b", "a"))).p
    assert [(x.output, x.node) for x in got] == [(0, 0), (0, 2), (2, 1)]


def test_vocabulary_counts_reserved_and_breaks_ties_by_token(spark):
    counts = spark.createDataFrame([("k", "a", 3), ("k", "c", 2), ("k", "b", 2), ("k", "d", 1), ("k", "<OOV>", 9)], "kind string, token string, cnt long")
    got = {r.token: r.id for r in E.vocabulary(counts, 4).collect()}
    assert got == {"<OOV>": 0, "<pad>": 1, "a": 2, "b": 3}


def test_impossible(spark):
    ids = F.array(F.lit(0), F.lit(5))
    none = F.array().cast("array<int>")
    r = one(spark, a=E.is_possible(ids, none), b=E.is_possible(ids, F.array(F.lit(0))))
    assert (r.a, r.b) == (False, True)


def test_pair_lengths_match_popping(spark):
    rows = [(a, b, most) for a in range(0, 14) for b in range(0, 14) for most in (1, 8, 9)]
    for most in (1, 8, 9):
        df = spark.createDataFrame([(a, b) for a, b, m in rows if m == most], "a int, b int")
        x, y = T.pair_lengths(F.col("a"), F.col("b"), most)
        for r in df.select("a", "b", x.alias("x"), y.alias("y")).collect():
            a, b = r.a, r.b
            while a + b > most:
                a, b = (a - 1, b) if a > b else (a, b - 1)
            assert (r.x, r.y) == (a, b), r


def test_mask_and_pad(spark):
    r = one(spark, m=E.mask(F.array(F.lit(2), F.lit(3)), F.lit(5)), p=E.pad(words("a"), 3, "<pad>"))
    assert r.m == [0, 0, 1, 1, 0] and r.p == ["a", "<pad>", "<pad>"]


def test_content_hash_ignores_edge_order(spark):
    ex = B.chain_examples(spark.range(1), words("a", "b"), F.array(T.token(F.lit("x"))))
    other = ex.withColumn("edges", F.reverse("edges"))
    assert R.content_hash(ex).first().content_hash == R.content_hash(other).first().content_hash


def test_runs(spark):
    longest, expected = M.runs(F.array(*map(F.lit, (True, True, False, False, True))))
    r = one(spark, a=longest, b=expected)
    assert r.a == 2 and abs(r.b - 0.8) < 1e-12


def test_micro_golden(spark):
    df = spark.createDataFrame([("code2seq eval", "code2seq eval test"), ("foo bar", "hello world")], "p string, t string").select(T.words(F.col("p")).alias("p"), T.words(F.col("t")).alias("t"))
    tp, fp, fn = M.overlap(F.col("p"), F.col("t"))
    s = df.agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    got = s.select(p.alias("p"), r.alias("r"), f.alias("f")).first()
    assert (got.p, got.r) == (0.5, 0.4) and abs(got.f - 0.4444444444444445) < 1e-15


def test_bootstrap_places():
    assert M.bootstrap_bounds(100, 90) == (10, 89)


def test_violations(spark):
    ex = B.chain_examples(spark.range(1), words("a", "b"), F.array(T.pointer(F.lit(7))))
    assert R.violations(ex).first().violations == ["V8_pointer_range"]


def test_pointer_texts(spark):
    df = spark.createDataFrame([("POINTER(1,x)",), ("POINTER(7,y) z",), ("foo",), ("BUG_FREE",), ("ERROR_LOCATION_5 a",), ("ERROR_LOCATION_1",)], "s string")
    got = [(r.a, r.b) for r in df.select(T.parse_pointer(F.col("s")).alias("a"), T.parse_error_location(F.col("s")).alias("b")).collect()]
    assert got == [(1, None), (7, None), (None, None), (None, 1), (None, 5), (None, None)]


def test_edit_scripts(spark):
    df = spark.createDataFrame([("NoOp",), ("del_node!#@$4",), ("replace_val!#@$1!#@$y",)], "s string")
    got = [r.x for r in df.select(T.linearise(T.parse_edit(F.col("s")), done=False, with_ids=True).alias("x")).collect()]
    assert got == [["NoOp"], ["del_node", "POINTER(4)"], ["replace_val", "POINTER(1)", "y"]]


def test_oversample_is_whole_and_repeatable(spark):
    rows = R.oversample(spark.range(200), F.lit(2.5), F.col("id"))
    n = rows.count()
    assert 400 <= n <= 600 and n == rows.count()


def test_first_edges_keep_their_place(spark):
    edges = [(3, 1, "X"), (0, 1, "A"), (3, 1, "X"), (0, 1, "B"), (0, 1, "A")]
    got = spark.createDataFrame([(edges,), ([],)], "e array<struct<src:int,dst:int,type:string>>").select(B.first_edges(F.col("e")).alias("e")).collect()
    assert [tuple(x) for x in got[0].e] == [(3, 1, "X"), (0, 1, "A"), (0, 1, "B")] and got[1].e == []


def test_edit_scripts_that_are_wrong(spark):
    for bad in ("turn!#@$1", "add_node!#@$1!#@$2", "del_node!#@$x"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "s string").select(T.parse_edit(F.col("s"))).collect()


def test_escape_all_is_repr(spark):
    texts = ["plain", "a\tb\n", "\x00\x7f", "caf\u00e9", "it's", 'both \' and "', "\u200b", None]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.escape_all(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else repr(t)[1:-1] for t in texts]


def test_integers_among_noise(spark):
    got = spark.createDataFrame([('[1, "2", "x", true, null, 2.5, -3]',), ("[]",)], "j string").select(T.integers_of(F.col("j")).alias("x")).collect()
    assert got[0].x == [1, 1, -3] and got[1].x == []


def test_java_tokens(spark):
    code = ['int x = 0x1F; // c', '"a\\"b" \'c\' @Override', "a # b"]
    got = [[tuple(t) for t in r.x] for r in spark.createDataFrame([(c,) for c in code], "c string").select(T.java_tokens(F.col("c")).alias("x")).collect()]
    assert got[0] == [("BasicType", "int"), ("Identifier", "x"), ("Operator", "="), ("HexInteger", "0x1F"), ("Separator", ";")]
    assert got[1] == [("String", '"a\\"b"'), ("Character", "'c'"), ("Annotation", "@"), ("Identifier", "Override")] and got[2] == []


def test_numbered_without_gaps(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37) % 101) for i in range(101)], "g int, v long")
    got = R.numbered(rows, ["g"], "v", "at", most=7).collect()
    for g in (0, 1):
        own = sorted((r.v, r["at"]) for r in got if r.g == g)
        assert [a for _, a in own] == list(range(len(own)))


def test_counters_fill_while_rows_are_read(spark):
    rows, seen = R.count_while(spark.range(10), "seen", odd=F.col("id") % 2 == 1)
    rows.collect()
    assert seen.get == {"all": 10, "odd": 5}


def test_random_chains_are_the_same_however_dealt(spark):
    one, two = B.random_chains(spark, 20, 5, 9, seed=3), B.random_chains(spark, 20, 5, 9, seed=3).repartition(7)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    for r in one.collect():
        assert 5 <= r.n_nodes <= 9 and 0 <= r.output[1].pointer < r.n_nodes and r.n_edges == 2 * (r.n_nodes - 1)
        assert all(n.type.isupper() and n.label.islower() and n.is_repair_candidate == (n.id % 2 == 0) for n in r.nodes)


def test_bootstrap_by_brute_force(spark):
    from graphprep.operators import evaluate as V

    rows = spark.createDataFrame([(i, [str(i % 3)], "1") for i in range(50)], "idx long, beam array<string>, target string")
    got = {r.ci: (r.lower, r.upper) for r in V.bootstrap(rows, V.class_accuracy, 20, (80, 90)).collect()}
    drawn = spark.range(50).selectExpr("id", "explode(sequence(0, 19)) s").selectExpr("s", "pmod(xxhash64(42, s, id), 50L) i").collect()
    values = sorted(sum(r.i % 3 == 1 for r in drawn if r.s == s) / 50 for s in range(20))
    assert got == {80: (values[4], values[15]), 90: (values[2], values[17])}


def test_metrics_refuse_what_they_cannot_judge(spark):
    from graphprep.operators import evaluate as V

    rows = spark.createDataFrame([(0, ["a", "b"], "c")], "idx long, beam array<string>, target string")
    for name in ("code2seq_dataset", "great_var_misuse_dataset", "cubert_variable_misuse_repair_dataset", "cubert_wrong_operator_classification_dataset"):
        with pytest.raises(Exception):
            V.evaluate(rows, name).collect()
    with pytest.raises(ValueError):
        V.evaluate(rows, "none such")
    assert len(V.EVALUATORS) == 18


def test_samples_follow_the_softmax(spark):
    from graphprep.operators import kernels as K

    n = 4000
    scores = [1.0, 0.0, -1.0]
    p = [math.exp(x) / sum(map(math.exp, scores)) for x in scores]
    a = F.array(*map(F.lit, scores))
    none = F.array().cast("array<double>")
    drawn = spark.range(n).select(K.choose(a, none, none, K.gumbel(F.size(a), 1.0, 5, F.col("id")))["choice"].alias("k")).groupBy("k").count().collect()
    assert all(abs(r["count"] / n - p[r.k]) < 0.03 for r in drawn)


def test_numbers_of_skewed_groups(spark):
    """One group with most rows, most of them of one value, others far apart; null comes first."""
    from collections import defaultdict

    values = [5.0] * 300 + [float(i) for i in range(100)] + [1e15 + i for i in range(50)] + [None] * 30 + [-(2.0**60)]
    rows = spark.createDataFrame([("big", v, i) for i, v in enumerate(values)] + [(None, 1.0, i) for i in range(9)], "g string, v double, i int").repartition(5)
    got = R.numbered(rows, ["g"], "v", "at", most=20)
    assert got.columns == ["g", "v", "i", "at"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.g].append((r.at, r.v, r.i))
    assert len(by[None]) == 9 and sorted(x[0] for x in by["big"]) == list(range(len(values)))
    in_order = [x[1] for x in sorted(by["big"])]
    assert in_order == sorted(values, key=lambda v: (v is not None, v or 0)) and len({x[2] for x in by["big"]}) == len(values)
    assert sorted(x[0] for x in by[None]) == list(range(9))
    same = spark.createDataFrame([("a", 1)] * 50, "g string, v int")
    assert sorted(r.at for r in R.numbered(same, ["g"], "v", "at", most=20).collect()) == list(range(50))
    assert R.numbered(same.where("v > 1"), ["g"], "v", "at").count() == 0


def test_sparse_batches(spark):
    from graphprep.operators import tensors as X

    r = __import__("random").Random(2)
    data = []
    for i in range(25):
        n, o = r.randint(1, 6), r.randint(1, 4)
        pairs = lambda k, a, b: list(zip(*[(r.randrange(a), r.randrange(b)) for _ in range(k)])) or [(), ()]  # noqa: B023, E731
        src, dst = pairs(r.randint(0, 5), n, n)
        co, ci = pairs(r.randint(0, 3), o, n)
        po, pi = pairs(r.randint(0, 2), o, n)
        lengths = [r.randint(1, 3) for _ in range(n)]
        data.append((f"e{i:02d}", "train", [r.randint(0, 9) for _ in range(o)], list(co), list(ci), list(po), list(pi), [r.randint(0, 9) for _ in range(sum(lengths))], lengths, [1] * n, [0] * len(src), list(src), list(dst), [k for k in range(n) if k % 2]))
    names = "example_id split target_token_ids copy_out copy_in pointer_out pointer_in node_label_ids node_lengths node_type_ids edge_type_ids edge_src edge_dst candidate_indices".split()
    schema = ", ".join(f"{c} {'string' if c in ('example_id', 'split') else 'array<int>'}" for c in names)
    rows = spark.createDataFrame(data, schema).withColumn("turn", F.substring("example_id", 2, 2).cast("int"))
    got = X.sparse_batches(rows, ["split"], "turn", 8, drop_remainder=False).orderBy("batch").collect()
    assert [len(b.example_ids) for b in got] == [8, 8, 8, 1]
    assert X.sparse_batches(rows, ["split"], "turn", 8).count() == 3
    k = 0
    for b in got:
        for g in range(len(b.example_ids)):
            want = dict(zip(names, data[k]))
            k += 1
            assert b.example_ids[g] == want["example_id"]
            cut = lambda c, s: b[c][b[f"{s}_splits"][g] : b[f"{s}_splits"][g + 1]]  # noqa: B023, E731
            node, out = b.node_splits[g], b.output_splits[g]
            assert cut("node_type_ids", "node") == want["node_type_ids"] and cut("node_lengths", "node") == want["node_lengths"] and cut("node_label_ids", "label") == want["node_label_ids"]
            assert cut("target_token_ids", "output") == want["target_token_ids"] and [x - node for x in cut("edge_src", "edge")] == want["edge_src"] and [x - node for x in cut("edge_dst", "edge")] == want["edge_dst"]
        every = [dict(zip(names, d)) for d in data[k - len(b.example_ids) : k]]
        assert b.copy_in == [x + s for w, s in zip(every, b.node_splits) for x in w["copy_in"]] and b.pointer_out == [x + s for w, s in zip(every, b.output_splits) for x in w["pointer_out"]]
        assert b.candidate_indices == [x + s for w, s in zip(every, b.node_splits) for x in w["candidate_indices"]] and out is not None


def test_bootstrap_in_blocks(spark):
    """Draws over blocks are draws over all rows: as many, and spread as the binomial distribution says."""
    from functools import partial

    from graphprep.operators import evaluate as V

    n, samples = 900, 600
    rows = spark.createDataFrame([(i, [str(i % 3)], "1") for i in range(n)], "idx long, beam array<string>, target string")
    got = {r.ci: (r.lower, r.upper) for r in V.bootstrap_in_blocks(rows, V.class_accuracy, samples, (68, 95), block_rows=100).collect()}
    p = 1 / 3
    sd = math.sqrt(p * (1 - p) / n)
    assert all(abs(got[ci][0] - (p - z * sd)) < 0.3 * sd and abs(got[ci][1] - (p + z * sd)) < 0.3 * sd for ci, z in ((68, 0.468), (95, 1.645)))  # from 100 - ci to ci per cent
    again = {r.ci: (r.lower, r.upper) for r in V.bootstrap_in_blocks(rows.repartition(7), V.class_accuracy, samples, (68, 95), block_rows=100).collect()}
    assert again == got
    # Every sample has n draws, and options reach the set.
    known = spark.createDataFrame([(i, ["CLASS_a" if i % 2 else "CLASS_b"], "CLASS_a") for i in range(50)], "idx long, beam array<string>, target string")
    found = V.bootstrap_in_blocks(known, partial(V.known_class_accuracy, classes=("a", "b")), 40, (90,), block_rows=20).collect()
    assert {r.metric for r in found} == {"accuracy", "mean_per_class_accuracy", "accuracy_CLASS_a"} and all(0.2 < r.lower < 0.5 < r.upper < 0.8 for r in found)
    ones = V.MetricSet(lambda pred, keys: pred.select(*keys, F.lit(1).alias("n")), lambda: {"n": F.col("n")})
    assert {(r.lower, r.upper) for r in V.bootstrap_in_blocks(rows, ones, 30, (90,), block_rows=70).collect()} == {(float(n), float(n))}


def test_draws_are_never_broadcast(spark):
    """However small the optimizer takes them for."""
    from graphprep.operators import evaluate as V
    from graphprep.plans import QUERIES

    rows = spark.range(50).select(F.col("id").alias("idx"), F.array(F.lit("a")).alias("beam"), F.lit("a").alias("target"))
    for found in (V.bootstrap(rows, V.class_accuracy, 20, (80,)), QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001")):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BuildLeft" not in plan and "ShuffledHashJoin" in plan


def test_compared_by_brute_force(spark):
    """Beams of all sizes, empty ones, borders and nulls, against counting in Python."""
    import random
    from collections import Counter

    rng = random.Random(3)
    some = lambda: [rng.choice("abc") for _ in range(rng.randrange(9))]
    rows = []
    for i in range(300):
        beams = [some() for _ in range(rng.randrange(4))]
        rows.append((i, None if i % 50 == 7 else beams, [some() for _ in beams]))
    rows.append((300, [["a", "b", None, "b", "c"]], [["a", "b", "c"]]))
    got = spark.createDataFrame(rows, "i int, p array<array<string>>, t array<array<string>>").repartition(3).select("i", M.compared(F.col("p"), F.col("t"), 4).alias("x")).collect()
    assert len(got) == 301
    for i, x in got:
        p, t = rows[i][1:]
        if p is None:
            assert x is None
            continue
        assert len(x) == len(p)
        for c, a, b in zip(x, p, t, strict=True):
            a1, b1 = [w for w in a if w], [w for w in b if w]
            assert (c.tp, c.fp, c.fn) == (sum(w in b1 for w in a1), sum(w not in b1 for w in a1), sum(w not in a1 for w in b1))
            for n in range(1, 5):
                grams = [Counter(g for g in (tuple(s[k : k + n]) for k in range(len(s) - n + 1)) if None not in g) for s in (a, b)]
                assert c.hits[n - 1] == sum((grams[0] & grams[1]).values())


def test_clipped_counts_shuffle_no_ngrams(spark):
    pairs = spark.createDataFrame([(1, "a b a", "a b"), (2, "", "x y"), (3, "a a a", "a"), (3, "b", "a a")], "k int, p string, t string").select("k", F.split("p", " ").alias("p"), F.split("t", " ").alias("t"))
    found = M.clipped_counts(pairs, ["k"], "p", "t")
    assert {tuple(r) for r in found.collect()} == {(1, 2 + 0 + 3, 3 + 1 + 4), (2, 1 + 1, 2 + 2), (3, 0, 2)}
    assert "Generate explode" not in found._jdf.queryExecution().sparkPlan().toString()
