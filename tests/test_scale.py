"""What keeps queries from growing faster than their input: by plans and task counts on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import builders as B
from graphprep.operators import rules as R
from graphprep.plans import QUERIES
from graphprep.plans import dataset as D
from graphprep.plans import examples as X
from graphprep.plans import source_queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def chains(spark, n=8):
    rows = spark.range(n).select(F.col("id").cast("string").alias("example_id"), F.lit("train").alias("split"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"))
    return B.chain_examples(rows.repartition(4, "example_id"), T.words(F.col("text")), F.array(T.token(F.lit("a"))))


def test_examples_are_checked_above_the_shuffle_that_deals_them(spark):
    above, below = optimized(D.prepare(chains(spark))).rsplit("RepartitionByExpression", 1)
    assert "raise_error" in above and "transform(" not in below and "exists(" not in below
    assert D.prepare(chains(spark)).count() == 8


def test_vocabularies_are_made_of_one_count(spark, tmp_path, monkeypatch):
    from graphprep.operators import encode as E
    from graphprep.plans import registry as G

    seen, real = [], E.vocabulary
    monkeypatch.setattr(E, "vocabulary", lambda counts, most: seen.append(optimized(counts)) or real(counts, most))
    G.create(spark, "dummy_dataset", "6", str(tmp_path / "d"), shares=(50, 25, 25), shards=1)
    assert len(seen) == 4 and not any("Aggregate" in p for p in seen)


@needs_data
def test_shards_follow_the_size_of_the_table(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(X, "_FOUR_SHARDS_BYTES", 30_000)
    monkeypatch.setattr(source_queries, "scratch", lambda s, name: f"file://{tmp_path}/{name}")
    want = {tuple(r) for r in QUERIES["tfrecord_digest"](spark, SF).collect()}
    names = [n for n in os.listdir(tmp_path / "tfrecord") if n.startswith("train-")]
    assert len(names) > 4 and sum(r[1] for r in want) == X.table(spark, SF, "documents").count()


def test_rules_of_repeats_and_ends(spark):
    """Nulls, ends out of range and repeats, alone and where nothing else is wrong."""
    def rules(*edges, output=None):
        ex = spark.range(1).select(F.array(*[T.node(F.lit(i), F.lit("t"), F.lit("x")) for i in range(2)]).alias("nodes"), F.array(*[B.edge(F.lit(a), F.lit(b), F.lit(t)) for a, b, t in edges]).cast("array<struct<src:int,dst:int,type:string>>").alias("edges"), F.array(T.pointer(F.lit(output))).alias("output"))
        return R.violations(ex).first().violations

    assert rules() == [] and rules((0, 1, "a"), (0, 1, "b"), (1, 0, "a")) == []
    assert rules((0, 1, "a"), (0, 1, "b"), (0, 1, "a")) == ["V7_repeated_edge"]
    assert rules((0, 2, "a")) == rules((-1, 0, "a")) == rules((None, 1, "a")) == rules((0, None, "a")) == ["V5_edge_end"]
    assert rules((0, 1, None)) == ["V6_edge_type"] and rules(output=-1) == rules(output=2) == ["V8_pointer_range"] and rules(output=1) == []


def test_rules_make_names_of_edges_only_for_equal_hashes(spark):
    plan = optimized(R.violations(chains(spark)))
    assert "Generate inline" in plan and "xxhash64(lambda" in plan


def test_content_hash_joins_lists_without_a_lambda(spark):
    """Fields that move from one entry to the next, or are null and not empty, make another hash."""
    def of(*labels, output="x"):
        ex = spark.range(1).select(F.array(*[T.node(F.lit(i), F.lit("t"), F.lit(x)) for i, x in enumerate(labels)]).alias("nodes"), F.array().cast("array<struct<src:int,dst:int,type:string>>").alias("edges"), F.array(T.token(F.lit(output))).alias("output"))
        return R.content_hash(ex).first().content_hash

    assert len({of("a", "b"), of("ab", ""), of("", "ab"), of("b", "a"), of("a", "b", output="y"), of(None, "b"), of("", "b"), of("a"), of("a", "")}) == 9
    last = optimized(R.content_hash(chains(spark))).split("Generate inline")[0]
    assert "array_join" in last and "transform(" not in last


@needs_data
@pytest.mark.parametrize(("name", "key"), [("patch_graph", "p_partkey"), ("path_forest_edges", "c_custkey")])
def test_small_tables_are_dealt_to_all_cores(spark, name, key):
    assert f"RepartitionByExpression [{key}" in optimized(QUERIES[name](spark, SF))


def test_tables_of_some_pieces_a_core_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(X, "table_bytes", lambda rows: 100 << 20 << 2)
    assert X.spread(spark.range(9)).rdd.getNumPartitions() == 25


@needs_data
def test_sides_of_a_patch_are_taken_apart_once(spark):
    plan = optimized(QUERIES["patch_graph"](spark, SF))
    assert plan.count("regexp_extract_all") == 2  # one for each side, none for the filter


def test_random_letters_make_no_list_that_is_not_read(spark):
    plan = optimized(B.random_letters(spark, 5, seed=7).select("graph", "types"))
    assert "label" not in plan
    ex, rows = B.random_chains(spark, 5, 3, 9, seed=7), B.random_letters(spark, 5, 3, 9, seed=7)
    seen = {r.graph: ([n.type for n in r.nodes], [n.label for n in r.nodes], r.output[1].pointer, r.n_nodes) for r in ex.collect()}
    assert seen == {r.graph: (r.types, r.labels, r.pointer, r.n_nodes) for r in rows.collect()}


@pytest.mark.parametrize("sent", [100, 1])
def test_nodes_of_a_bundle_are_not_shuffled_by_type(spark, monkeypatch, sent):
    monkeypatch.setattr(B, "SENT_ATTRS", sent)
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    counts = of([(0, 2, 1, "f g"), (1, 3, 0, "h")], "graph bigint, n_nodes bigint, n_edges bigint, name string")
    nodes = of([(i, 1, i % 3) for i in range(5)], "place bigint, type_id bigint, attr_id bigint")
    edges, types, attrs = of([(0, 0, 1)], "place bigint, src int, dst int"), of([(1, "T")], "type_id bigint, type string"), of([(i, f"a{i}") for i in range(3)], "attr_id bigint, label string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ex = B.bundle_examples(counts, nodes, edges, types, attrs)
        plan = ex._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(type_id" not in plan and ("hashpartitioning(attr_id" in plan) == (sent == 1) and ("_attr_part" in plan) == (sent == 1)
        assert {r.graph: [(n.id, n.type, n.label) for n in r.nodes] for r in ex.collect()} == {0: [(0, "T", "a0"), (1, "T", "a1")], 1: [(0, "T", "a2"), (1, "T", "a0"), (2, "T", "a1")]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
