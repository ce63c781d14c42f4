"""Both stages from end to end on a few rows."""

import pytest
from pyspark.sql import functions as F

from graphprep.functions import text as T
from graphprep.operators import builders as B
from graphprep.plans import dataset as D


@pytest.fixture(scope="module")
def examples(spark):
    rows = spark.createDataFrame([("e1", "train", "a b a", "b"), ("e2", "train", "a b a", "b"), ("e3", "test", "c d", "zz"), ("e4", "train", "a c", "rare")], "example_id string, split string, text string, out string")
    return B.chain_examples(rows, T.words(F.col("text")), F.array(T.token(F.col("out")))).drop("text", "out")


def test_prepare_and_metadata(examples):
    kept = D.prepare(examples, filters=[F.col("n_nodes") <= 3], dedup=True)
    assert {r.example_id for r in kept.collect()} == {"e1", "e3", "e4"}
    m = D.metadata(kept).first()
    assert (m.num_train_examples, m.train_max_num_nodes, m.num_valid_examples, m.valid_max_num_nodes, m.test_num_nodes_upto_128) == (2, 3, 0, 0, 1)


def test_invalid(examples):
    bad = examples.withColumn("edges", F.concat("edges", F.slice("edges", 1, 1)))
    assert D.prepare(bad, on_invalid="drop").count() == 0
    with pytest.raises(Exception, match="invalid example"):
        D.prepare(bad).collect()


def test_features(examples):
    vocab = D.vocabularies(examples, 4)
    got = {r.example_id: r for r in D.features(examples, vocab).collect()}
    assert "e4" not in got  # neither in the vocabulary nor copyable
    r = got["e1"]
    assert r.node_texts == ["a", "b", "a"] and r.copy_out == [0] and r.copy_in == [1] and r.target_texts == ["b", "DONE"]
    assert r.node_label_ids == [2, 3, 2] and r.edge_src == [0, 1, 1, 2] and got["e3"].target_token_ids[0] == 0


def test_long_outputs_give_the_same_pairs(examples):
    vocab = D.vocabularies(examples, 50)
    short, long = (sorted((r.example_id, tuple(r.copy_out), tuple(r.copy_in)) for r in D.features(examples, vocab, long_outputs=x).collect()) for x in (False, True))
    assert short == long


def test_feature_metadata_counts_done(examples):
    rows = D.features(examples, D.vocabularies(examples, 50), drop_impossible=False)
    m, f = D.metadata(D.prepare(examples)).first(), D.feature_metadata(rows).first()
    assert f.train_max_num_output == m.train_max_num_output + 1 and f.train_max_num_nodes == m.train_max_num_nodes
    names = D.published_names(D.feature_metadata(rows), "tfexample").columns
    assert "train_tfexample_max_num_nodes" in names and "test_tfexamplemax_num_nodes_128" in names


def test_tasks_share_the_train_rows(examples):
    tasked = examples.withColumn("task", F.when(F.col("example_id") == "e1", "A").otherwise("B"))
    got = {r.example_id: r.task for r in D.task_features(tasked, D.vocabularies(examples, 50), drop_impossible=False).collect()}
    assert got == {"e1": "all", "e2": "all", "e4": "all", "e3": "B"}


def test_transforms_come_first_and_filters_where_wanted(examples):
    bad = examples.withColumn("edges", F.when(F.col("example_id") == "e1", F.concat("edges", F.slice("edges", 1, 1))).otherwise(F.col("edges")))
    not_one = [F.col("example_id") != "e1"]
    assert D.prepare(bad, filters=not_one, filters_first=True).count() == 3
    with pytest.raises(Exception, match="invalid example"):
        D.prepare(bad, filters=not_one).collect()
    renamed = D.prepare(examples, transforms=[lambda e: e.withColumn("split", F.lit("test"))])
    assert {r.split for r in renamed.collect()} == {"test"}
