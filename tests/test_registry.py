"""Datasets by name, created in both stages from small raw files."""

import json

import pytest
from pyspark.sql import functions as F

from graphprep.functions.text import token, words
from graphprep.operators import builders as B
from graphprep.plans import registry as G
from graphprep.sources import readers as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_names(spark):
    assert {"code2seq_dataset", "convattn_dataset", "funcom_dataset", "great_var_misuse_dataset", "retrieve_and_edit_dataset", "ogb_code_dataset", "dummy_dataset"} <= set(G.names())
    with pytest.raises(ValueError, match="no source is named"):
        G.source("none")
    with pytest.raises(ValueError, match="there is a source"):
        G.register(G.source("dummy_dataset"))


def test_own_source_in_two_stages(spark, tmp_path):
    """Splits by shares, large graphs left out before words are counted, all parts where the layout says."""
    rows = spark.createDataFrame([(f"e{i}", " ".join(f"w{i % 7}" for _ in range(3 + i % 5)) + f" only{i}") for i in range(120)], "example_id string, text string")
    own = G.Source("own", lambda s, p: rows.withColumns({"split": F.lit(None).cast("string"), "provenance": F.lit("here")}), lambda r: B.chain_examples(r, words(F.col("text")), F.array(token(F.element_at(words(F.col("text")), 1)))))
    G.register(own, replace=True)
    with pytest.raises(Exception, match="knows no splits"):
        G.create(spark, "own", "", str(tmp_path / "a"))
    layout = G.create(spark, "own", "", str(tmp_path / "b"), shares=(70, 20, 10), shards=2, most_nodes={"train": 7, "valid": 100, "test": 100}, vocabulary_sizes=9)
    ex = S.read_examples(spark, layout.examples)
    assert ex.count() == 120 and ex.select("split").distinct().count() == 3
    small = {r.example_id for r in ex.where("split <> 'train' or size(nodes) <= 7").collect()}
    got = spark.read.parquet(f"{layout.features}/parquet")
    assert {r.example_id for r in got.collect()} == small and len(small) < 120
    assert S.read_tfrecords(spark, f"{layout.features}/tfrecord", "node_label_ids array<bigint>", split="train").count() == got.where("split = 'train'").count()
    labels = S.read_vocabulary(spark, layout.vocabulary("node_label"), "node_label")
    assert labels.count() == 9 and {r.token for r in labels.collect()} == {"<OOV>", "<pad>", *(f"w{i}" for i in range(7))}
    one = spark.read.json(f"{layout.metadata}/stage_1").first()
    assert one.num_train_examples + one.num_valid_examples + one.num_test_examples == 120
    with pytest.raises(Exception):
        G.create(spark, "own", "", str(tmp_path / "b"), stages="1", shares=(70, 20, 10))
    with pytest.raises(ValueError):
        G.create(spark, "own", "", str(tmp_path / "c"), stages="3")


def test_path_source(spark, tmp_path):
    for split in ("train", "val", "test"):
        put(tmp_path / "raw" / f"java.{split}.c2s", "get|name a|b,N1|N2,c  bad\nset x,M,y a,N,b\n")
    layout = G.create(spark, "code2seq_dataset", str(tmp_path / "raw"), str(tmp_path / "out"), shards=1)
    rows = S.read_examples(spark, layout.examples).collect()
    assert sorted(r.split for r in rows) == ["test"] * 2 + ["train"] * 2 + ["valid"] * 2
    assert {tuple(o.token for o in r.output) for r in rows} == {("get", "name"), ("set",)}
    put(tmp_path / "raw" / "java.other.c2s", "a b,c,d\n")
    with pytest.raises(Exception, match="no split in the name"):
        G.create(spark, "code2seq_dataset", str(tmp_path / "raw"), str(tmp_path / "out2"), stages="1")


def test_pair_and_tree_sources(spark, tmp_path):
    for split in ("train", "valid", "test"):
        put(tmp_path / "f" / f"functions.{split}", "7\tpublic int f\n8\tvoid g\n9\tno comment\n")
        put(tmp_path / "f" / f"comments.{split}", "8\tdoes g\n7\treturns f\n")
        put(tmp_path / "r" / f"{split}.tsv", "f\tadds one\ta b\treturn a\nshort\tline\n")
    rows = S.read_examples(spark, G.create(spark, "funcom_dataset", str(tmp_path / "f"), str(tmp_path / "fo"), stages="1").examples).where("split = 'valid'").collect()
    assert {(" ".join(n.label for n in r.nodes), " ".join(o.token for o in r.output), r.provenance) for r in rows} == {("public int f", "returns f", "7"), ("void g", "does g", "8")}
    rows = S.read_examples(spark, G.create(spark, "retrieve_and_edit_dataset", str(tmp_path / "r"), str(tmp_path / "ro"), stages="1").examples).collect()
    assert len(rows) == 3 and all([o.token for o in r.output] == ["return", "a"] and {n.type for n in r.nodes} >= {"ROOT", "DOCSTRING", "ARGUMENTS_TOKEN"} for r in rows)


def test_name_chains_and_misuse_sources(spark, tmp_path):
    put(tmp_path / "c" / "train.json", json.dumps([{"filename": "A.java", "name": ["get", "x"], "tokens": ["<SENTENCE_START>", "return", "x"]}] * 20))
    put(tmp_path / "c" / "test.json", json.dumps([{"filename": "B.java", "name": ["set"], "tokens": ["a"]}]))
    rows = S.read_examples(spark, G.create(spark, "convattn_dataset", str(tmp_path / "c"), str(tmp_path / "co"), stages="1").examples).collect()
    assert len(rows) == 21 and sum(r.split == "test" for r in rows) == 1 and {r.split for r in rows} == {"train", "valid", "test"}
    assert all([o.token for o in r.output] == ["get", "x"] and [e.type for e in r.edges] == ["NEXT_TOKEN", "REVERSED_NEXT_TOKEN"] * 2 for r in rows if r.split != "test")
    line = {"source_tokens": ["a", "b", "a"], "edges": [[0, 1, 0, "NEXT"], [0, 1, 0, "NEXT"]], "has_bug": True, "error_location": 1, "repair_targets": [0], "repair_candidates": [0, 2, "x"], "provenances": [{"p": 1}]}
    for folder in ("train", "dev", "eval"):
        put(tmp_path / "g" / folder / "part-0.jsonl", json.dumps(line) + "\n" + json.dumps({**line, "has_bug": False}) + "\n" + json.dumps({**line, "repair_targets": []}) + "\n")
    rows = S.read_examples(spark, G.create(spark, "great_var_misuse_dataset", str(tmp_path / "g"), str(tmp_path / "go"), stages="1").examples).where("split = 'valid'").collect()
    assert len(rows) == 2 and {tuple(o.token for o in r.output) for r in rows} == {(None, "a"), ("NO_BUG",)}
    assert all([n.is_repair_candidate for n in r.nodes] == [True, False, True] and len(r.edges) == 2 for r in rows)


def test_synthetic_source(spark, tmp_path):
    layout = G.create(spark, "dummy_dataset", "12", str(tmp_path / "d"), shares=(50, 25, 25), shards=1, most_nodes=2000)
    assert spark.read.parquet(f"{layout.features}/parquet").count() == 12


def test_decoded_text(spark):
    """Tokens by the vocabulary, copies by the nodes, pointers without text; what could be copied; the end."""
    from graphprep.operators import decoding as K

    features = spark.createDataFrame([("e", ["x", "y", "x", "z"])], "example_id string, node_texts array<string>")
    vocab = spark.createDataFrame([("output_token", w, i) for i, w in enumerate(["<OOV>", "<pad>", "x", "DONE"])], "kind string, token string, id int")
    script = {1: ("token", 2), 2: ("copy", 1), 3: ("pointer", 3), 4: ("token", 3)}
    table = spark.createDataFrame([(k, *v) for k, v in script.items()], "next int, h string, c int")
    states = K.decode(features, vocab, lambda s: s.join(table, F.col("step") + 1 == F.col("next")).select("example_id", F.col("h").alias("head"), F.col("c").alias("choice")), 6)
    got = {r.step: (r.text, r.token_id, r.copies, r.done) for r in states.collect()}
    assert got == {0: (None, 0, [], False), 1: ("x", 2, [0, 2], False), 2: ("y", 0, [1], False), 3: (None, 0, [], False), 4: ("DONE", 3, [], True)}
    assert K.outputs(states).first().said == "x y POINTER(3)" and K.outputs(states, True, features).first().said == "x y POINTER(3,z)"
    with pytest.raises(Exception, match="no token has the id"):
        K.chosen_text(spark.createDataFrame([("e", "token", 9)], "example_id string, head string, choice int"), features, vocab).collect()
