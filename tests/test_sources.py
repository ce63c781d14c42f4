"""Readers, writers and streams on small files."""

import pytest

from graphprep.sources import readers as S
from graphprep.sources import writers as W
from graphprep.streaming.counts import stream_token_counts


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("get|name a|b,N1|N2,c  bad\n")
    r = S.read_paths(spark, str(tmp_path / "p.txt")).first()
    assert r.name == ["get", "name"] and [(p.start, p.ast, p.end) for p in r.paths] == [(["a", "b"], ["N1", "N2"], ["c"])]
    (tmp_path / "t.tsv").write_text("a\tb\tc\nx\ty\n")
    assert [tuple(x) for x in S.read_tsv(spark, str(tmp_path / "t.tsv"), ["p", "q", "r"]).collect()] == [("a", "b", "c")]
    (tmp_path / "f.tsv").write_text("7\tint f\n8\tg\n")
    (tmp_path / "c.tsv").write_text("8\tdoes g\n7\treturns f\n")
    assert {tuple(x) for x in S.read_pairs(spark, str(tmp_path / "f.tsv"), str(tmp_path / "c.tsv")).collect()} == {("7", "int f", "returns f"), ("8", "g", "does g")}


def test_file_pairs(spark, tmp_path):
    for n, t in (("x_buggy.json", "1"), ("x_gedit.txt", "2"), ("y_buggy.json", "3")):
        (tmp_path / n).write_text(t)
    assert [tuple(r) for r in S.read_file_pairs(spark, str(tmp_path), "_buggy.json", "_gedit.txt").collect()] == [("x", "1", "2")]


def test_predictions(spark, tmp_path):
    (tmp_path / "p").write_text("a b\tc\nd\n")
    (tmp_path / "t").write_text("a\nd\n")
    rows = S.read_predictions(spark, str(tmp_path / "p"), str(tmp_path / "t")).orderBy("idx").collect()
    assert [(r.idx, r.beam, r.target) for r in rows] == [(0, ["a b", "c"], "a"), (1, ["d"], "d")]
    (tmp_path / "t").write_text("a\n")
    with pytest.raises(Exception, match="differ in length"):
        S.read_predictions(spark, str(tmp_path / "p"), str(tmp_path / "t")).collect()


def test_writers(spark, tmp_path):
    ex = spark.createDataFrame([("train", 1), ("test", 2)], "split string, x int")
    W.write_examples(ex, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").where("split = 'train'").count() == 1
    with pytest.raises(Exception):
        W.write_examples(ex, f"{tmp_path}/e")
    W.write_vocabulary(spark.createDataFrame([("b", 1), ("a", 0)], "token string, id int"), f"{tmp_path}/v")
    assert [r.value for r in spark.read.text(f"{tmp_path}/v").collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    q = stream_token_counts(spark, f"{tmp_path}/d", "doc_id long, text string").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {(r.token, r.cnt) for r in spark.table("counted").collect()} == {("a", 2), ("b", 2)}


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_checksums_against_what_is_wanted(spark, tmp_path):
    import hashlib

    for name in ("a.bin", "b.bin", "c.bin"):
        put(tmp_path / "raw" / name, name)
    want = {"a.bin": hashlib.sha1(b"a.bin").hexdigest(), "b.bin": "0" * 40}
    got = {r.path.rsplit("/", 1)[1]: r.ok for r in S.verified(S.checksums(spark, str(tmp_path / "raw")), want).collect()}
    assert got == {"a.bin": True, "b.bin": False, "c.bin": False}


def test_archives(spark, tmp_path):
    import gzip
    import io
    import tarfile
    import zipfile

    folder = tmp_path / "packed"
    folder.mkdir()
    with zipfile.ZipFile(folder / "x.zip", "w") as z:
        z.writestr("in/one.txt", "1")
    with tarfile.open(folder / "y.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"2"))
    put(folder / "three.txt.gz", gzip.compress(b"3"))
    assert {(r.name, bytes(r.content)) for r in S.read_archives(spark, str(folder)).collect()} == {("in/one.txt", b"1"), ("two.txt", b"2"), ("three.txt", b"3")}


def test_members_are_read_by_their_ranges(spark, tmp_path):
    import io
    import random
    import tarfile
    import zipfile

    r, want = random.Random(3), {}
    folder = tmp_path / "packed"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.zip", "w") as z, tarfile.open(folder / "b.tar", "w") as plain, tarfile.open(folder / "c.tgz", "w:gz") as t:
        for i in range(30):
            raw = r.randbytes(r.choice([0, 10, 5000])) + b"x" * r.choice([0, 20_000])
            z.writestr(f"z/é{i}", raw, compress_type=zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
            want["a.zip", f"z/é{i}"] = raw
            for out, name in ((plain, "b.tar"), (t, "c.tgz")):
                info = tarfile.TarInfo(f"{'long/' * 40}{i}")
                info.size = len(raw)
                out.addfile(info, io.BytesIO(raw))
                want[name, info.name] = raw
        z.writestr("folder/", b"")
    got = S.read_archives(spark, str(folder), parts=7)
    assert {(x.archive.rsplit("/", 1)[1], x.name): bytes(x.content) for x in got.collect()} == want
    members = S.list_members(spark, str(folder))
    assert members.count() == 61 and members.where("kind = 'tgz'").count() == 1
    raw = bytearray((folder / "a.zip").read_bytes())
    spot = members.where("kind = 'stored' and size > 5000").first()
    raw[spot.offset + 60] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        S.read_archives(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "other.rar").write_bytes(b"x")
    with pytest.raises(Exception, match="no archive"):
        S.read_archives(spark, str(tmp_path / "other.rar")).collect()


def plain_continued(lines):
    labels = []
    for line in lines[1:]:
        if line.startswith(f"{len(labels)},"):
            labels.append(line.split(",")[1])
        elif labels:
            labels[-1] += line
    return list(enumerate(labels))


@pytest.mark.parametrize("block", [64, 300, 1 << 20])
def test_continued_lines_over_blocks(spark, tmp_path, block):
    """Rows that look like others, ids that come too early, again or never, and rows over several blocks."""
    import random

    r = random.Random(block)
    lines, n = ["id,label"], 0
    for _ in range(400):
        kind = r.random()
        if kind < 0.6:
            lines.append(f"{n},label {n}{r.choice(['', ',more', ','])}")
            n += 1
        elif kind < 0.8:
            lines.append(r.choice(["", "no row", f"{n + 1},early", f"{max(0, n - 3)},again", f"0{n},zero", f"{n}", "12345678901234567890,long"]))
        else:
            lines.append("y" * r.randint(0, 150))
    path = put(tmp_path / "x" / "attr.csv", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [(x.id, x.label) for x in S.read_continued(spark, path).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == plain_continued(lines) and len(got) > 200


def test_a_block_as_a_function():
    from graphprep.sources.continued import block_function

    assert block_function([]) == []
    assert block_function([5, 6, 7]) == [(5, 7, 8)]
    assert block_function([7, 5, 6, 9, 7]) == [(5, 7, 8), (9, 9, 10)]
    assert block_function([6, 5, 8]) == [(5, 5, 6), (6, 6, 7), (8, 8, 9)]


def test_continued_lines(spark, tmp_path):
    path = put(tmp_path / "attr.csv", "id,label\n0,a\n1,b,lost\nmore\n7,of it\n2,c\n")
    assert [(r.id, r.label) for r in S.read_continued(spark, path).orderBy("id").collect()] == [(0, "a"), (1, "bmore7,of it"), (2, "c")]


def test_bundle(spark, tmp_path):
    from graphprep.operators import builders as B

    files = {
        "edge.csv": "0,1\n0,1\n1,2\n",
        "node-feat.csv": "0,0\n1,1\n0,1\n1,0\n0,0\n",
        "num-node-list.csv": "2\n3\n",
        "num-edge-list.csv": "1\n2\n",
        "graph-label.csv": "get x\nset\n",
        "typeidx2type.csv": "id,type\n0,Name\n1,Call\n",
        "attridx2attr.csv": "id,attr\n0,f\n1,g\n",
        "split/train.csv": "0\n",
        "split/valid.csv": "1\n",
    }
    for name, text in files.items():
        put(tmp_path / name, text)
    b = S.read_bundle(spark, str(tmp_path))
    assert tuple(b.pop("bounds").first()) == (0, 1)
    got = {r.graph: r for r in B.bundle_examples(**b).collect()}
    assert [(n.id, n.type, n.label) for n in got[1].nodes] == [(0, "Name", "g"), (1, "Call", "f"), (2, "Name", "f")]
    assert [(e.src, e.dst, e.type) for e in got[1].edges] == [(0, 1, "EDGE"), (1, 0, "REVERSED_EDGE"), (1, 2, "EDGE"), (2, 1, "REVERSED_EDGE")]
    assert [o.token for o in got[0].output] == ["get", "x"] and got[0].n_nodes == 2
    put(tmp_path / "edge.csv", "0,1\n1,2\n1,2\n")
    twice = S.read_bundle(spark, str(tmp_path))
    twice.pop("bounds")
    with pytest.raises(Exception, match="repeated edge"):
        B.bundle_examples(**twice).collect()


def test_examples_and_vocabularies_come_back(spark, tmp_path):
    ex = spark.createDataFrame([("e", "train", None, [(0, "T", "a", True)], [], [("token", "a", None, None)])], "example_id string, split string, provenance string, nodes array<struct<id:int,type:string,label:string,is_repair_candidate:boolean>>, edges array<struct<src:int,dst:int,type:string>>, output array<struct<kind:string,token:string,pointer:int,class:string>>")
    W.write_examples(ex, str(tmp_path / "ex"))
    got = S.read_examples(spark, str(tmp_path / "ex")).first()
    assert got.provenance == "" and got.nodes[0].is_repair_candidate and got.split == "train" and got.output[0].token == "a"
    vocab = spark.createDataFrame([("node_type", w, i) for i, w in enumerate(["<OOV>", "<pad>", "x", "y z"])], "kind string, token string, id int")
    W.copy_vocabulary(vocab, str(tmp_path / "voc"))
    assert [tuple(r) for r in S.read_vocabulary(spark, str(tmp_path / "voc" / "node_type"), "node_type").orderBy("id").collect()] == [tuple(r) for r in vocab.orderBy("id").collect()]


def test_evaluation_files_and_shards(spark, tmp_path):
    rows = spark.createDataFrame([(1, [["x", "DONE", "y"], ["z"]], ["x"], 0.5, "p"), (0, [["a"], []], ["a", "DONE"], 1.0, None)], "idx long, beam array<array<string>>, target array<string>, score double, provenance string")
    W.write_evaluation(rows, str(tmp_path / "ev"))
    lines = lambda n: [r.value for r in spark.read.text(str(tmp_path / "ev" / n)).collect()]
    assert sorted(lines("predictions")) == ["a\t", "x\tz"] and sorted(lines("targets")) == ["a", "x"] and sorted(lines("scores")) == ["0.500000", "1.000000"]
    W.write_shard(rows.select("idx"), str(tmp_path / "sh"), "out", 1, 3)
    assert W.shards_to_do(spark, str(tmp_path / "sh"), "out", 3) == [0, 2]
    m = spark.createDataFrame([(1, "train", "loss", 0.5)], "step long, split string, metric string, value double")
    W.append_measurements(m, str(tmp_path / "ms"))
    W.append_measurements(m, str(tmp_path / "ms"))
    assert spark.read.parquet(str(tmp_path / "ms")).count() == 2
    assert W.Layout("/x").vocabulary("node_type") == "/x/vocabularies/node_type"


def test_json_sources(spark, tmp_path):
    path = put(tmp_path / "a" / "x.json", '[{"n": 1}, {"n": 2}]')
    assert sorted(r.n for r in S.read_json_array(spark, path, "n int").collect()) == [1, 2]
    path = put(tmp_path / "b" / "x.json", '{"n": 3}\n{"n": 4}\n')
    assert sorted(r.n for r in S.read_json_lines(spark, path, "n int").collect()) == [3, 4]


def test_streams(spark, tmp_path):
    from graphprep.streaming import counts

    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:10"), (1, "a", "2024-01-01 00:00:20"), (2, "b", "2024-01-01 00:10:00")], "k long, event_type string, t string").selectExpr("k", "event_type", "cast(t as timestamp) t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.k for r in run(counts.stream_first_of_each(stream, "k", "t", "1 hour"), "first_of_each", "append")) == [1, 2]
    assert sorted((r.event_type, r.n) for r in run(counts.stream_windows(stream, "t", "1 minute", "1 hour"), "windows", "complete")) == [("a", 2), ("b", 1)]


def test_json_examples_are_packed(spark, tmp_path):
    from graphprep.sources import writers as W

    W.write_json(spark.range(3).selectExpr("'train' AS split", "id"), str(tmp_path / "packed"))
    assert {p.suffix for p in (tmp_path / "packed" / "split=train").glob("part-*")} == {".gz"}
    assert {r.id for r in spark.read.json(str(tmp_path / "packed")).collect()} == {0, 1, 2}


def test_packed_texts_in_many_parts(spark, monkeypatch, tmp_path):
    """A language's texts in several files give the same digests."""
    from graphprep.plans import QUERIES, source_queries

    sf = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in QUERIES["packed_texts"](spark, sf).collect()}
    monkeypatch.setattr(source_queries, "_PACKED_BYTES", 30_000)
    monkeypatch.setattr(source_queries, "scratch", lambda spark, name: str(tmp_path / name))
    assert {tuple(r) for r in QUERIES["packed_texts"](spark, sf).collect()} == whole
    assert all(len(list(p.glob("part-*.gz"))) > 0 for p in (tmp_path / "packed").glob("lang=*"))
    assert len({p.name for p in (tmp_path / "packed").glob("lang=*/part-*.gz")}) > 4
