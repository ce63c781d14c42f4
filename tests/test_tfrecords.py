"""TFRecord files: framing, messages, the reader's ranges and the writer's transactions."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from graphprep.sources import readers as S
from graphprep.sources import tfrecords as T
from graphprep.sources import writers as W

SCHEMA = "ids array<bigint>, texts array<string>, provenance string, weight double, raw binary, n bigint"


def plain_crc(data):
    """Bit by bit, as the checksum is defined."""
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    c ^= 0xFFFFFFFF
    return (c >> 15 | c << 17) + 0xA282EAD8 & 0xFFFFFFFF


def test_checksums_of_many_lengths():
    # The published check value of CRC-32C over the digits is e3069283.
    assert T.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    r = random.Random(1)
    records = [r.randbytes(n) for n in [0, 1, 7, 8, 9, 255, 256, 257, 511, 512, 519, 520, 3000, *(r.randint(0, 1500) for _ in range(40))]]
    assert T.masked_crcs(records).tolist() == [plain_crc(x) for x in records] and len(T.masked_crcs([])) == 0


def test_messages_come_back():
    row = {"a": [1, -1, 300, 1 << 62, -(1 << 63)], "b": ["x", "é"], "c": None, "d": 2.5, "e": [b"\xff"], "f": []}
    wanted = dict.fromkeys(row, False) | {"b": True}
    assert T.parsed_example(T.example_message(row), wanted) == {"a": row["a"], "b": ["x", "é"], "c": [], "d": [2.5], "e": [b"\xff"], "f": []}
    # Lists that another writer has not packed.
    unpacked = T._field(1, T._field(1, T._field(1, b"k") + T._field(2, T._field(3, b"\x08\x05\x08\xac\x02"))))
    assert T.parsed_example(unpacked, {"k": False}) == {"k": [5, 300]}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"e{i:03d}", "train" if i % 3 else "test", [i, -i, i << 33], ["a", f"é{i}"], f"p{i}" if i % 5 else None, i / 4, bytes([i % 256]) * i, i) for i in range(200)]
    return spark.createDataFrame(data, "example_id string, split string, " + SCHEMA)


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tf") / "out")
    W.write_tfrecords(rows, path, 3)
    return path


def tuples(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


def test_round_trip(spark, rows, folder, tmp_path):
    import os

    names = sorted(n for n in os.listdir(folder) if n[0] not in "._")
    assert names == [f"{s}-{k:05d}-of-00003.tfrecord" for s in ("test", "train") for k in range(3)]
    assert tuples(S.read_tfrecords(spark, folder, SCHEMA)) == tuples(rows.select("ids", "texts", "provenance", "weight", "raw", "n"))
    assert tuples(S.read_tfrecords(spark, folder, "n bigint, absent string", split="test")) == sorted(((i, None) for i in range(0, 200, 3)), key=repr)
    raw = S.read_tfrecords(spark, folder)
    assert raw.columns == ["record"] and raw.count() == 200
    with open(f"{folder}/_SUCCESS") as f:
        assert json.load(f)["records"] == 200
    with pytest.raises(FileExistsError):
        W.write_tfrecords(rows, folder, 3)
    W.write_tfrecords(rows.limit(0), str(tmp_path / "none"), 2)
    assert S.read_tfrecords(spark, str(tmp_path / "none"), "n bigint").count() == 0


def test_two_levels_of_shards(spark, folder):
    parts = [[x.n for x in S.read_tfrecords(spark, folder, "n bigint", hosts=2, host=h, parts=2, part=p).collect()] for h in range(2) for p in range(2)]
    assert all(parts) and sorted(sum(parts, [])) == list(range(200))
    assert S.read_tfrecords(spark, folder, "n bigint", hosts=9, host=8).count() == 0
    with pytest.raises(Exception, match="below hosts"):
        S.read_tfrecords(spark, folder, "n bigint", hosts=2, host=2).count()


@pytest.mark.parametrize("indexed", [True, False])
def test_files_are_cut_into_ranges(spark, rows, tmp_path, monkeypatch, indexed):
    import shutil

    monkeypatch.setattr(T, "BLOCK_BYTES", 500)
    writer = T.TFRecordWriter({"path": str(tmp_path / "w")}, rows.select("n", "raw").schema, False)
    done = writer.write(iter(rows.select("n", "raw").coalesce(1).toArrow().to_batches()))
    writer.commit([done])
    if not indexed:
        shutil.rmtree(tmp_path / "w" / "_index")
    options = {"partBytes": 2000, "splitFiles": "true"}
    df = S.read_tfrecords(spark, str(tmp_path / "w"), "n bigint", **options)
    assert df.rdd.getNumPartitions() > 5 and sorted(x.n for x in df.collect()) == list(range(200))


def test_damaged_files_are_errors(spark, tmp_path):
    good = b"".join(T.framed([b"one", b"two" * 50]))
    for name, raw in (("cut", good[:-1]), ("flip", good[:20] + bytes([good[20] ^ 1]) + good[21:]), ("length", struct.pack("<Q", 1 << 40) + good[8:])):
        (tmp_path / f"{name}.tfrecord").write_bytes(raw)
        with pytest.raises(Exception, match="cut record|wrong checksum"):
            S.read_tfrecords(spark, str(tmp_path / f"{name}.tfrecord")).collect()
    writer = T.TFRecordWriter({"path": str(tmp_path / "w")}, spark.range(1).schema, False)
    writer.commit([writer.write(iter(spark.range(100).toArrow().to_batches()))])
    file = next((tmp_path / "w").glob("*.tfrecord"))
    raw = bytearray(file.read_bytes())
    raw[40] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="wrong checksum of the block"):
        S.read_tfrecords(spark, str(tmp_path / "w"), "id bigint").collect()


def test_lost_tasks_leave_no_part(spark, rows, tmp_path):
    import os

    path = str(tmp_path / "out")

    @F.udf("bigint")
    def killed(n):
        if n == 150:
            os._exit(1)  # the worker dies after other rows have been written
        return n

    with pytest.raises(Exception):
        W.write_tfrecords(rows.repartition(4).withColumn("n", killed("n")), path, 3)
    assert not os.path.exists(path) or os.listdir(path) == []
    W.write_tfrecords(rows, path, 3, mode="append")
    assert S.read_tfrecords(spark, path, "n bigint").count() == 200
    W.write_tfrecords(rows.where("n < 50"), path, 2, mode="overwrite")
    assert S.read_tfrecords(spark, path, "n bigint").count() == 50


def test_attempts_that_ran_twice_count_once(spark, tmp_path):
    import os

    path, batches = str(tmp_path / "out"), spark.range(50).coalesce(1).toArrow().to_batches()
    writer = T.TFRecordWriter({"path": path}, spark.range(1).schema, False)
    first, _ = writer.write(iter(batches)), writer.write(iter(batches))

    def dies():
        yield batches[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.commit([first, None])
    assert sorted(os.listdir(path)) == ["_SUCCESS", "_index", "part-00000.tfrecord"]
    assert S.read_tfrecords(spark, path, "id bigint").count() == 50
    again = T.TFRecordWriter({"path": path}, spark.range(1).schema, False)
    with pytest.raises(ValueError, match="one name"):
        again.commit([again.write(iter(batches))])
    assert sorted(os.listdir(path)) == ["_SUCCESS", "_index", "part-00000.tfrecord"]
