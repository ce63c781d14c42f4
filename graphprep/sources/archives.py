"""Files inside archives, each read by itself.

A first pass opens each archive and lists where its members lie: of .zip files from the directory at their end, of .tar files
from header to header. The list is dealt to tasks by member, and a member is read by its range of bytes, so that a large archive
is read by many tasks and none holds it. A compressed stream (.gz, .tar.gz, .tgz) has no such ranges: it is one entry of the list
and is unpacked by one task, member by member.
"""

from __future__ import annotations

import gzip
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprep.sources.files import system_of

MEMBERS = "archive string, name string, kind string, offset long, packed long, size long, crc long"
#: Bytes of one batch of results, at most unless a member is larger.
BATCH_BYTES = 1 << 25


def _entries(archive: str) -> Iterator[tuple[str | None, str, int, int, int, int | None]]:
    """(name, kind, first byte, bytes there, bytes unpacked, CRC-32 or None)."""
    low = archive.lower()
    if low.endswith((".tar.gz", ".tgz", ".gz")):
        yield None, "gz" if low.endswith(".gz") and not low.endswith(".tar.gz") else "tgz", 0, -1, -1, None
        return
    if not low.endswith((".zip", ".tar")):
        raise ValueError(f"no archive: {archive}")
    system, path = system_of(archive)
    with system.open_input_file(path) as f:
        if low.endswith(".tar"):
            with tarfile.open(fileobj=f, mode="r:") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, "plain", m.offset_data, m.size, m.size, None
            return
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if m.flag_bits & 1 or m.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{m.filename} in {archive} is encrypted or packed by another method")
                # What the member's own header says is read with it.
                yield m.filename, "deflated" if m.compress_type == zipfile.ZIP_DEFLATED else "stored", m.header_offset, m.compress_size, m.file_size, m.CRC


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, name, kind, offset, packed, size, crc) of the archives at a path; contents are not read."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("archive", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])
        for b in batches:
            for archive in b.column(0).to_pylist():
                held = []
                for e in _entries(archive):
                    held.append((archive, *e))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, h, strict=True)) for h in held], kinds)
                        held = []
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, h, strict=True)) for h in held], kinds)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(listed, MEMBERS)


def _content(f, kind: str, offset: int, packed: int, size: int, crc: int | None) -> bytes:
    if kind != "plain":
        f.seek(offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        offset += 30 + sum(struct.unpack_from("<HH", head, 26))
    f.seek(offset)
    raw = f.read(packed)
    out = zlib.decompress(raw, -15) if kind == "deflated" else raw
    if len(out) != size or crc is not None and zlib.crc32(out) != crc:
        raise ValueError("a member is damaged")
    return out


def _streamed(f, kind: str, archive: str) -> Iterator[tuple[str, bytes]]:
    if kind == "gz":
        with gzip.GzipFile(fileobj=f) as g:
            yield archive.rsplit("/", 1)[-1][:-3], g.read()
        return
    with tarfile.open(fileobj=f, mode="r|gz") as t:
        for m in t:
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def read_archives(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Files inside .tar, .tar.gz, .tgz, .zip and .gz archives: rows (archive, name, content). Checksums of .zip members are verified.

    A member is one value and so below 2 GB. parts is the number of pieces that members are dealt to, four a core if not given.
    """

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["archive", "name", "content"])

        for b in batches:
            for r in b.to_pylist():
                system, at = system_of(r["archive"])
                with system.open_input_file(at) as f:
                    if r["kind"] in ("gz", "tgz"):
                        found = _streamed(f, r["kind"], r["archive"])
                    else:
                        found = iter([(r["name"], _content(f, *(r[k] for k in ("kind", "offset", "packed", "size", "crc"))))])
                    for name, content in found:
                        held.append((r["archive"], name, content))
                        size += len(content)
                        if size >= BATCH_BYTES:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    members = list_members(spark, path).withColumn("turn", F.xxhash64("archive", "offset"))
    dealt = members.repartition(parts or 4 * spark.sparkContext.defaultParallelism, "turn").drop("turn")
    return dealt.mapInArrow(unpacked, "archive string, name string, content binary")
