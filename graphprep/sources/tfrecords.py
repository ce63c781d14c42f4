"""TFRecord files of Example messages as a Spark data source: framing, checksums, the few message types needed, reader and writer.

spark.read.format("graphprep_tfrecord") and df.write.format("graphprep_tfrecord") work once register() has named the source.

Reading. Without a schema a row is a record's bytes; with one its columns are features by name (numbers, strings, bytes, arrays
of them; bigint arrays for int64 lists and so on). A feature that is missing gives null, and so does an empty list for a column
that is no array. Files are taken in the order of their names: `hosts` and `host` deal them to hosts, `parts` and `part` a
host's files to its parts. A file is cut into ranges of `partBytes`; a range's records begin where its blocks do. Blocks come
from the index that the writer has left, with a checksum each. For files of other writers the lengths in front of the records
are the index: `splitFiles` lets ranges be found by them, from record to record; without it such a file is one range. Their
records are held against the checksums that every record has.

Writing is a transaction. Tasks write files and their indexes below a folder of the job and tell the driver their names; the
driver moves them once all tasks have succeeded. What tasks that were lost, or ran twice, have written goes with that folder.
Rows with columns split and _shard go to split-k-of-n.tfrecord (option `shards`), in the order in which they come: rows of a
file must come to one task one after another, as write_tfrecords() sees to. Without them each task writes part-k.tfrecord.

Paths are URIs that all executors reach; one without a scheme is a local path. writers.write_tfrecords() and
readers.read_tfrecords() complete paths as Spark would.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from graphprep.sources.files import system_of

#: The Castagnoli polynomial, reflected, and what masks a checksum.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane: long records are cut into lanes whose checksums are found together and then folded.
_LANE = 256
#: Bytes of one block of a file, of one read and of one range, at most unless a record is larger.
BLOCK_BYTES, READ_BYTES, PART_BYTES = 1 << 23, 1 << 23, 1 << 27
#: Records of one batch.
BATCH = 1024
FORMAT, SUFFIX, INDEX = "graphprep_tfrecord", ".tfrecord", "_index"


def _tables() -> np.ndarray:
    """What a byte does to a checksum when 0 to 7 bytes follow it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    out = [one]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ one[out[-1] & 255])
    return np.stack(out)


_T = _tables()


def _word(c: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Checksums after eight bytes more."""
    lo, hi = (words & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ c, (words >> np.uint64(32)).astype(np.uint32)
    return _T[7][lo & 255] ^ _T[6][lo >> 8 & 255] ^ _T[5][lo >> 16 & 255] ^ _T[4][lo >> 24] ^ _T[3][hi & 255] ^ _T[2][hi >> 8 & 255] ^ _T[1][hi >> 16 & 255] ^ _T[0][hi >> 24]


def _shift() -> np.ndarray:
    """What a lane of zeros does to each byte of a checksum."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(_LANE // 8):
        c = _word(c, np.zeros(len(c), np.uint64))
    return c.reshape(4, 256)


_S = _shift()


def masked_crcs(records: Sequence[bytes]) -> np.ndarray:
    """The masked CRC-32C of many byte strings at once."""
    sizes = np.array([len(r) for r in records], np.int64)
    raw = b"".join(records) + bytes(8)
    starts = np.cumsum(sizes) - sizes
    eight, one = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)), np.frombuffer(raw, np.uint8)
    lanes = sizes // _LANE
    place = np.repeat(starts, lanes) + _LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    part = np.zeros(len(place), np.uint32)
    for at in range(0, _LANE, 8):
        part = _word(part, eight[place + at])
    # Lanes are folded from the first to the last, those of all records side by side.
    c, first = np.full(len(sizes), 0xFFFFFFFF, np.uint32), np.cumsum(lanes) - lanes
    order = np.argsort(-lanes, kind="stable")
    for k in range(int(lanes.max(initial=0))):
        on = order[: np.searchsorted(-lanes[order], -k, side="left")]
        x = c[on]
        c[on] = _S[0][x & 255] ^ _S[1][x >> 8 & 255] ^ _S[2][x >> 16 & 255] ^ _S[3][x >> 24] ^ part[first[on] + k]
    left, at = sizes % _LANE, starts + lanes * _LANE
    for k in range(int(left.max(initial=0)) // 8):
        on = np.flatnonzero(left >= 8 * (k + 1))
        c[on] = _word(c[on], eight[at[on] + 8 * k])
    for k in range(7):
        on = np.flatnonzero(left % 8 > k)
        c[on] = (c[on] >> 8) ^ _T[0][(c[on] ^ one[at[on] + left[on] // 8 * 8 + k]) & 255]
    c ^= np.uint32(0xFFFFFFFF)
    return (c >> 15 | c << 17) + np.uint32(_MASK)


def masked_crc(data: bytes) -> int:
    return int(masked_crcs([data])[0])


def framed(records: Sequence[bytes]) -> list[bytes]:
    """Records with their lengths and the checksums of both."""
    sizes = [struct.pack("<Q", len(r)) for r in records]
    return [s + struct.pack("<I", a) + r + struct.pack("<I", b) for s, a, r, b in zip(sizes, masked_crcs(sizes).tolist(), records, masked_crcs(records).tolist(), strict=True)]


def _checked(heads: list[bytes], records: list[bytes], ends: list[bytes]) -> list[bytes]:
    want = np.frombuffer(b"".join(h[8:] for h in heads) + b"".join(ends), "<u4")
    if (masked_crcs([h[:8] for h in heads] + records) != want).any():
        raise ValueError("wrong checksum")
    return records


def unframed(read, verify: bool = True) -> Iterator[list[bytes]]:
    """Lists of the records that read(n), the next n bytes or what is left, gives. A wrong checksum or a cut record is an error."""
    heads, records, ends, size = [], [], [], 0
    while head := read(12):
        if len(head) < 12:
            raise ValueError("cut record")
        n = struct.unpack_from("<Q", head)[0]
        if n > READ_BYTES and masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("wrong checksum")  # before that many bytes are read
        data, end = read(n), read(4)
        if len(data) < n or len(end) < 4:
            raise ValueError("cut record")
        heads.append(head)
        records.append(data)
        ends.append(end)
        size += n
        if len(records) >= BATCH or size >= READ_BYTES:
            yield _checked(heads, records, ends) if verify else records
            heads, records, ends, size = [], [], [], 0
    if records:
        yield _checked(heads, records, ends) if verify else records


def _long_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: Numbers of up to two bytes, which nearly all lengths, ids and places are.
_SHORT = [_long_varint(n) for n in range(1 << 14)]


def _varint(n: int) -> bytes:
    return _SHORT[n] if 0 <= n < 1 << 14 else _long_varint(n)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def example_message(row: dict[str, object]) -> bytes:
    """An Example with a feature for each entry: byte lists for strings and bytes, float lists for floats, int64 lists for other
    numbers. Null is an empty list, null entries of lists are left out."""
    features = b""
    for name, value in row.items():
        values = [v for v in value if v is not None] if isinstance(value, list) else [] if value is None else [value]
        if values and isinstance(values[0], str | bytes):
            raw = [v.encode() if isinstance(v, str) else v for v in values]
            kind = _field(1, b"".join([part for v in raw for part in (b"\n", _varint(len(v)), v)]))  # field 1 with a length
        elif values and isinstance(values[0], float):
            kind = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            kind = _field(3, _field(1, b"".join(map(_varint, values))) if values else b"")
        features += _field(1, _field(1, name.encode()) + _field(2, kind))
    return _field(1, features)


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, content) of a message's fields."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8 if kind == 1 else -1
        if n < 0 or at + n > end:
            raise ValueError("not a message")
        yield tag >> 3, kind, raw[at : at + n]
        at += n


def _varints(raw: bytes) -> list[int]:
    """Packed int64 numbers."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return []
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = 7 * (np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1))
    return np.bitwise_or.reduceat((b[: ends[-1] + 1] & 127).astype(np.uint64) << shift.astype(np.uint64), starts).view(np.int64).tolist()


def parsed_example(raw: bytes, wanted: dict[str, bool]) -> dict[str, list]:
    """Features by name of those wanted; True asks for byte lists as text."""
    out: dict[str, list] = {}
    for number, _, features in _fields(raw):
        for inner, _, entry in _fields(features) if number == 1 else ():
            parts = {k: v for k, _, v in _fields(entry)} if inner == 1 else {}
            name = parts.get(1, b"").decode()
            if name not in wanted:
                continue
            values: list = []
            for kind, _, holder in _fields(parts.get(2, b"")):
                for _, wire, v in _fields(holder):
                    if kind == 1:
                        values.append(v.decode() if wanted[name] else v)
                    elif kind == 2:
                        values += np.frombuffer(v, "<f4").tolist()
                    else:
                        values += _varints(v) if wire == 2 else [v - (1 << 64) if v >> 63 else v]
            out[name] = values
    return out


@dataclass
class Range(InputPartition):
    """The k-th of n ranges of a file."""

    path: str
    size: int
    k: int = 0
    n: int = 1


class TFRecordReader(DataSourceReader):
    """options as Spark gives them, with names in lower case."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.types = options["path"], {f.name: f.dataType for f in schema.fields}
        number = lambda name, default: int(options.get(name.lower(), default))
        self.hosts, self.host, self.parts, self.part = number("hosts", 1), number("host", 0), number("parts", 1), number("part", 0)
        self.part_bytes, self.split_files, self.split = number("partBytes", PART_BYTES), options.get("splitfiles", "false").lower() == "true", options.get("split")
        if not (0 <= self.host < self.hosts and 0 <= self.part < self.parts and self.part_bytes > 0):
            raise ValueError("host and part are numbers from 0 below hosts and parts")

    def partitions(self) -> Sequence[Range]:
        """From the listing alone: no file is opened on the driver."""
        system, path = system_of(self.path)
        about = system.get_file_info(path)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in found if f.type == fs.FileType.File and (about.type == fs.FileType.File or f.base_name.endswith(SUFFIX) and f.base_name[0] not in "._")), key=lambda f: f.path)
        files = [f for f in files if self.split is None or f.base_name.startswith(f"{self.split}-")]
        folder = path if about.type == fs.FileType.Directory else path.rpartition("/")[0]
        known = {f.base_name for f in system.get_file_info(fs.FileSelector(f"{folder}/{INDEX}", allow_not_found=True))}
        out = []
        for f in files[self.host :: self.hosts][self.part :: self.parts]:
            n = -(-f.size // self.part_bytes) if self.split_files or f"{f.base_name}.json" in known else 1
            out += [Range(f.path, f.size, k, n) for k in range(max(1, n))]
        return out or [Range("", 0)]

    def _blocks(self, system: fs.FileSystem, r: Range) -> Iterator[tuple[int, int, int | None]]:
        """(first byte, bytes, checksum or None) of the blocks that begin in a range."""
        folder, _, name = r.path.rpartition("/")
        lo, hi = r.size * r.k // r.n, r.size * (r.k + 1) // r.n
        index = f"{folder}/{INDEX}/{name}.json"
        if system.get_file_info(index).type == fs.FileType.File:
            with system.open_input_stream(index) as f:
                yield from ((a, n, crc) for a, n, crc in json.loads(f.read())["blocks"] if lo <= a < hi)
            return
        if r.n == 1:
            yield 0, r.size, None
            return
        at, first = 0, None
        with system.open_input_file(r.path) as f:
            while at < hi:
                if first is None and at >= lo:
                    first = at
                f.seek(at)
                head = f.read(12)
                if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
                    raise ValueError("wrong checksum")
                at += 16 + struct.unpack_from("<Q", head)[0]
        if first is not None:
            yield first, at - first, None

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = system_of(self.path)
        with system.open_input_file(partition.path) as f:
            for first, size, crc in self._blocks(system, partition):
                f.seek(first)
                if crc is not None:
                    raw = f.read(size)
                    if len(raw) != size or zlib.crc32(raw) != crc:
                        raise ValueError(f"wrong checksum of the block at {first} of {partition.path}")
                    source = pa.BufferReader(raw)
                    yield from map(self._batch, unframed(source.read, verify=False))
                    continue
                left = size

                def read(n: int) -> bytes:
                    nonlocal left
                    got = f.read(min(n, left))
                    left -= len(got)
                    return got

                yield from map(self._batch, unframed(read))

    def _batch(self, records: list[bytes]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        if list(self.types) == ["record"] and isinstance(self.types["record"], BinaryType):
            return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
        inner = lambda t: t.elementType if isinstance(t, ArrayType) else t
        rows = [parsed_example(r, {n: isinstance(inner(t), StringType) for n, t in self.types.items()}) for r in records]

        def value(row: dict[str, list], name: str, t: DataType) -> object:
            got = row.get(name)
            return got if got is None or isinstance(t, ArrayType) else got[0] if got else None

        return pa.RecordBatch.from_arrays([pa.array([value(r, n, t) for r in rows], to_arrow_type(t)) for n, t in self.types.items()], names=list(self.types))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name, records, bytes); they lie in its folder."""

    folder: str
    files: list[tuple[str, int, int]] = field(default_factory=list)


class _File:
    """A file under way, with the blocks of its index."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str) -> None:
        self.system, self.folder, self.name = system, folder, name
        self.out = system.open_output_stream(f"{folder}/{name}")
        self.held: list[bytes] = []
        self.size = self.done = self.records = 0
        self.blocks: list[tuple[int, int, int]] = []

    def add(self, records: list[bytes]) -> None:
        for raw in framed(records):
            self.held.append(raw)
            self.size += len(raw)
            if self.size >= BLOCK_BYTES:
                self.flush()
        self.records += len(records)

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            self.out.write(raw)
            self.blocks.append((self.done, len(raw), zlib.crc32(raw)))
            self.done, self.held, self.size = self.done + len(raw), [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.out.close()
        with self.system.open_output_stream(f"{self.folder}/{self.name}.json") as f:
            f.write(json.dumps({"records": self.records, "blocks": self.blocks}).encode())
        return self.name, self.records, self.done


class TFRecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.overwrite, self.shards = options["path"], overwrite, int(options.get("shards", 1))
        self.sharded = {"split", "_shard"} <= set(schema.names)
        self.columns = [c for c in schema.names if not (self.sharded and c in ("split", "_shard"))]
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = system_of(self.path)
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        done = Written(f"{path}/{self.job}/{number}-{uuid.uuid4().hex}")
        system.create_dir(done.folder, recursive=True)
        now: _File | None = None
        for batch in iterator:
            names = [f"part-{number:05d}{SUFFIX}"] * batch.num_rows
            if self.sharded:
                names = [f"{s}-{k:05d}-of-{self.shards:05d}{SUFFIX}" for s, k in zip(batch.column(batch.schema.get_field_index("split")).to_pylist(), batch.column(batch.schema.get_field_index("_shard")).to_pylist(), strict=True)]
            rows = batch.select(self.columns)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if now is None or now.name != names[lo]:
                    if now:
                        done.files.append(now.close())
                    if names[lo] in {f[0] for f in done.files}:
                        raise ValueError(f"the rows of {names[lo]} do not come one after another")
                    now = _File(system, done.folder, names[lo])
                for at in range(lo, hi, BATCH):
                    now.add([example_message(r) for r in rows.slice(at, min(BATCH, hi - at)).to_pylist()])
        if now:
            done.files.append(now.close())
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = system_of(self.path)
        made = [m for m in messages if isinstance(m, Written)]
        names = [f[0] for m in made for f in m.files]
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(SUFFIX)}
        if len(set(names)) < len(names) or not self.overwrite and there & set(names):
            self.abort(messages)
            raise ValueError("two tasks, or this and an earlier write, have made a file of one name")
        system.create_dir(f"{path}/{INDEX}", recursive=True)
        for old in there if self.overwrite else ():
            system.delete_file(f"{path}/{old}")
            if system.get_file_info(f"{path}/{INDEX}/{old}.json").type == fs.FileType.File:
                system.delete_file(f"{path}/{INDEX}/{old}.json")
        for m in made:
            for name, *_ in m.files:
                system.move(f"{m.folder}/{name}.json", f"{path}/{INDEX}/{name}.json")
                system.move(f"{m.folder}/{name}", f"{path}/{name}")
        self.abort(messages)
        with system.open_output_stream(f"{path}/_SUCCESS") as f:
            f.write(json.dumps({"files": len(names), "records": sum(f[1] for m in made for f in m.files), "bytes": sum(f[2] for m in made for f in m.files)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing of the job stays, whichever tasks have told of themselves."""
        system, path = system_of(self.path)
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema: StructType) -> TFRecordReader:
        return TFRecordReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> TFRecordWriter:
        return TFRecordWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecordSource)
