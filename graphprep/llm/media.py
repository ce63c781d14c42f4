"""Media columns: byte payloads kept as PNG images in binary columns, read back with all checks, and hashed by appearance.

write_png lays a payload out as rows of 8-bit RGB samples, chooses a filter for each row and wraps the deflated rows in
chunks with CRC-32. read_png checks the signature, every chunk's checksum, the header, the deflated stream's checksum and
length, and undoes all five row filters with numpy. appearance_hash takes the mean grey of a 32 x 32 grid, its two-dimensional
cosine transform, and one bit for each of the 64 lowest frequencies: above the median of these or not.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphprep.llm.common import map_batches, text_bytes

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples are RGB; a row of 64 pixels has 192 bytes.
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _cost(rows: np.ndarray) -> np.ndarray:
    """Sum of the samples' distances from zero as signed bytes: the usual guess at how well a row deflates."""
    return np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=1)


def write_png(payload: bytes, level: int = 1) -> bytes:
    """payload: a positive multiple of ROW bytes."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"payload: a positive multiple of {ROW} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    up = rows.copy()
    up[1:] -= rows[:-1]
    left = rows.copy()
    left[:, CHANNELS:] -= rows[:, :-CHANNELS]
    kind = np.argmin(np.stack([_cost(rows), _cost(left), _cost(up)]), axis=0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = kind
    for k, x in enumerate((rows, left, up)):
        out[kind == k, 1:] = x[kind == k]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(line) + step, np.int32)
    over = np.concatenate([np.zeros(step, np.int32), above.astype(np.int32)])
    for i in range(step, len(out), step):
        a, b, c = out[i - step : i], over[i : i + step], over[i - step : i]
        pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        out[i : i + step] = (line[i - step : i] + guess) & 255
    return out[step:].astype(np.uint8)


def _average(line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(line) + step, np.int32)
    for i in range(0, len(line), step):
        out[i + step : i + 2 * step] = (line[i : i + step] + ((out[i : i + step] + above[i : i + step]) >> 1)) & 255
    return out[step:].astype(np.uint8)


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """rows: filter byte and filtered samples a row. Runs of rows with one of the first three filters are undone at once."""
    kinds, data = rows[:, 0], rows[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        kind = kinds[a] if a < len(kinds) else 0
        if kind == 1:
            part = data[a:b].reshape(b - a, -1, step)
            data[a:b] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            if a:
                data[a] += data[a - 1]
            data[a:b] = np.cumsum(data[a:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            undo = _average if kind == 3 else _paeth
            for r in range(a, b):
                data[r] = undo(data[r].astype(np.int32), (data[r - 1] if r else np.zeros(data.shape[1], np.uint8)).astype(np.int32), step)
    return data


def read_png(blob: bytes) -> np.ndarray:
    """Samples as (height, width, channels). Raises ValueError for anything damaged or of another kind than 8-bit grey or RGB(A)."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(blob):
        if at + 12 > len(blob):
            raise ValueError("cut off inside a chunk")
        (n,), kind = struct.unpack(">I", blob[at : at + 4]), blob[at + 4 : at + 8]
        body = blob[at + 8 : at + 8 + n]
        if len(body) < n or len(blob) < at + 12 + n:
            raise ValueError("cut off inside a chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", blob[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"wrong checksum of chunk {kind!r}")
        at += 12 + n
        if header is None and kind != b"IHDR":
            raise ValueError("no header first")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if not ended or at != len(blob) or header is None:
        raise ValueError("no end where it should be")
    width, height, depth, colour, method, filtering, interlace = header
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or not step or method or filtering or interlace or not width or not height:
        raise ValueError("unsupported kind of PNG")
    size, inflater = height * (width * step + 1), zlib.decompressobj()
    raw = inflater.decompress(b"".join(packed), size + 1)
    if len(raw) != size or not inflater.eof or inflater.unused_data:
        raise ValueError("wrong length of the samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), step).reshape(height, width, step)


def _basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


_BASIS = _basis()


def appearance_hash(samples: np.ndarray) -> bytes:
    """64 bits of the low frequencies. The grid's cells hold mean grey; a side shorter than the grid repeats its samples."""
    grey = samples.mean(axis=2)
    for axis in (0, 1):
        n = grey.shape[axis]
        cuts = np.arange(GRID) * n // GRID
        ends = np.maximum((np.arange(GRID) + 1) * n // GRID, cuts + 1)
        sums = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis=axis)], axis=axis)
        shape = [1, 1]
        shape[axis] = GRID
        grey = (sums.take(ends, axis) - sums.take(cuts, axis)) / (ends - cuts).reshape(shape)
    low = np.round(_BASIS @ grey @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(raw: bytes) -> bytes:
    """raw with spaces appended up to a positive multiple of ROW."""
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def with_media(docs: DataFrame, text: str = "text", media: str = "media", length: str = "media_payload_bytes") -> DataFrame:
    """Add the text's payload as a PNG in a binary column, and the payload's length without padding. Null counts as empty.

    All other columns stay; columns that bear the new names already are replaced.
    """
    kept = docs.drop(*[c for c in (media, length) if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = text_bytes(b.column(text))
            made = [pa.array([write_png(payload_of(x)) for x in raws], pa.binary()), pa.array([len(x) for x in raws], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, media, length])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    return map_batches(kept, run, StructType([*kept.schema.fields, StructField(media, BinaryType()), StructField(length, LongType())]))


def read_media(images: DataFrame, key: str, media: str = "media", length: str = "media_payload_bytes") -> DataFrame:
    """Decode each image and give key, n_bytes, payload, media_bytes, media_sha256, phash (8 bytes), error.

    A null or damaged image gives nulls and the reason in error instead of failing the job. Payloads are the stored bytes
    with padding; n_bytes says how many count.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for blob in b.column(media).to_pylist():
                try:
                    if blob is None:
                        raise ValueError("null")
                    samples = read_png(blob)
                    row = [samples.tobytes(), len(blob), hashlib.sha256(blob).hexdigest(), appearance_hash(samples), None]
                except (ValueError, zlib.error) as e:
                    row = [None, None if blob is None else len(blob), None if blob is None else hashlib.sha256(blob).hexdigest(), None, str(e)]
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            types = [pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(length), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names=["key", "n_bytes", "payload", "media_bytes", "media_sha256", "phash", "error"])

    return map_batches(images.select(key, media, length), run, f"key {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string, phash binary, error string")
