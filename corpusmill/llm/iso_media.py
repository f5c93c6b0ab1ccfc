"""ISO media containers: boxes, sample tables, codec, duration and key frames.

``pack`` puts a payload into a file of the ISO base media family: ``ftyp``,
``moov`` with one sound track of 8-bit samples, and ``mdat``. A media sample of
the sample tables is a unit of 64 bytes, that is 64 8-bit sound samples; every
16th unit is marked as a key frame. ``read`` walks the boxes of such a file or
another one, decodes the sample tables (times, sizes, chunk runs, chunk offsets,
sync samples) and never looks into ``mdat``.

Defined cases: null and empty texts become one unit of zero bytes; a very long text
is one file, whose payload has a 64-bit size; an empty table gives an empty one; repeated
rows get equal files, as nothing in a file depends on when or where it was made;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import written
from corpusmill.ship import ship

UNIT, GROUP, CHUNK, RATE = 64, 16, 256, 8000
# Fixed values of the public format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes) -> bytes:
    """A file that holds ``payload``, of a positive multiple of ``UNIT`` bytes."""
    units = len(payload) // UNIT
    ticks = units * UNIT
    chunks, rest = divmod(units, CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    runs = [(1, CHUNK, 1)] * (chunks > 0) + [(chunks + 1, rest, 1)] * (rest > 0)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, units + 1, GROUP, dtype=">u4")
    n = chunks + (rest > 0)

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64", struct.pack(">I", n), (first + np.arange(n, dtype=np.int64) * (CHUNK * UNIT)).astype(">u8").tobytes()),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))  # with a 64-bit size
    first = len(ftyp) + len(moov(0)) + len(head)
    return b"".join([ftyp, moov(first), head, payload])


def walk(data: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of every box's body, nested ones after their container."""
    end = len(data) if end is None else end
    stack = [((), at, end)]
    while stack:
        path, at, end = stack.pop()
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
            stop = end if size == 0 else at + size
            if stop < body or stop > end:
                raise ValueError(f"box {kind!r} at {at} leaves its container")
            yield (*path, kind), body, stop
            if kind in CONTAINERS:
                stack += [(path, stop, end), ((*path, kind), body, stop)]
                break
            at = stop


@dataclass
class Track:
    codec: str = ""
    scale: int = 0
    duration: int = 0
    sizes: np.ndarray | None = None
    offsets: np.ndarray | None = None
    keys: np.ndarray | None = None  # from 1 on; None: all

    def ranges(self) -> np.ndarray:
        """Byte ranges of the key frames, a row each."""
        at = slice(None) if self.keys is None else self.keys - 1
        return np.stack([self.offsets[at], self.offsets[at] + self.sizes[at]], 1)


def _placed(sizes: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Offsets of all samples, from their sizes, the runs of chunks with equally many, and the chunks' offsets."""
    lasts = np.append(runs[1:, 0] - 1, len(chunks))
    per = np.repeat(runs[:, 1], lasts - runs[:, 0] + 1)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per  # each chunk's first sample
    return np.repeat(chunks[: len(per)] - before[np.minimum(first, max(0, len(sizes) - 1))], per)[: len(sizes)] + before


def read(data: bytes) -> list[Track]:
    """The tracks of a file, from its sample tables."""
    view, tracks, runs, chunks = memoryview(data), [], None, None

    def table(start: int, kind: str, width: int = 1, skip: int = 4) -> np.ndarray:
        """The rows of numbers that follow their count."""
        n = struct.unpack_from(">I", view, start + skip)[0]
        return np.frombuffer(view, kind, n * width, start + skip + 4).astype(np.int64).reshape((n, width) if width > 1 else n)

    for path, start, _ in walk(view):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        elif kind == b"mdhd":
            shape, skip = (">IQ", 20) if view[start] else (">II", 12)
            tracks[-1].scale, tracks[-1].duration = struct.unpack_from(shape, view, start + skip)
        elif kind == b"stsd":
            tracks[-1].codec = bytes(view[start + 12 : start + 16]).decode("latin-1")
        elif kind == b"stsz":
            each, n = struct.unpack_from(">II", view, start + 4)
            tracks[-1].sizes = np.full(n, each, np.int64) if each else table(start, ">u4", skip=8)
        elif kind == b"stsc":
            runs = table(start, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            chunks = table(start, ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stss":
            tracks[-1].keys = table(start, ">u4")
        if tracks and tracks[-1].offsets is None and tracks[-1].sizes is not None and runs is not None and chunks is not None:
            tracks[-1].offsets = _placed(tracks[-1].sizes, runs, chunks)
            runs = chunks = None
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The track's samples in order; neighbours are read at once."""
    at, ends = track.offsets, track.offsets + track.sizes
    if not len(at):
        return b""
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != ends[:-1]]))
    tails = np.append(heads[1:], len(at)) - 1
    return b"".join(data[a:z] for a, z in zip(at[heads].tolist(), ends[tails].tolist()))


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media), one file per row, written in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sizes, files = [], []
                for t in b.column(1):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    sizes.append(len(raw))
                    files.append(pack(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return written(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"))


def features(media: DataFrame) -> DataFrame:
    """Per file: codec, duration, key frames' byte ranges, and digests of the
    payload as stored and of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration_s", "keyframes"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                rows, spans = [], []
                for m in b.column(2):
                    data = m.as_buffer().to_pybytes()
                    (t,) = read(data)
                    payload = payload_of(data, t)
                    spans.append(t.ranges())
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), t.codec, t.duration / t.scale))
                both = np.concatenate(spans)
                keys = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"])
                ends = pa.array(np.cumsum([0, *map(len, spans)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, zip(*rows)), pa.ListArray.from_arrays(ends, keys)], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, keyframes array<struct<start:long,end:long>>")
