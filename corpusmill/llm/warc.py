"""WARC archives as seekable Zstandard bundles.

An archive is a run of independent Zstandard frames, each holding whole WARC
records up to about ``frame_bytes``, and a last, skippable frame with the seek
table of the public seekable format: each frame's compressed and plain size,
their number, a descriptor byte and the magic number. The index maps a record's
identifier to its archive, frame, and place within the frame.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest page id is a response; the others are revisits that name it. Payloads
count as equal if their SHA-1 is, as the revisit profile has it.

Archives of lost or repeated tasks are no harm: only those in the written index
are read.

Defined cases: a null payload is empty; a null URL leaves out the target field;
repeated page ids of a largest page are all responses, repeated rows among them; a
payload longer than a frame is a frame of its own; an empty table makes an index
without records; a null page id never
becomes a group's response unless the group has no other, and is read back as
null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.shared import shared_dir, written
from corpusmill.ship import ship

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit's block has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC fields, HTTP fields, payload, end) of the record at ``at``."""
    body = data.index(b"\r\n\r\n", at) + 4
    version, *lines = data[at : body - 4].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines)
    end = body + int(fields["Content-Length"])
    start = data.index(b"\r\n\r\n", body) + 4
    http = dict(x.split(": ", 1) for x in data[body : start - 4].decode().split("\r\n")[1:])
    return fields, http, data[start:end], end + 4


class Bundle:
    """Writes records to frames, and the seek table after them."""

    def __init__(self, out, frame_bytes: int):
        self.out, self.frame_bytes, self.pack = out, frame_bytes, zstandard.ZstdCompressor(level=3)
        self.held, self.size, self.at, self.table = [], 0, 0, []

    def add(self, data: bytes) -> tuple[int, int, int, int]:
        """(frame, the frame's offset, place within it, length)."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.at, self.size, len(data)
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.size:
            frame = self.pack.compress(b"".join(self.held))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.at += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


class Reader:
    """Opens a bundle by its seek table; ``frame(k)`` reads that frame alone."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        table = file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


@dataclass(frozen=True)
class Archives:
    spark: SparkSession
    path: str

    @property
    def index(self) -> DataFrame:
        """(record_id, archive, frame, frame_offset, place, length)"""
        return self.spark.read.parquet(f"{self.path}/index")


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, frame_bytes: int = 1 << 20, archive_bytes: int = 1 << 30) -> Archives:
    spark = pages.sparkSession
    ship(spark)
    path = shared_dir(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.octet_length(body).alias("size"), F.sha1(body).alias("digest"))
    copies = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # Written, so that Spark knows its size: a small one is broadcast, a large one joined by its key.
    first = written(copies.select(F.col("digest").alias("own"), "first"), f"{path}/first")
    told = rows.join(first, (rows["digest"] == first["own"]) & (rows["size"] >= min_bytes), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    told = told.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to"))
    folder = f"{path}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        bundle = name = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                p = b.column(2)[i]
                page, link, _, size, digest, to = [b.column(k)[i].as_py() if k != 2 else None for k in range(6)]
                if bundle is None or bundle.at > archive_bytes:
                    if bundle:
                        bundle.close()
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(fs.open_output_stream(f"{at}/{name}", compression=None), frame_bytes)
                    bundle.add(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:%b>\r\nWARC-Date: %b\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (name.encode(), DATE.encode()))
                data = record(page, link, p.as_buffer().to_pybytes() if p.is_valid else b"", size, digest, to)
                out.append((f"urn:x-page:{page}", name, *bundle.add(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["record_id", "archive", "frame", "frame_offset", "place", "length"])
        if bundle:
            bundle.close()

    written(told.mapInArrow(run, "record_id string, archive string, frame long, frame_offset long, place long, length long"), f"{path}/index")
    return Archives(spark, path)


def read_archives(archives: Archives, with_payload: bool = False) -> DataFrame:
    """A row per record, from the archives: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, and the payload if asked for. A response's
    bytes and digest are counted again; a revisit's are as its head has them."""
    folder = f"{archives.path}/archives"
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * with_payload]
    page = lambda x: None if x.endswith(":None>") else int(x.rpartition(":")[2][:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        name = reader = None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for archive, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if archive != name:
                    name, reader = archive, Reader(fs.open_input_file(f"{path}/{archive}"))
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    if data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo", at):
                        at = data.index(b"\r\n\r\n", at) + 8
                        continue
                    f, http, payload, at = parse(data, at)
                    own = f["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest()
                    if own and digest != f["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload isn't what was written")
                    rows.append((
                        page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], None if own else page(f["WARC-Refers-To"]),
                        len(payload) if own else int(http["Content-Length"]), digest if own else f["WARC-Payload-Digest"][5:], payload,
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[: len(names)], kinds)], names)

    frames = archives.index.select("archive", "frame").distinct().repartition("archive", "frame").sortWithinPartitions("archive", "frame")
    return frames.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def find(archives: Archives, page_id: int) -> bytes | None:
    """One record's payload, read by its place in the index; a revisit's is its
    response's."""
    x = archives.index.where(F.col("record_id") == f"urn:x-page:{page_id}").first()
    if not x:
        return None
    fs, path = pafs.FileSystem.from_uri(f"{archives.path}/archives")
    data = Reader(fs.open_input_file(f"{path}/{x['archive']}")).frame(x["frame"])
    fields, _, payload, _ = parse(data, x["place"])
    return payload if fields["WARC-Type"] == "response" else find(archives, int(fields["WARC-Refers-To"].rpartition(":")[2][:-1]))
