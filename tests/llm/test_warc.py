import glob
import hashlib

import zstandard
from pyspark.sql import functions as F

from corpusmill.llm import warc

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    first = {}
    for r in rows:
        p = (r["html"] or "").encode()
        if len(p) >= 1000 and r["page_id"] is not None:
            first[p] = max(first.get(p, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        p = (r["html"] or "").encode()
        f = first.get(p) if len(p) >= 1000 else None
        out.append((r["page_id"], len(p), hashlib.sha1(p).hexdigest(), *(("response", None) if f in (None, r["page_id"]) else ("revisit", f))))
    return sorted(map(str, out))


def test_round_trip(spark):
    big = "é" * 700
    odd = [(1000 + i, f"http://x/{i}", big) for i in range(5)] + [(2000, None, None), (2001, "http://y\r\nz", ""), (None, "u", big), (2002, "s", "small"), (2003, "s", "small"), (2004, "w", "WARC/1.1\r\n\r\n" * 300)]
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").union(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit("x")).withColumn("size", F.lit(1))
    archives = warc.write_archives(pages, frame_bytes=20_000)
    back = warc.read_archives(archives, with_payload=True)
    got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(pages.collect())
    by = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert all(r["payload"].decode() == by[r["page_id"]] for r in back.where("record_type = 'response'").collect())
    assert warc.find(archives, 1000) == big.encode() and warc.find(archives, 2002) == b"small" and warc.find(archives, 5) is not None and warc.find(archives, -1) is None
    # Any reader of the format sees the same bytes, the seek table being skippable.
    for path in glob.glob(archives.path.removeprefix("file://") + "/archives/*.warc.zst"):
        with open(path, "rb") as f:
            reader = warc.Reader(type("F", (), {"size": lambda self, p=path: len(open(p, "rb").read()), "read_at": lambda self, n, at, p=path: open(p, "rb").read()[at : at + n]})())
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
            assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames))) and len(reader.frames) >= 1


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
