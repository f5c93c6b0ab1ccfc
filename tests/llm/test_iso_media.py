import hashlib
import struct
import zlib

from corpusmill.llm import iso_media as m
from corpusmill.llm import queries


def test_file():
    payload = bytes(range(256)) * 300
    data = m.pack(payload)
    (t,) = m.read(data)
    assert (t.codec, t.scale, t.duration, len(t.sizes)) == ("raw ", 8000, len(payload), len(payload) // 64)
    assert m.payload_of(data, t) == payload
    assert t.ranges()[1].tolist() == [t.offsets[16], t.offsets[16] + 64] and data[t.offsets[16] :][:64] == payload[1024:1088]
    kinds = [p[-1] for p, _, _ in m.walk(memoryview(data))]
    assert kinds[:3] == [b"ftyp", b"moov", b"mvhd"] and kinds[-1] == b"mdat" and kinds.index(b"stbl") < kinds.index(b"stsd")


def test_other_shapes():
    """Sizes one by one, several chunk runs, 32-bit offsets, an old header, no sync table."""
    sizes = [3, 5, 7, 11, 2]
    at = [100, 200, 300]
    stbl = m.box(
        b"stbl", m.full(b"stsd", struct.pack(">I", 1), m.box(b"avc1", bytes(8))), m.full(b"stts", struct.pack(">III", 1, 5, 10)),
        m.full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 3, 1, 1)), m.full(b"stsz", struct.pack(">II5I", 0, 5, *sizes)), m.full(b"stco", struct.pack(">I3I", 3, *at)),
    )
    mdhd = m.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 600, 50, 0, 0))
    data = m.box(b"ftyp", b"isom") + m.box(b"moov", m.box(b"trak", m.box(b"mdia", mdhd, m.box(b"minf", stbl)))) + struct.pack(">I4s", 0, b"mdat") + b"x" * 400
    (t,) = m.read(data)
    assert (t.codec, t.scale, t.duration) == ("avc1", 600, 50)
    assert t.ranges().tolist() == [[100, 103], [103, 108], [200, 207], [207, 218], [300, 302]]
    assert m.payload_of(bytes(range(256)) * 2, t) == bytes([*range(100, 108), *range(200, 218), *[44, 45]])


def by_hand(payload):
    """The file of a payload of up to 16 units, put together box by box: sizes, then names, then fields."""
    units = len(payload) // 64
    n = lambda x, width=4: x.to_bytes(width, "big")
    b = lambda name, body: n(8 + len(body)) + name + body
    unity = n(65536) + bytes(12) + n(65536) + bytes(12) + n(1 << 30)
    ftyp = b(b"ftyp", b"isom" + n(512) + b"isom" + b"qt  ")
    entry = b(b"raw ", bytes(6) + n(1, 2) + bytes(8) + n(1, 2) + n(8, 2) + bytes(4) + n(8000 << 16))

    def moov(first):
        stbl = b(b"stbl", b(b"stsd", bytes(4) + n(1) + entry) + b(b"stts", bytes(4) + n(1) + n(units) + n(64)) + b(b"stsc", bytes(4) + n(1) + n(1) + n(units) + n(1))
                 + b(b"stsz", bytes(4) + n(64) + n(units)) + b(b"co64", bytes(4) + n(1) + n(first, 8)) + b(b"stss", bytes(4) + n(1) + n(1)))
        dinf = b(b"dinf", b(b"dref", bytes(4) + n(1) + b(b"url ", n(1))))
        minf = b(b"minf", b(b"smhd", bytes(8)) + dinf + stbl)
        mdhd = b(b"mdhd", n(1 << 24) + bytes(16) + n(8000) + n(64 * units, 8) + n(0x55C4, 2) + bytes(2))
        hdlr = b(b"hdlr", bytes(8) + b"soun" + bytes(12) + b"sound\0")
        tkhd = b(b"tkhd", n(1 << 24 | 3) + bytes(16) + n(1) + bytes(4) + n(64 * units, 8) + bytes(8) + bytes(4) + n(256, 2) + bytes(2) + unity + bytes(8))
        mvhd = b(b"mvhd", n(1 << 24) + bytes(16) + n(8000) + n(64 * units, 8) + n(65536) + n(256, 2) + bytes(10) + unity + bytes(24) + n(2))
        return b(b"moov", mvhd + b(b"trak", tkhd + b(b"mdia", mdhd + hdlr + minf)))

    return ftyp + moov(len(ftyp) + len(moov(0)) + 16) + n(1) + b"mdat" + n(16 + len(payload), 8) + payload


def test_bytes_by_hand():
    for units in (1, 2, 16):
        payload = bytes(range(64)) * units
        assert m.pack(payload) == by_hand(payload)


def test_long_texts_have_many_chunks():
    payload = bytes(range(256)) * 64 * 40  # 10,240 units in 40 chunks
    (t,) = m.read(m.pack(payload + bytes(64)))
    assert len(t.offsets) == 10_241 and m.payload_of(m.pack(payload + bytes(64)), t) == payload + bytes(64)
    assert len(t.ranges()) == 641


def test_query(spark, odd_docs, no_docs):
    for r in m.features(m.stored_media(odd_docs)).collect():
        text = next(d["text"] for d in odd_docs.collect() if d["doc_id"] == r["doc_id"])
        raw = (text or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(want[-64:]) and r["media_sha256"] == hashlib.sha256(m.pack(want)).hexdigest()
        if len(want) <= 1024:
            assert r["media_sha256"] == hashlib.sha256(by_hand(want)).hexdigest()
        spans = [(x["start"], x["end"]) for x in r["keyframes"]]
        first = r["media_bytes"] - len(want)
        assert spans == [(first + k, first + k + 64) for k in range(0, len(want), 1024)] and (r["codec"], r["duration_s"]) == ("raw ", len(want) / 8000)
    assert m.features(m.stored_media(no_docs)).count() == 0
    out = queries.op4_iso_media(spark, "/root/testdata/sf0.001")
    assert out.count() == 200 and out.where("feature like 'codec=raw ;duration=%'").count() == 200
