import glob
import shutil
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import chunk_store as cs
from corpusmill.llm.tokenizer_files import BYTE_BPE
from corpusmill.shared import shared_dir

FOLDER = "/root/testdata/sf0.001"


def plain(docs):
    t = Tokenizer.from_file(BYTE_BPE)
    out, start = [], 0
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0)):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        out.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def check(docs):
    want = plain(docs.collect())
    store = cs.write_store(docs, BYTE_BPE)
    got = sorted((tuple(r) for r in cs.digests(store).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    whole = sorted((tuple(r) for r in cs.read_ids(store).collect()), key=lambda r: r[1])
    assert [(d, s, list(x)) for d, s, x in whole] == [(d, s, x) for d, s, _, _, x in want]
    assert cs.verify(store)
    return store


def test_round_trip(spark):
    store = check(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    chunks = store.table("chunks")
    assert chunks.count() == chunks.select("chunk").distinct().count()
    named = {p["chunk"] for r in store.table("recipes").collect() for p in r["parts"]}
    assert named == {r["chunk"] for r in chunks.collect()}


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert cs.digests(cs.write_store(no_docs, BYTE_BPE)).count() == 0


def test_word_tokenizer():
    t = cs.WordTokenizer(Path(BYTE_BPE).read_text(encoding="utf-8"), remember=3)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a   b", "\n\n x", "x \n y", "  \n", "<|endoftext|> a", "x  \ty", "é☃  ☃", "it's don't. a1, 12. ...", " a   b", "a.\nb", "x" * 200 + " y"]
    for _ in range(2):
        assert [x.tobytes() for x in t(pa.array(texts))] == t.whole(texts)
    assert [x.size for x in t(pa.array([None, "a"]))] == [0, 1]


def test_cuts_move_little():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 60_000).astype(np.uint32)
    other = np.concatenate([ids[:700], [7, 7, 7], ids[700:]]).astype(np.uint32)
    pieces = lambda x: {x[a:b].tobytes() for a, b in zip([0, *cs.cuts(x)], cs.cuts(x))}
    a, b = pieces(ids), pieces(other)
    assert len(a) > 20 and len(a - b) <= 3
    for x in (ids, ids[:1], np.zeros(20_000, np.uint32)):
        ends = cs.cuts(x)
        assert ends[-1] == len(x) and all(0 < q - p <= cs.MOST for p, q in zip([0, *ends], ends))


def test_moved_crc():
    a, b = b"some bytes", b"and 12345 more"
    crc = cs.moved_crc(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert crc[0] ^ crc[1] == zlib.crc32(a + b)


def test_special_tokens(spark):
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b  c", "<|endof text|>", "plain words", "x <|endoftext|><|endoftext|> y"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert Tokenizer.from_file(BYTE_BPE).encode(texts[0], add_special_tokens=False).ids.count(50256) == 1


def failing(df):
    with pytest.raises(Exception, match="damaged|lacking|isn't whole|instead of"):
        df.collect()


def one_pack(store):
    (pack,) = glob.glob(store.path.removeprefix("file://") + "/packs/*.pack")
    return pack


def test_damage_is_an_error(spark, odd_docs):
    store = cs.write_store(odd_docs.where("doc_id = 7"), BYTE_BPE)
    pack, chunk = one_pack(store), store.table("chunks").first()
    data = bytearray(open(pack, "rb").read())
    wrong = bytes([2]) + zstandard.ZstdCompressor(level=1).compress(np.zeros(chunk["n"], "<u2").tobytes())
    assert len(wrong) <= chunk["size"]
    data[chunk["at"] : chunk["at"] + len(wrong)] = wrong
    open(pack, "wb").write(data)
    assert not cs.verify(store)
    failing(cs.digests(store))
    failing(cs.read_ids(store))


def test_a_lacking_chunk_is_an_error(spark, odd_docs):
    store = cs.write_store(odd_docs.where("doc_id in (1, 7, 8)"), BYTE_BPE)
    chunks = store.table("chunks")
    gone = chunks.orderBy("chunk").first()["chunk"]
    less = cs.Store(spark, shared_dir(spark))
    for name in ("recipes", "manifest"):
        store.table(name).write.parquet(f"{less.path}/{name}")
    chunks.where(F.col("chunk") != gone).write.parquet(f"{less.path}/chunks")
    shutil.copytree(store.path.removeprefix("file://") + "/packs", less.path.removeprefix("file://") + "/packs")
    failing(cs.digests(less))
    failing(cs.read_ids(less))


def test_another_manifest_is_an_error(spark, odd_docs):
    store = cs.write_store(odd_docs, BYTE_BPE)
    cs.check_manifest(store)
    other = cs.Store(spark, shared_dir(spark))
    store.table("recipes").write.parquet(f"{other.path}/recipes")
    store.table("manifest").withColumn("root", F.sha2("root", 256)).write.parquet(f"{other.path}/manifest")
    with pytest.raises(ValueError):
        cs.check_manifest(other)
    swapped = cs.Store(spark, shared_dir(spark))
    store.table("recipes").withColumn("parts", F.when(F.col("doc_id") == 1, F.slice("parts", 1, 0)).otherwise(F.col("parts"))).write.parquet(f"{swapped.path}/recipes")
    store.table("manifest").write.parquet(f"{swapped.path}/manifest")
    with pytest.raises(ValueError):
        cs.check_manifest(swapped)
