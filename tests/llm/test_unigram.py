import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import unigram as u
from corpusmill.llm.tokenizer_files import PIECES


@pytest.fixture(scope="module")
def model():
    return u.load(PIECES)


@pytest.fixture(scope="module")
def enc(model):
    return u.Encoder(model, remember=50)


def total(model, ids):
    byte = set(model.byte_ids)
    return sum(model.scores[i] for i in ids if i not in byte)


def test_against_the_library(model, enc):
    """The library's own unigram segmentation of the same pieces and scores has the
    same score, that is the same ids but for ties."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = float(model.scores[i])
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["Hello world", "  two  spaces ", "the quick brown fox", "zażółć gęślą jaźń", "snow ☃ 𝄞 man", "a\nb\tc", "internationalisation", "x" * 40, "Größenverhältnis", "für   und"]
    for t in texts:
        a, b = lib.encode(t), enc.encode(t).tolist()
        assert a == b or math.isclose(total(model, a), total(model, b), rel_tol=1e-5)
        assert lib.decode(a) == enc.decode(np.array(b))


def test_brute_force(model, enc):
    """Best of all segmentations of short words."""
    pieces = {s: i for i, s in enumerate(model.spelling) if s and i not in set(model.byte_ids)}

    def best(s):
        if not s:
            return 0.0
        out = [model.scores[pieces[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces]
        return max(out)

    for w in (" there", " nation", " Zeit", " ananas"):
        assert math.isclose(total(model, enc.encode(w[1:])), best(w.encode()))


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="▁")))
def test_round_trip(text):
    enc = test_round_trip.__dict__.setdefault("enc", None) or u.Encoder(u.load(PIECES))
    test_round_trip.enc = enc
    assert enc.decode(enc.encode(text)) == text


def test_trie(model):
    keys = {s: i for i, s in enumerate(model.spelling) if s and i not in set(model.byte_ids)}
    base, check = model.base.tolist(), model.check.tolist()
    for s, i in list(keys.items())[::97]:
        state = 0
        for c in s:
            to = base[state] + c + 1
            assert check[to] == state
            state = to
        leaf = base[state]
        assert check[leaf] == state and -base[leaf] - 1 == i


def test_rows(odd_docs, no_docs):
    out = u.encoded(odd_docs, PIECES)
    assert out.columns == [*odd_docs.columns, "piece_ids"]
    enc = u.Encoder(u.load(PIECES))
    for r in out.collect():
        assert r["piece_ids"] == enc.encode(r["text"] or "").tolist()
    assert all(r["round_trip"] for r in u.checked(odd_docs, PIECES).collect())
    assert u.encoded(no_docs, PIECES).count() == 0 and u.checked(no_docs, PIECES).count() == 0
    assert enc.decode(enc.encode("a▁b")) == "a b"


def plain_ids(model, text):
    """Unit by unit, the best of all segmentations by a table over places; the first found on ties."""
    pieces = {s: i for i, s in enumerate(model.spelling) if s and i not in set(model.byte_ids)}
    longest, lowest = max(map(len, pieces)), model.unknown_score
    out = []
    for unit in re.findall(" +[^ ]*", " " + text.replace("\u2581", " ")) if text else []:
        b, best = unit.encode(), {0: (0.0, 0, None)}
        for at in range(len(b)):
            if at not in best or b[at] & 0xC0 == 0x80:
                continue
            width = len(b[at:].decode()[0].encode())
            steps = [(n, pieces[b[at : at + n]]) for n in range(1, longest + 1) if b[at : at + n] in pieces and at + n <= len(b)]
            if width not in [n for n, _ in steps]:
                steps.append((width, -1))
            for n, piece in steps:
                score = best[at][0] + (lowest if piece < 0 else model.scores[piece])
                if at + n not in best or score > best[at + n][0]:
                    best[at + n] = (score, at, piece)
        ids, end = [], len(b)
        while end:
            _, at, piece = best[end]
            ids = ([piece] if piece >= 0 else [model.byte_ids[c] for c in b[at:end]]) + ids
            end = at
        out += ids
    return out


def test_the_query(spark, model, odd_docs, no_docs):
    from corpusmill.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    byte = set(model.byte_ids)

    def want(d):
        ids = plain_ids(model, d["text"] or "")
        return (d["doc_id"], len(ids), sum(i in byte for i in ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)

    got = queries.op5_unigram(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"]
    assert sorted(map(tuple, got.collect())) == sorted(map(want, docs.collect()))
    odd = u.checked(odd_docs, PIECES)
    assert sorted(map(str, map(tuple, odd.collect()))) == sorted(map(str, map(want, odd_docs.collect())))
    assert u.checked(no_docs, PIECES).count() == 0 and u.encoded(no_docs, PIECES).count() == 0


def test_windows(model, monkeypatch):
    """Units longer than a window have the same ids as without windows."""
    rng = random.Random(6)
    enc = u.Encoder(model)
    texts = ["".join(rng.choice(["a", "the", "ing", "\u2603", "ß", "x", "tion", "\U0001d11e"]) for _ in range(n)).encode() for n in (5, 60, 300, 900)] + [b" " + b"a" * 700, b"=" * 500]
    want = [enc.segment(t) for t in texts]
    for window in (8, 33, 128):
        monkeypatch.setattr(u, "WINDOW", window)
        assert [enc.segment(t) for t in texts] == want
