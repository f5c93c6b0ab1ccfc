import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import phrases


def plain_counts(texts, depth):
    out = Counter()
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, depth + 1):
                out.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return out


def plain_collocations(rows, least, top):
    out, by = [], defaultdict(list)
    for lang, t in rows:
        by[lang or "und"].append(t)
    for lang, texts in by.items():
        f = plain_counts(texts, 3)
        n = sum(v for k, v in f.items() if " " not in k)
        own = {p: a for p, a in f.items() if " " in p and a >= least}
        told = []
        for p, a in own.items():
            ws = p.split(" ")
            cuts = [(1000000 * a * a // (f[" ".join(ws[:k])] * f[" ".join(ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            longer = [b for q, b in own.items() if len(q) > len(p) and f" {p} " in f" {q} "]
            if not any(100 * b >= 50 * a for b in longer):
                told.append((-score, -a, p.encode(), p, a, f[" ".join(ws[:k])], f[" ".join(ws[k:])], n, score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(told)[:top], 1)]
    return sorted(out)


def random_texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "the", "Ünder", "x1", "ÉT", "-", "longer", "𝄞", "of"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ?! "]
    return [None if r.random() < 0.05 else "".join(r.choice(words) + r.choice(ends) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(n)]


@pytest.mark.parametrize(("depth", "most", "parts"), [(3, 10**6, 3), (3, 25, 5), (2, 7, 1), (1, 9, 2), (5, 40, 4)])
def test_blocks_like_plain_counts(depth, most, parts):
    texts = random_texts(depth)
    got, words = Counter(), 0
    for part in range(parts):
        found = [b for i, b in phrases.blocks(pa.array(texts, pa.string()), depth, parts, most) if i == part]
        if found:
            for r in phrases.merged(iter(found), 1).to_pylist():
                if r["words"]:
                    assert len(r["phrase"].split(" ")) == r["words"]
                    got[r["phrase"]] += r["n"]
                else:
                    words += r["n"]
    want = plain_counts(texts, depth)
    assert got == want
    assert words == sum(v for k, v in want.items() if " " not in k)


def test_extensions_on_either_side_agree():
    r = np.random.default_rng(3)
    s = np.concatenate([[0], r.integers(0, 5, 400), [0]]).astype(np.int32)
    index = phrases.Index(s, 4, 4)
    plain = Counter(tuple(int(x) for x in s[i : i + 4]) for i in range(len(s) - 3))
    plain = {k: v for k, v in plain.items() if 0 not in k}
    for sides in [(True, True, True), (False, False, False), (True, False, False), (False, True, False), (False, False, True)]:
        p = index.single()
        for side in sides:
            p = index.extended(p, side)
        assert dict(zip(zip(*[w.tolist() for w in p.words]), p.n.tolist())) == plain


def test_collocations_like_plain(spark):
    rows = [(lang, t) for i, lang in enumerate(["en", "de", None]) for t in random_texts(i, 90)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for least, top in ((10, 2000), (2, 7)):
        got = sorted(map(tuple, phrases.collocations(docs, least=least, top=top).collect()))
        assert got == plain_collocations(rows, least, top)


def test_odd_input(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(tuple, phrases.collocations(odd_docs, least=2).collect()))
    assert got == plain_collocations(rows, 2, 2000)
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.counts(odd_docs.selectExpr("lang", "cast(null as string) as text")).where("words > 0").count() == 0


def test_large_counts_are_exact(spark):
    a, b = 4_000_000_000, 9_000_000_001
    rows = [("en", 1, "x", b), ("en", 1, "y", b), ("en", 2, "x y", a)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).collect()
    assert [r["score"] for r in got] == [1000000 * a * a // (b * b)]
