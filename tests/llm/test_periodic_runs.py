import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusmill.llm import periodic_runs, queries
from tests.compare import spark_rows


def plain_runs(w, min_length=24, min_exponent=3):
    """All maximal stretches of all periods, kept if the period is the smallest."""
    out = []
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            end = j + p
            if end - i >= max(min_length, min_exponent * p) and not any(all(w[k] == w[k + q] for k in range(i, end - q)) for q in range(1, p)):
                out.append((i, end - i, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-1000000007 * r[1] // r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
        "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    }


def words_with_runs(r):
    w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.choice([0, 1, 5, 60]))]
    for _ in range(r.randrange(3)):
        unit = [r.randrange(4) for _ in range(r.randrange(1, 20))]
        at = r.randrange(len(w) + 1)
        w[at:at] = (unit * 40)[: r.randrange(90)]
    return w


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 2), (10, 4), (1, 2)])
def test_runs_like_plain(min_length, min_exponent):
    r, n = random.Random(min_length), 0
    for _ in range(400):
        w = words_with_runs(r)
        want = plain_runs(w, min_length, min_exponent)
        n += len(want)
        assert list(map(tuple, periodic_runs.runs(np.array(w, np.int64), min_length, min_exponent).tolist())) == want
    assert n > 100


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(100):
        x = [r.randrange(3) for _ in range(r.randrange(2, 60))]
        order, inverse, levels = periodic_runs.suffix_array(np.array(x, np.int64))
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        assert [inverse[i] for i in order] == list(range(len(x)))
        common = [0] + [next((k for k in range(len(x)) if max(i, j) + k >= len(x) or x[i + k] != x[j + k]), 0) for i, j in zip(order[1:].tolist(), order[:-1].tolist())]
        assert periodic_runs.common_prefixes(order, levels).tolist() == common


def test_query_like_plain(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in words_with_runs(r)) if i % 7 else None) for i in range(400)]
    rows += [(1000 + i, r.choice(["\t", " \n"]).join(f"ü{r.randrange(300)}" for _ in range(r.randrange(1, 400)))) for i in range(200)]
    rows += [(3, "same id, other text"), rows[8], (None, "a b " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(plain_row(1, ""))
    want = [plain_row(*x) for x in rows]
    assert sum(x["n_runs"] for x in want) > 50
    assert spark_rows(got) == sorted(tuple("null" if x[c] is None else str(x[c]) for c in sorted(x)) for x in want)


def test_many_repetitions_are_one_run():
    x = np.array([7] * 50_000 + [1, 2, 3] * 20_000, np.int64)
    assert periodic_runs.runs(x).tolist() == [[0, 50_000, 1], [50_000, 60_000, 3]]


def test_odd_input(spark, odd_docs, no_docs):
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs.periodic_runs(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = tuple(plain_runs(w)) if len(w) < 2000 else ()
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        want.add((r["doc_id"], len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert {x for x in got if x[1] < 2000} == {x for x in want if x[1] < 2000}
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert periodic_runs.periodic_runs(odd_docs).count() == odd_docs.count()
    assert periodic_runs.periodic_runs(no_docs).count() == 0
