import math
import random
import re
import unicodedata
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import langid, queries, samples
from corpusmill.llm import rule_ensemble as re_

FOLDER = "/root/testdata/sf0.01"


def plain_statistics(text):
    words, lines, chars = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], text.split("\n"), max(1, len(text))
    share = lambda x: x / len(words) if words else 0.0
    count = lambda test: sum(map(test, text)) / chars
    return {
        "n_words": float(len(words)), "word_length": share(sum(map(len, words))), "distinct_words": share(len(set(words))), "distinct_lines": len(set(lines)) / len(lines),
        "short_words": share(sum(len(w) <= 3 for w in words)), "long_words": share(sum(len(w) > 12 for w in words)), "n_lines": float(len(lines)),
        "upper": count(lambda c: unicodedata.category(c) == "Lu"), "digit": count(lambda c: c in "0123456789"), "symbol": count(lambda c: c in "#*$%&@^~=+_\\/<>{}[]"),
        "pipe": count(lambda c: c == "|"), "bang": count(lambda c: c in "!?"), "stop": count(lambda c: c in ".,;:"), "line": count(lambda c: c == "\n"),
    }


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{x}.parquet") for x in ("documents", "labels"))
    out = queries.op6_rule_ensemble(spark, FOLDER)
    rows = out.join(labels, "doc_id").collect()
    assert out.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    rules = re_.fit(docs, labels)
    assert 1 <= len(rules.rules) <= 80
    # The compiled expression against the rules one by one, over plain statistics.
    some = docs.limit(60).unionByName(odd_docs.select(*docs.columns))
    for r in some.select("text", re_.statistics(some["text"]).alias("s")).withColumn("score", rules.score(F.col("s"))).collect():
        stats = plain_statistics(r["text"] or "")
        assert r["s"].asDict().keys() == stats.keys() and all(math.isclose(r["s"][k], v, rel_tol=1e-12) for k, v in stats.items())
        total = rules.bias + sum(w for w, rule in rules.rules if all((r["s"][c] <= x) == low for c, low, x in rule))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    some = labels.limit(0)
    assert {r["score"] for r in re_.scored(odd_docs, some).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert re_.scored(odd_docs, one).where("predicted = 1").count() == odd_docs.count()
    assert re_.scored(no_docs, labels).count() == 0
    kept = re_.keep_good(odd_docs, one)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_keeping_is_scoring(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{x}.parquet") for x in ("documents", "labels"))
    kept = {r["doc_id"] for r in re_.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in re_.scored(docs, labels).where("predicted = 1").collect()}


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    assert set(model.families.names) == {"germanic", "romance"} and model.within["germanic"].names == ("de", "en")
    rows = langid.identified(docs, model).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    odd = {r["doc_id"]: r for r in langid.identified(odd_docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (4, 5, 6, 10)) and odd[9]["lang_pred"] != "und"
    assert langid.identified(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in langid.identified(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    one = docs.where("lang = 'en'").limit(20)
    assert {r["lang_pred"] for r in langid.identified(odd_docs.where("doc_id = 1"), langid.fit(one)).collect()} == {"en"}


def test_labels_that_disagree(spark, odd_docs):
    """The smallest label of an id counts; ids that don't count for learning don't here."""
    labels = spark.createDataFrame([(i, x) for i in (1, 2, 3) for x in (1, 0)] + [(None, 1)], "doc_id long, quality int")
    known = {d["doc_id"] for d in odd_docs.collect()} & {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    n = len(known)
    assert {round(r["score"], 9) for r in re_.scored(odd_docs, labels).collect()} == {round(1 / (n + 2), 9)}


def test_samples_are_exact(spark):
    """The rows with the smallest hashes of each class, also where copies of a row abound."""
    rng = random.Random(2)
    rows = [("a", rng.getrandbits(64) - (1 << 63)) for _ in range(500)] + [("b", 5)] * 80 + [("c", -7), (None, 3)]
    df = spark.createDataFrame(rows, "kind string, key long")
    got = samples.smallest(df, "kind", "key", 40).collect()
    for kind in "abc":
        want = sorted(k for c, k in rows if c == kind)[:40]
        assert sorted(r["key"] for r in got if r["kind"] == kind) == want
    assert samples.smallest(df, "kind", "key", {"a": 7, "b": 2}).groupBy("kind").count().collect() and len(samples.smallest(df, "kind", "key", {"a": 7, "b": 2}).collect()) == 9


def test_bounded_learning(spark):
    """A class or language that is all copies of one text is learnt, within its bound."""
    rows = [(i, "the same words again and again " * 3, "en") for i in range(300)] + [(1000 + i, f"andere Wörter stehen hier {i} für das Lernen", "de") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.vectors(docs, "doc_id", "text", "lang", 10)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 10, "de": 10}
    labels = spark.createDataFrame([(r[0], int(r[2] == "de")) for r in rows], "doc_id long, quality int")
    counts, chosen = re_.sample(docs, labels, "doc_id", "text", "quality", "doc_id", 20, 7)
    assert chosen.count() <= 21 and {r["label"] for r in chosen.select("label").collect()} == {0.0, 1.0}
    out = re_.scored(docs, labels, max_rows=20).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95


def test_machine_against_a_plain_solver():
    """The same minimum as by many small steps."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)).astype(np.float32) / 3
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.1 * rng.normal(size=60) > 0.1, 1, -1)
    z = np.hstack([x, np.ones((60, 1))])
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    for ridge, rounds in ((1e-2, 150), (1e-4, 2000)):  # a small ridge takes more rounds
        loss = lambda w: 0.5 * ridge * w @ w + (each * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()  # noqa: B023, E731
        w = np.zeros(7)
        for _ in range(30_000):
            w -= 0.1 * (ridge * w - 2 * z.T @ (each * y * np.maximum(0, 1 - y * (z @ w))))
        assert loss(langid.machine(x, y, rounds, ridge)) <= loss(w) * 1.001


def test_duels_against_plain():
    rng = np.random.default_rng(4)
    names = ("a", "b", "c", "d")
    weights = {p: rng.normal(size=langid.DIMS + 1) for p in combinations(names, 2)}
    duels, x = langid.Duels.of(names, weights), rng.normal(size=(200, langid.DIMS)) / 20
    best, sure = duels.judge(x)
    for row, i, s in zip(x, best, sure):
        margin = {(a, b): row @ w[:-1] + w[-1] for (a, b), w in weights.items()}
        for a, b in list(margin):
            margin[b, a] = -margin[a, b]
        won = {n: sum(margin[n, m] > 0 for m in names if m != n) for n in names}
        sums = {n: sum(margin[n, m] for m in names if m != n) for n in names}
        want = max(names, key=lambda n: (won[n], sums[n]))
        assert names[i] == want and math.isclose(s, 1 / (1 + math.exp(-3 * min(margin[want, m] for m in names if m != want))), rel_tol=1e-6)
