import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import line_frequency as lf
from corpusmill.llm import near_copies as nc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_groups(rows):
    """Each row's smallest row reachable, by union of all pairs at 0.8 or more."""

    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def compare(docs):
    rows = sorted(docs.where("doc_id is not null").collect(), key=lambda r: r["doc_id"])
    want = sorted({rows[i]["doc_id"] for i in plain_groups(rows)})
    named = docs.where("doc_id is not null").select("doc_id", nc.text_key(docs["text"]).alias("text_key")).join(nc.groups(docs), "text_key")
    got = named.groupBy("near").agg(F.min("doc_id").alias("low")).select("low").distinct()
    assert sorted(r["low"] for r in got.collect()) == want


def texts(rng, n_lines=12):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(n_lines)]


def test_against_all_pairs(spark, odd_docs, no_docs):
    compare(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    compare(odd_docs)
    assert nc.groups(no_docs).count() == 0


def test_edits_and_chains(spark):
    """One-word edits, which 3 bits often miss, and chains of them."""
    rng, rows = random.Random(3), []
    for _ in range(25):
        words = " ".join(texts(rng, 8)).split()
        for step in range(6):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            for at in rng.sample(range(len(words)), rng.choice((1, 2))):
                words[at] = f"x{rng.randrange(5000)}"
    compare(spark.createDataFrame(rows, SCHEMA))


def test_group_above_the_line_limit(spark):
    """Near copies of one text, more than the limit of lines: the stage keeps them,
    and still takes boilerplate out of documents that differ."""
    rng = random.Random(4)
    rows = [(i, "\n".join(["Share this page with friends", *texts(rng)]), "en", "s", 0) for i in range(60)]
    one = texts(rng)
    for i in range(60, 100):
        lines = list(one)
        k = rng.randrange(len(lines))
        lines[k] = " ".join([f"y{i}", *lines[k].split()[1:]])
        rows.append((i, "\n".join(lines), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, FOLDER).collect()}
    assert set(got) == set(range(100))
    assert not any("Share" in got[i] for i in range(60)) and all(got[r[0]] == r[1] for r in rows[60:])
    assert {r["doc_id"] for r in lf.clean_documents(docs).select("doc_id").collect()} == set(range(60))


def test_a_sketch_is_small_and_says_the_same(spark):
    """Keys and a byte of each min-hash go with a text, not the min-hashes: 288 bytes instead of 768."""
    rng = random.Random(9)
    words = " ".join(texts(rng, 10)).split()
    rows = [(0, " ".join(words), "en", "s", 0), (1, " ".join([*words[:-1], "z"]).upper(), "en", "s", 0), (2, None, "en", "s", 0), (3, " ".join(texts(rng, 10)), "en", "s", 0)]
    got = nc.sketches(spark.createDataFrame(rows, SCHEMA))
    assert dict(got.dtypes) == {"text_key": "binary", "node": "bigint", "n": "int", "bands": "array<bigint>", "marks": "array<tinyint>"}
    a, b, none, other = (set(r["bands"]) for r in got.collect())
    assert {(len(r["bands"]), len(r["marks"])) for r in got.collect()} == {(nc.BANDS, nc.POINTS)} and len(none) == nc.BANDS
    assert len(a & b) > 12 and not a & other and not a & none


def test_edited_copies_meet_their_centre(spark, monkeypatch):
    """A group of edited copies: the text they come from links them, so few pairs of
    them are left to the join on rare shingles, whose number grows with the square of the group."""
    rng, made, across = random.Random(12), [], nc.across
    words, rows = " ".join(texts(rng, 12)).split(), []
    for i in range(160):
        own = list(words)
        for at in rng.sample(range(len(own)), i and rng.choice((1, 2, 3, 4))):
            own[at] = f"z{rng.randrange(100_000)}"
        rows.append((i, " ".join(own), "en", "s", 0))

    def tapped(sets):
        made.append(across(sets))
        return made[-1]

    monkeypatch.setattr(nc, "across", tapped)
    docs = spark.createDataFrame(rows, SCHEMA)
    with nc.scratch(spark):
        found = nc.roots(nc.written(nc.sketches(docs).dropDuplicates(["text_key"])), docs)
        sizes = [r["count"] for r in found.groupBy("root").count().collect()]
        assert max(sizes) > 100
        assert made[0].count() < 160
    compare(docs)


def test_centres_are_those_that_share_most(spark):
    rows = [(1, n, 4) for n in (5, 6, 7, 8)] + [(2, n, 3) for n in (6, 7, 8)] + [(3, n, 2) for n in (7, 9)]
    got = nc.centres(spark.createDataFrame(rows, "band long, node long, size long")).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 9)]
