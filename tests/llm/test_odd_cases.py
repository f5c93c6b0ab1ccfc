"""Small weights, names with dots, long chains."""

import pytest

from corpusmill.llm import mixing, unigram
from corpusmill.llm.components import connected
from corpusmill.llm.near_copies import alike, marked
from corpusmill.llm.tokenizer_files import PIECES


def test_weights_too_small_are_refused(spark, odd_docs):
    for weight in (1e-7, -1.0):
        with pytest.raises(ValueError, match="weight"):
            mixing.mixture(odd_docs, budget=0.5, max_epochs=1, weights={"lang": {"en": weight}})
    assert mixing.mixture(odd_docs, budget=0.5, max_epochs=1, weights={"lang": {"en": 1e-6, "de": 0}}).count() > 0


def test_pieces_keep_names_with_dots(spark, odd_docs):
    named = odd_docs.selectExpr("*", "1 as `a.b`", "2 as `c``d`", "'p' as piece_ids")
    out = unigram.encoded(named, PIECES)
    assert out.columns == [*named.columns, "piece_ids_"]
    assert sorted(map(str, out.select(*[f"`{c.replace('`', '``')}`" for c in named.columns]).collect())) == sorted(map(str, named.collect()))


def test_a_long_chain_is_one_component(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(10_000, 10_001)], "a long, b long"))
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 10_000: 10_000, 10_001: 10_000}


def test_marks_lose_no_pair(spark):
    same = list(range(-5, 31))
    rows = [(1, 40, same), (2, 41, same[:17] + [x + 1000 for x in same[17:]]), (3, 40, [x + 5000 for x in same]), (4, 90, same)]
    nodes = spark.createDataFrame(rows, "node long, n int, hashes array<bigint>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert [tuple(r) for r in alike(pairs, marked(nodes)).collect()] == [(1, 2)]
