from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmill.llm import rollups
from corpusmill.shared import shared_dir

ROW = "source string, lang string, tokenizer string, n_tokens long"


def totals(r):
    return {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}


def test_batches(spark):
    a = spark.createDataFrame([("s", "en", "v1", 5), ("s", "en", "v1", 7), (None, None, None, None)], ROW)
    b = spark.createDataFrame([("s", "en", "v1", 7)], ROW)
    c = spark.createDataFrame([("s", "en", "v1", 9)], ROW)
    r = rollups.Rollup(spark, shared_dir(spark))
    assert r.totals().count() == 0
    assert r.commit("1", rollups.inserts(a)) and not r.commit("1", rollups.inserts(a))
    assert totals(r) == {("s", "en", "v1"): (2, 12), (None, None, None): (1, 0)}
    assert r.commit("2", rollups.revisions(b, c))
    assert totals(r)["s", "en", "v1"] == (2, 14)
    assert r.commit("3", rollups.deletes(c)) and r.commit("4", rollups.inserts(a.limit(0)))
    again = rollups.Rollup(spark, r.path)
    assert again.batches() == ["1", "2", "3", "4"] and totals(again)["s", "en", "v1"] == (1, 5)
    assert not again.commit("2", rollups.revisions(b, c))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.integers(0, 9), st.sampled_from((1, -1))), min_size=1, max_size=12))
def test_any_order(spark, rows):
    want_docs, want_tokens = Counter(), Counter()
    for _, s, n, sign in rows:
        want_docs[s] += sign
        want_tokens[s] += sign * n
    r = rollups.Rollup(spark, shared_dir(spark))
    for batch in sorted({x[0] for x in rows}, reverse=True):
        part = spark.createDataFrame([(s, "x", "v", n, sign) for b, s, n, sign in rows if b == batch], ROW + ", sign long")
        r.commit(str(batch), part)
        r.commit(str(batch), part)
    assert {k[0]: v for k, v in totals(r).items()} == {s: (want_docs[s], want_tokens[s]) for s in want_docs if want_docs[s] or want_tokens[s]}


def test_broken_commit_leaves_nothing(spark):
    from pyspark.sql import functions as F

    a = spark.createDataFrame([("s", "en", "v1", 5)], ROW)
    r = rollups.Rollup(spark, shared_dir(spark))
    try:
        r.commit("1", rollups.inserts(a).withColumn("n_tokens", F.raise_error(F.lit("stop")).cast("long")))
    except Exception:
        pass
    assert r.batches() == [] and r.commit("1", rollups.inserts(a)) and totals(r) == {("s", "en", "v1"): (1, 5)}


def test_compaction(spark):
    a = spark.createDataFrame([("s", "en", "v1", 5), ("t", "en", "v1", 2)], ROW)
    r = rollups.Rollup(spark, shared_dir(spark))
    assert r.compact() and totals(r) == {}
    assert r.commit("1", rollups.inserts(a)) and r.commit("2", rollups.inserts(a)) and r.compact()
    assert totals(r) == {("s", "en", "v1"): (2, 10), ("t", "en", "v1"): (2, 4)}
    assert not r.commit("1", rollups.inserts(a)) and r.commit("3", rollups.deletes(a))
    assert totals(r) == {("s", "en", "v1"): (1, 5), ("t", "en", "v1"): (1, 2)} and len(r._parts()[1]) == 2
    assert r.compact() and len(r._parts()[1]) == 1 and r.batches() == ["1", "2", "3"]
    assert totals(rollups.Rollup(spark, r.path)) == {("s", "en", "v1"): (1, 5), ("t", "en", "v1"): (1, 2)}


def test_competing_commits(spark):
    """The marker that is there first counts; an empty one counts for nothing."""
    a = spark.createDataFrame([("s", "en", "v1", 5)], ROW)
    r = rollups.Rollup(spark, shared_dir(spark))
    assert r._put("commits/id=x", "one") and not r._put("commits/id=x", "two") and r._said("commits/id=x") == "one"
    r._fs.create(r._path(f"{r.path}/commits/id=y"), False).close()
    assert "y" not in r.batches() and r.commit("y", rollups.inserts(a)) and not r.commit("y", rollups.inserts(a))


def test_clashing_names(spark):
    a = spark.createDataFrame([("s", "en", "v1", 5)], ROW).selectExpr("*", "1 as sign", "2 as n_docs", "3 as attempt")
    r = rollups.Rollup(spark, shared_dir(spark))
    assert r.commit("1", rollups.inserts(a)) and totals(r) == {("s", "en", "v1"): (1, 5)}
