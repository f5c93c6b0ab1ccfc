from pyspark.sql import functions as F

from corpusmill.operators import review
from corpusmill.sources import tree


def plain_cut(text, most):
    data = text.encode()
    if len(data) <= most:
        return text
    part = data[:most].decode("utf-8", "ignore")
    return part.rpartition("\n")[0] if "\n" in part else part


def test_cut_like_plain(spark):
    texts = ["", "abc", "é☃𝄞" * 5, "a\nbé\nc☃𝄞d\n", "\n\n", "x" * 30, "☃\n" * 9]
    for most in (0, 1, 2, 3, 5, 7, 12, 64):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(review.cut_at_line(F.col("t"), most)).collect()
        assert [r[0] for r in got] == [plain_cut(t, most) for t in texts], most


def test_state_is_escaped_before_it_is_cut(spark):
    df = spark.createDataFrame([("1: <b>\n2: x",), ("1: ok",)], "region string")
    assert [(r["state"], r["truncated"]) for r in review.states(df, 12).collect()] == [("<code>\n1: &lt;b&gt;\n</code>", True), ("<code>\n1: ok\n</code>", False)]


def test_gate(spark):
    found, known = spark.createDataFrame([("a",), ("b",), ("a",)], "rule_id string"), spark.createDataFrame([("a",), ("a",)], "rule_id string")
    assert review.gated(found, known).count() == 2 and review.gated(found, known, allow_external=True).count() == 3


def test_paths_below_roots(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b/c.rs", "a/bc/d.rs", "a/b.rs", "e.rs", "a/b")], "path string")
    below = lambda *roots: sorted(r[0] for r in tree.under(paths, spark.createDataFrame([(x,) for x in roots], "path string")).collect())
    assert below("a/b/") == ["a/b", "a/b/c.rs"] and below("e.rs", "a/bc") == ["a/bc/d.rs", "e.rs"] and len(below("")) == 5 and below("x") == []
    named = spark.createDataFrame([("a/b.rs",), ("a/b.rs",), ("a/b",), ("none.rs",), ("e.rs",)], "path string")
    assert sorted(r[0] for r in tree.explicit(paths, named, ["e.*"]).collect()) == ["a/b.rs"]
