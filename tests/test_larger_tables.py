"""What only tables larger than the given ones show."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T


def test_years_of_five_digits(spark):
    seconds = [0, 253402300799, 253402300800, 6_000_000 * 86399]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in seconds], "s long").select(T.utc(F.col("s"))).collect()]
    assert got == ["1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "18397-04-02T13:20:00Z"]


def test_named_files_that_share_a_path(spark):
    from corpusmill.sources import tree

    files = spark.createDataFrame([(1, "a.rs"), (2, "a.rs"), (3, "b.md")], "page_id long, path string")
    wanted = files.where("page_id <> 2")
    assert [tuple(r) for r in tree.explicit(files, wanted, keys=("page_id", "path")).collect()] == [(1, "a.rs")]
    assert tree.explicit(files, wanted).count() == 2


def test_a_snippet_as_a_whole(spark):
    from corpusmill.operators import selftests

    rules = spark.createDataFrame([("pipes", r" \| [^|]{1,40} \| ", None)], "rule_id string, pattern string, unless string")
    cases = spark.createDataFrame([("pipes", "a | b\nc | d", True)], "rule_id string, snippet string, should_match boolean")
    assert [selftests.summary(rules, cases, by_line=x).first()["status"] for x in (True, False)] == ["fail", "pass"]
