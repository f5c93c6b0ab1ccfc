import pytest

from corpusmill.plans import corpus_queries as q
from tests.compare import connect, rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_like_sql(spark, con, name):
    df = q.QUERIES[name](spark, FOLDER)
    want = con.execute(q.ORACLES[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    assert spark_rows(df) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plain_clusters(places, reach, most, most_lines):
    out, start, end, n = [], 0, 0, 0
    for line in sorted(places):
        lo, hi = max(1, line - reach), line + reach
        if n and lo <= end and n < most and hi - start + 1 <= most_lines:
            end, n = max(end, hi), n + 1
        else:
            out += [(start, end, n)] if n else []
            start, end, n = lo, hi, 1
    return out + [(start, end, n)]


def test_capped_clusters(spark):
    found = q._found(spark, FOLDER).select("path", "line").toPandas()
    want = sorted((p, *c) for p, g in found.groupby("path") for c in plain_clusters(g["line"].tolist(), 2, 8, 20))
    assert sorted(map(tuple, q.cluster_capped(spark, FOLDER).collect())) == want
