import re
from collections import Counter, defaultdict

from corpusmill.llm import line_frequency as lf
from tests.compare import connect, rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
SMALL = lf.Limits(min_docs=1, max_share=0.1, min_words=5)


def plain(docs, limits, unit=lambda d: ("i", d["doc_id"]) if d["doc_id"] is not None else ("t", d["text"])):
    """``unit`` says what counts as one document."""
    split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
    host_texts, line_texts = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(split(x)).lower()
    for d in docs:
        host_texts[d["source"]].add(unit(d))
        for x in (d["text"] or "").split("\n"):
            if split(x):
                line_texts[d["source"], norm(x)].add(unit(d))
    over = {k for k, v in line_texts.items() if len(v) > limits.min_docs and len(v) > limits.max_share * len(host_texts[k[0]])}
    out = []
    for d in docs:
        words = split(d["text"] or "")
        ls = [x for x in (d["text"] or "").split("\n") if split(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        gone = [x for x in ls if (d["source"], norm(x)) in over]
        gone_words = sum(len(split(x)) for x in gone)
        failed = len(words) < limits.min_words or 100 * len(covered) > 50 * len(words)
        kept = not failed and gone_words <= 0.5 * len(words) and len(words) - gone_words >= limits.min_words
        out.append((d["doc_id"], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in d["text"] or ""), len(ls) - len(set(ls)), len(covered), failed, kept, len(gone), gone_words))
    return sorted(map(str, out))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words"]


def test_against_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = lf.line_quality(docs, SMALL).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(docs.collect(), SMALL)


def test_odd_rows(odd_docs, no_docs):
    got = lf.line_quality(odd_docs, SMALL).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(odd_docs.collect(), SMALL)
    assert lf.line_quality(no_docs).count() == 0


def test_what_counts_as_a_document(spark, odd_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for rows_ in (docs, odd_docs):
        got = lf.line_quality(rows_, SMALL, count="texts").select(*COLUMNS).collect()
        assert sorted(str(tuple(r)) for r in got) == plain(rows_.collect(), SMALL, lambda d: d["text"])
    # Thirty copies of one text are thirty documents by id, and one by text or as near copies.
    copies = spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(80)), "s") for i in range(30)], "doc_id long, text string, source string")
    kept = {c: lf.line_quality(copies, count=c).where("kept").count() for c in ("documents", "texts", "near_copies")}
    assert kept == {"documents": 0, "texts": 30, "near_copies": 30}


def test_clean_documents(spark, odd_docs, no_docs):
    lines = [f"own words number {i} stand here alone for one page" for i in range(40)]
    rows_ = [(i, f"Share this page\n{lines[i]} and some more words to keep\n\nshare  THIS page", "en", "s", 0) for i in range(40)]
    rows_.append((99, "Share this page\nshare this page\nx y", "en", "s", 0))
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in lf.clean_documents(docs, lf.Limits(min_docs=10, min_words=5)).collect()}
    assert set(got) == set(range(40))
    assert got[3]["text"] == f"{lines[3]} and some more words to keep\n" and got[3]["n_chars"] == len(got[3]["text"])
    out = lf.clean_documents(odd_docs, SMALL)
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    kept = [r["doc_id"] for r in lf.line_quality(odd_docs, SMALL).where("kept").collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in out.collect())
    assert lf.clean_documents(no_docs).count() == 0
    named = odd_docs.drop("n_chars").selectExpr("*", "1 as __v", "2 as VERDICT", "3 as hashes", "4 as kept", "5 as `odd.name`")
    more = lf.clean_documents(named, SMALL)
    assert more.columns == named.columns and sorted(str(r["doc_id"]) for r in more.collect()) == sorted(map(str, kept))


def test_oracle(spark):
    from corpusmill.llm import queries as q

    con = connect(FOLDER)
    for name in q.ORACLES:
        assert spark_rows(q.QUERIES[name](spark, FOLDER)) == rows(con.execute(q.ORACLES[name]).df()), name
