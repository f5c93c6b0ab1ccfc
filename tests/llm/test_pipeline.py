import random

import corpus_pipeline as p
from corpusmill.llm import line_frequency, rule_ensemble, unigram
from corpusmill.llm.tokenizer_files import PIECES
from tests.llm.test_line_frequency import COLUMNS, plain
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_mixing import plain as plain_mixture
from tests.llm.test_simhash import plain_classes, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"
CLASHING = ["__v", "__m", "__d", "__keep", "piece_ids", "verdict", "changed", "leaf", "plan", "equal", "row", "label", "lines", "hashes", "near", "root", "x"]


def plain_kept(rows):
    """The smallest id of each component that 3 bits and a similarity of 0.8 make together."""
    rows = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {r["doc_id"]: i for i, r in enumerate(rows)}
    by_bits = [at[c] for _, _, c in plain_classes([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows])]
    for i, links in enumerate(zip(plain_groups(rows), by_bits)):
        for j in links:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({rows[find(i)]["doc_id"] for i in range(len(rows))})


def test_near_duplicates(spark, odd_docs, no_docs):
    """One-word edits in texts short and long, which 3 bits often miss, copies and odd rows."""
    rng, rows = random.Random(8), []
    for n in (60, 60, 90, 200, 400):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(4):
            rows.append((len(rows), " ".join(words), "en", "s", 0))
            words[rng.randrange(n)] = f"x{rng.randrange(5000)}"
    rows += [(50, rows[0][1], "en", "s", 0), (50, "other words under the same id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_duplicates(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 4, 8, 12, 16, 50]
    out = p.near_duplicates(spark, odd_docs, FOLDER)
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == plain_kept(odd_docs.collect())
    assert out.where("doc_id is null").count() == 1 and p.near_duplicates(spark, no_docs, FOLDER).count() == 0


def test_clashing_names(spark, odd_docs):
    """Every stage with extra columns of any name, names that the stages use among them."""
    named = odd_docs.selectExpr("*", *[f"'{i}' as `{c}`" for i, c in enumerate(CLASHING)])
    want = named.columns
    for name, stage in p.STAGES:
        out = stage(spark, named, FOLDER)
        if name == "pieces":
            assert out.columns[:-1] == want and out.columns[-1] == "piece_ids_"
        else:
            assert out.columns == want, name
        assert all(r[c] == str(i) for r in out.collect() for i, c in enumerate(CLASHING)), name


def test_stage_by_stage(spark):
    """Each stage's rows against a plain version over the stage's own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mixture", "pieces"]
    columns, ids = docs.columns, lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    one = p.quality_rules(spark, docs, FOLDER).checkpoint()
    at, rows = COLUMNS.index("kept"), docs.collect()
    near = {r["text"]: g for r, g in zip(rows, plain_groups(rows))}
    want = [eval(r)[0] for r in plain(rows, line_frequency.Limits(), lambda d: near[d["text"]]) if eval(r)[at]]
    assert one.columns == columns and ids(one) == sorted(want)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    two = p.quality_classifier(spark, one, FOLDER).checkpoint()
    assert two.columns == columns and ids(two) == ids(rule_ensemble.scored(one, labels).where("predicted = 1"))

    three = p.near_duplicates(spark, two, FOLDER).checkpoint()
    assert three.columns == columns and ids(three) == plain_kept(two.collect())

    four = p.mixture(spark, three, FOLDER).checkpoint()
    assert four.columns == columns and ids(four) == sorted(eval(x)[0] for x in plain_mixture(three.collect(), 0.9, 1, {}))

    five = p.pieces(spark, four, FOLDER)
    enc = unigram.Encoder(unigram.load(PIECES))
    assert five.count() == four.count() and all(r["piece_ids"] == enc.encode(r["text"]).tolist() for r in five.collect())

    assert sorted(map(str, p.run(spark, FOLDER).select("doc_id", "piece_ids").collect())) == sorted(map(str, five.select("doc_id", "piece_ids").collect()))
