import random
import re

import xxhash

from corpusmill.llm import components, simhash

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """Smallest id reachable, by union of all pairs."""
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(doc, fp, low.get(find(i))) for i, (doc, fp) in enumerate(rows)]


def compare(docs):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_classes(rows)))


def test_against_all_pairs(spark, odd_docs, no_docs):
    compare(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    compare(odd_docs)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_no_link_is_lost(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for x in list(fps):
        for n in (1, 2, 3, 4):
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(df).collect()} == want
    home, near = simhash.anchors(df)
    assert home.count() == 2 * len(fps) and near.groupBy("half", "fp").count().where("count not in (1, 16)").count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (101, 200)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 100}


def test_deduplicated(spark, odd_docs, no_docs):
    out = simhash.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in comp.items() if i == c and i is not None})
    assert ids.count(None) == 1
    assert simhash.deduplicated(no_docs).count() == 0
