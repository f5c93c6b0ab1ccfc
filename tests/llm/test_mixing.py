import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmill.llm import mixing


def plain_fill(children, total):
    """children: {name: (capacity, weight)}; shortages go to siblings round by round,
    in fractions; those that aren't full get the differences of rounded sums."""
    budget, open_ = {}, {k: v for k, v in children.items() if v[1] > 0}
    left = total
    while open_:
        w = sum(Fraction(x[1]) for x in open_.values())
        full = [k for k, (c, x) in open_.items() if c * w <= left * Fraction(x)]
        if not full:
            done = Fraction(0)
            for k, (c, x) in sorted(open_.items(), key=lambda i: (i[1][0] / i[1][1], i[0])):
                after = done + Fraction(x)
                budget[k] = int(left * after / w) - int(left * done / w)
                done = after
            break
        for k in full:
            budget[k] = open_.pop(k)[0]
            left -= budget[k]
    return budget


def leaf_rows(docs):
    leaves = defaultdict(list)
    for d in docs:
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", d["text"] or "") if w])
        if n:
            s = "(none)" if d["source"] is None else d["source"]
            dom = f"domain{int(s[-1]) % 4}" if s[-1:].isdigit() else "other"
            leaves[dom, d["lang"] or "(none)", s].append((d["doc_id"], d["text"], n))
    return leaves


def plain(docs, budget, max_epochs, weights, seed=42):
    leaves = leaf_rows(docs)
    tokens = {k: sum(x[2] for x in v) for k, v in leaves.items()}
    w = lambda level, k: weights.get(level, {}).get(k, 1.0)
    have = sum(tokens.values())
    live = {k: t for k, t in tokens.items() if all(w(x, y) > 0 for x, y in zip(("domain", "lang", "source"), k))}
    cap = lambda f: sum(t for k, t in live.items() if f(k)) * max_epochs
    plan = {}
    top = plain_fill({d: (cap(lambda k: k[0] == d), w("domain", d)) for d in {k[0] for k in live}}, min(int(have * budget), have * max_epochs))
    for d, b in top.items():
        mid = plain_fill({x: (cap(lambda k: k[:2] == (d, x)), w("lang", x)) for x in {k[1] for k in live if k[0] == d}}, b)
        for x, c in mid.items():
            low = plain_fill({s: (live[d, x, s] * max_epochs, w("source", s)) for s in {k[2] for k in live if k[:2] == (d, x)}}, c)
            plan.update({(d, x, s): v for s, v in low.items()})
    out = []
    for k in plan:
        whole, rest = divmod(plan[k], tokens[k])
        for i, _, n in leaves[k]:
            out += [(i, *k, e, n) for e in range(whole)]
        key = lambda x: (hashlib.md5(f"{seed}/{whole}{'' if x[0] is None else f'/{x[0]}'}".encode()).hexdigest(), hashlib.md5(x[1].encode()).hexdigest())
        for i, _, n in sorted(leaves[k], key=key):
            if rest > 0:
                out.append((i, *k, whole, min(n, rest)))
            rest -= n
    return sorted(map(str, out))


def check(docs, **options):
    got = mixing.mixture(docs, **options).select("id", "domain", "lang", "source", "epoch", "take_tokens").collect()
    assert sorted(str(tuple(r)) for r in got) == plain(docs.collect(), options["budget"], options["max_epochs"], options.get("weights", {}))


def test_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, budget=0.4, max_epochs=1)
    check(docs, budget=1.5, max_epochs=3, weights={"lang": {"en": 2.0, "es": 0.5}, "domain": {"domain1": 5.0}, "source": {"src3": 4.0}})
    check(docs, budget=9.0, max_epochs=2)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, budget=0.5, max_epochs=1)
    assert mixing.mixture(no_docs).count() == 0
    out = mixing.mixed_documents(odd_docs, budget=2.0, max_epochs=2)
    assert out.columns == odd_docs.columns
    with_words = odd_docs.where("text is not null and trim(translate(text, '\\n\\t', '  ')) != ''")
    assert out.count() == 2 * with_words.count()
    assert mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixture(odd_docs, budget=0.0).count() == 0


def test_zero_weight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert mixing.mixture(docs, budget=0.5, weights={"lang": {"en": 0.0}}).where("lang = 'en'").count() == 0


ROW = st.tuples(st.integers(1, 4), st.sampled_from(["a b", "a b c d e", "x", " ".join("w" * 40), "q " * 13]), st.sampled_from(["en", "de"]), st.sampled_from(["s1", "s2", "t5"]), st.integers(1, 4))


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=12), st.sampled_from([0.1, 0.33, 0.5, 0.77, 1.0, 1.9]))
def test_taken_tokens_are_the_budget(spark, rows, budget):
    """Whatever repeats: the mixture has the budget's tokens, and the rows that
    mixed_documents returns are those of the mixture."""
    docs = spark.createDataFrame([r[:4] for r in rows for _ in range(r[4])], "doc_id long, text string, lang string, source string")
    got = mixing.mixture(docs, budget=budget, max_epochs=2, weights={"lang": {"de": 3.0}}).collect()
    have = sum(x[2] for v in leaf_rows(docs.collect()).values() for x in v)
    assert sum(r["take_tokens"] for r in got) == min(int(have * budget), 2 * have)
    whole = mixing.mixed_documents(docs, budget=budget, max_epochs=2, weights={"lang": {"de": 3.0}})
    assert Counter((r["id"], r["lang"], r["source"], r["n_tokens"]) for r in got) == Counter((r["doc_id"], r["lang"], r["source"], len(r["text"].split())) for r in whole.collect())
    check(docs, budget=budget, max_epochs=2, weights={"lang": {"de": 3.0}})


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 100, "en", "s1")] * 2 + [(None, "v " * 10, "en", "s2")] * 3, "doc_id long, text string, lang string, source string")
    for budget in (50, 215):
        assert sum(r["take_tokens"] for r in mixing.mixture(docs, budget=(budget + 0.5) / 230).collect()) == budget
    many = spark.range(3).selectExpr("7L as doc_id", "'a b c' as text", "'en' as lang", "'s1' as source").crossJoin(spark.range(4000)).drop("id")
    assert mixing.mixture(many, budget=0.75).count() == mixing.mixed_documents(many, budget=0.75).count() == 9000


def test_clashing_names(spark, odd_docs):
    named = odd_docs.selectExpr("*", "1 as leaf", "2 as PLAN", "3 as equal", "4 as n", "5 as part", "6 as __m", "7 as a", "8 as s", "9 as `odd.name`", "10 as key", "11 as whole")
    out = mixing.mixed_documents(named, budget=0.35)
    assert out.columns == named.columns
    want = mixing.mixed_documents(odd_docs, budget=0.35)
    assert sorted(map(str, out.select(*odd_docs.columns).collect())) == sorted(map(str, want.collect()))
