import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fixpoint
from corpusmill.plans import corpus_queries as q
from corpusmill.plans.rules import FIX_RULES, Rule
from tests.test_queries import FOLDER

RULES = [
    Rule("pair", "warning", "slop", "", pattern=r"[ab]{2}", replacement="a"),
    Rule("long", "warning", "slop", "", pattern=r"a[a-dé]{2,4}", replacement="é"),
    Rule("grow", "warning", "slop", "", pattern=r"x", replacement="zzz"),
    Rule("gone", "warning", "slop", "", pattern=r"q+", replacement=""),
    Rule("wide", "warning", "slop", "", pattern=r"☃", replacement="snow☃"),
]


def clash(a, b):
    return a[0] == b[0] or a[0] < b[0] + b[1] and b[0] < a[0] + a[1]


def greedy(groups, size):
    kept, names = [], []
    for _, name, edits in sorted((min(e[0] for e in g), name, g) for name, g in groups if g and all(e[0] + e[1] <= size for e in g)):
        if not any(clash(e, k) for e in edits for k in kept):
            kept += edits
            names.append(name)
    return sorted(kept), names


def plain_matches(text, rules):
    out, base = [], 0
    data = text.encode()
    for n, line in enumerate(data.split(b"\n"), 1):
        s = line.decode().removesuffix("\r")
        for i, r in enumerate(rules):
            for m in re.finditer(r.pattern, s):
                start = base + len(s[: m.start()].encode())
                out.append((i, r.id, n, start, start + len(m[0].encode()), m[0]))
        base += len(line) + 1
    return out


def plain_fixed(text, rules, protected, rounds=10):
    protected, fixes, used = list(protected), 0, 0
    for _ in range(rounds):
        free = [m for m in plain_matches(text, rules) if not any(p[0] == m[1] and m[3] < p[2] and p[1] < m[4] for p in protected)]
        edits, names = greedy([((m[0], k), [(m[3], m[4] - m[3], rules[m[0]].replacement)]) for k, m in enumerate(free)], len(text.encode()))
        if not edits:
            return text, protected, fixes, used, True
        data = bytearray(text.encode())
        for at, gone, new in reversed(edits):
            data[at : at + gone] = new.encode()
            for k, (rule, start, end) in enumerate(protected):
                delta = len(new.encode()) - gone
                if at + gone <= start:
                    protected[k] = (rule, start + delta, end + delta)
                elif at < end:
                    protected[k] = (rule, min(start, at), max(end, at + gone) + delta)
        text, fixes, used = bytes(data).decode(), fixes + len(names), used + 1
    return text, protected, fixes, used, False


def random_files(seed, n=150):
    r = random.Random(seed)
    for k in range(n):
        text = "".join(r.choice("aabbcdxq é☃\n") for _ in range(r.choice([0, 1, 10, 80]))).replace("c\n", "\r\n")
        found = plain_matches(text, RULES)
        held = [(m[1], m[3], m[4]) for m in found if r.random() < 0.3]
        yield f"f{k}", text, held


def test_fixpoint_like_plain(spark):
    rows = list(random_files(1))
    files = spark.createDataFrame([(p, "en", t) for p, t, _ in rows], "path string, lang string, text string")
    held = spark.createDataFrame([(p, *h) for p, _, hs in rows for h in hs], "path string, rule_id string, start long, end long")
    got = {r["path"]: r for r in fixpoint.fixed(files, RULES, held).collect()}
    several = 0
    for path, text, hs in rows:
        want, ranges, fixes, rounds, settled = plain_fixed(text, RULES, hs)
        r = got[path]
        assert (r["text"], r["n_fixes"], r["rounds"], r["settled"]) == (want, fixes, rounds, settled), text
        assert sorted(map(tuple, r["protected"])) == sorted(ranges), text
        several += rounds > 1
    assert several > 30
    capped = {r["path"]: (r["text"], r["settled"]) for r in fixpoint.fixed(files, RULES, held, max_rounds=2).collect()}
    assert capped == {p: (w[0], w[4]) for p, t, hs in rows for w in [plain_fixed(t, RULES, hs, 2)]}


def test_a_second_run_changes_nothing(spark):
    rows = [x for x in random_files(2) if "☃" not in x[1]]  # that rule grows for ever
    files = spark.createDataFrame([(p, "en", t) for p, t, _ in rows], "path string, lang string, text string")
    held = spark.createDataFrame([(p, *h) for p, _, hs in rows for h in hs], "path string, rule_id string, start long, end long")
    first = fixpoint.fixed(files, RULES, held)
    assert first.where("settled").count() == len(rows)
    again = fixpoint.fixed(first.select("path", "lang", "text"), RULES, first.select("path", F.explode("protected").alias("p")).select("path", "p.*"))
    assert again.where("n_fixes > 0").count() == 0
    assert dict(again.select("path", "text").collect()) == dict(first.select("path", "text").collect())


def test_groups_like_plain(spark):
    r = random.Random(3)
    rows = [(f"f{r.randrange(30)}", f"g{r.randrange(12):02}", r.randrange(300), r.choice([0, 0, 1, 3, 9]), r.choice(["", "x"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "path string, group string, position long, deleted long, inserted string")
    want = set()
    for path in {x[0] for x in rows}:
        groups = {}
        for p, g, *e in rows:
            if p == path:
                groups.setdefault(g, []).append(tuple(e))
        want |= {(path, g, *e) for g in greedy([(g, sorted(es)) for g, es in groups.items()], 10**9)[1] for e in groups[g]}
    got = list(map(tuple, fixpoint.chosen_groups(df).collect()))
    assert set(got) == want
    assert 0 < len(want) < len(rows)


def test_no_edit_out_of_bounds_and_no_broken_text(spark):
    df = spark.createDataFrame([("aéb", [(1, 1, "x")]), ("aéb", [(1, 2, "x")]), ("", []), ("ab", [(2, 0, "c")])], f"text string, edits array<{fixpoint.EDIT}>")
    assert [r[0] for r in df.select(fixpoint.spliced(F.col("text"), F.col("edits"))).collect()] == ["aéb", "axb", "", "abc"]
    groups = f"array<struct<at:bigint,seq:bigint,edits:array<{fixpoint.EDIT}>>>"
    g = spark.createDataFrame([([(0, 0, [(0, 1, "x"), (4, 2, "y")]), (1, 1, [(1, 1, "z")]), (2, 2, [])],)], f"g {groups}")
    assert g.select(fixpoint.without_conflicts(F.col("g"), F.lit(5)).alias("c")).first()["c"]["seqs"] == [1]


def test_which_rules_may_fix():
    own = [Rule("own", "warning", "slop", "", pattern="a", replacement="b")]
    ids = lambda rules: [r.id for r in rules]
    assert "doubled-the" not in ids(fixpoint.fixable(FIX_RULES)) and "doubled-the" in ids(fixpoint.fixable(FIX_RULES, unsafe=True))
    assert "own" not in ids(fixpoint.fixable(FIX_RULES, own=own)) and "own" in ids(fixpoint.fixable(FIX_RULES, own=own, trust_own=True))


def test_protected_by_directives_and_baseline(spark):
    text = "aa x\nx bb\nx"
    files = spark.createDataFrame([("f", "en", text)], "path string, lang string, text string")
    directives = spark.createDataFrame([("f", 2, "grow"), ("f", 3, None)], "path string, target_line long, rule_id string")
    got = sorted(map(tuple, fixpoint.protected_ranges(files, RULES, directives).collect()))
    assert got == [("f", "grow", 5, 6), ("f", "grow", 10, 11)]
    from corpusmill.operators import findings

    hashes = findings.hashed(findings.scan_files(files, RULES, context=2)).where("rule_id = 'pair'").select("hash")
    got = sorted(map(tuple, fixpoint.protected_ranges(files, RULES, directives, hashes).collect()))
    assert got == [("f", "grow", 5, 6), ("f", "grow", 10, 11), ("f", "pair", 0, 2), ("f", "pair", 7, 9)]
    with pytest.raises(ValueError, match="neither"):
        fixpoint.protected_ranges(files, RULES)


def test_query_like_plain(spark):
    files = {r["path"]: r["text"] for r in q.documents(spark, FOLDER).collect()}
    held = {}
    for r in q.protected_ranges(spark, FOLDER).collect():
        held.setdefault(r["path"], []).append((r["rule_id"], r["start"], r["end"]))
    got = {r["path"]: r for r in q.fix_fixpoint(spark, FOLDER).collect()}
    assert set(got) == set(files)
    changed = 0
    for path, text in files.items():
        rules = [r for r in q.SAFE if not (r.ignores and re.match(r"(?:.*/)?es/.*", path))]
        want, _, fixes, rounds, settled = plain_fixed(text, rules, held.get(path, []))
        assert (got[path]["text"], got[path]["n_fixes"], got[path]["rounds"], got[path]["settled"]) == (want, fixes, rounds, settled)
        changed += rounds > 0
    assert changed > 5


def test_a_file_of_very_many_matches(spark):
    n = 20_000
    files = spark.createDataFrame([("f", "en", "!!\n" * n)], "path string, lang string, text string")
    rule = [r for r in FIX_RULES if r.id == "bang-pair"]
    held = spark.createDataFrame([("f", "bang-pair", 0, 2), ("f", "bang-pair", 3 * n - 3, 3 * n - 1)], "path string, rule_id string, start long, end long")
    begun = time.monotonic()
    r = fixpoint.one_round(fixpoint.with_protected(files, held), rule).first()
    assert (r["text"], r["n"]) == ("!!\n" + "!\n" * (n - 2) + "!!\n", n - 2)
    assert sorted(map(tuple, r["protected"])) == [("bang-pair", 0, 2), ("bang-pair", 2 * n - 1, 2 * n + 1)]
    assert time.monotonic() - begun < 40  # a fold that copies what it has taken needs minutes
