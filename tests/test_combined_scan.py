import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import findings
from corpusmill.plans.literals import one_of, required
from corpusmill.plans.rules import TEXT_RULES, Rule, active


@pytest.mark.parametrize(
    ("pattern", "strings"),
    [
        ("abc", ("abc",)), ("ax|by", ("ax", "by")), ("a|b", None), ("a?bc", ("bc",)), ("x(ab|cd)+", ("ab", "cd")), ("[ab]", None), ("(?i)abc", None), (r"\p{L}abc", None), ("ab(?=cd)cd", ("abcd",)),
        (r"\bfoo\b.*barbaz", ("barbaz",)), ("(?:abc){2,}", ("abc",)), ("(?:abc)*", None), ("a|", None), ("", None), ("(?>xy)z", ("xy",)), ("[a-z&&[^b]]cd", None), ("é☃", ("é☃",)), (r"a\.b", ("a.b",)),
    ],
)
def test_required(pattern, strings):
    assert required(pattern) == strings


def test_every_match_has_a_required_string():
    r = random.Random(1)
    parts = ["a", "bc", "[xy]", "(?:ab|c)", "(a|bb)+", "d?", r"\b", "e{2}", "(?:fg)*", "."]
    for _ in range(2000):
        p = "".join(r.choice(parts) for _ in range(r.randrange(1, 6)))
        text = "".join(r.choice("abcdefgxy ") for _ in range(60))
        for m in re.finditer(p, text):
            assert not required(p) or any(x in m[0] for x in required(p)), (p, m[0])


def test_one_of_finds_the_longest():
    strings = ["ab", "abc", "abd", "b", "xyz", "x.", "é"]
    p = re.compile(f"(?=({one_of(strings)}))")
    for text in ("abcab", "xyzx.b", "éabd", "q", ""):
        want = [max((s for s in strings if text.startswith(s, i)), key=len, default=None) for i in range(len(text))]
        assert p.findall(text) == [w for w in want if w]


def many_rules():
    own = [Rule(f"w{i}", "warning", "slop", "it's", pattern=p, unless=u, language=lang, files=f, ignores=g, skip_tests=t) for i, (p, u, lang, f, g, t) in enumerate([
        (r"it's|q'\\", None, None, (), (), False), (r"th", "the", None, (), (), False), (r"ere\b", None, "en", (), (), False), (r"in", None, None, ("src1*/**",), (), False),
        (r"on", None, None, (), ("**/de/**",), False), (r"an", None, None, (), (), True), (r"[Tt]h[a-e]", None, None, (), (), False),
    ])]
    rare = [Rule(f"r{i}", "error", "security", "m", pattern=rf"th{a}{b}|q{i}z") for i, (a, b) in enumerate([(a, b) for a in "abcdefghijklmn" for b in "aeioun"])]
    return [*[r for r in active(TEXT_RULES) if r.pattern], *own, *rare]


def plain(files, rules):
    from corpusmill.functions.text import TEST_PATHS, glob_regex

    out = []
    for path, lang, text in files:
        lines = re.split("\r?\n", text)
        for n, line in enumerate(lines[:-1] if text.endswith("\n") else lines if text else [], 1):
            for r in rules:
                off = r.language not in (None, lang) or r.files and not any(re.search(glob_regex(g), path) for g in r.files) or any(re.search(glob_regex(g), path) for g in r.ignores)
                if off or r.skip_tests and any(re.search(x, path) for x in TEST_PATHS) or r.unless and re.search(r.unless, line):
                    continue
                for m in re.finditer(r.pattern, line):
                    at = len(line[: m.start()].encode())
                    out.append((path, r.id, r.message, n, at + 1, at + 1 + len(m[0].encode()), m[0]))
    return sorted(out)


def test_many_rules_like_plain(spark):
    files = [(f"{a}/{b}/{i}.txt", b, t) for i, (a, b, t) in enumerate([
        ("src1", "en", "the there thin\nIt's in on an, it's q'\\ thae thou q3z"), ("src12", "de", "Then anon é☃ the\r\nthere in"), ("tests", "en", "an in the an"), ("s", "fr", ""), ("s", "fr", "\n\nthan\n"), ("s", "es", "nothing"),
        ("s", "es", "a@b.cd 1.2.3.4 " + "thanthat" * 40),
    ])]
    rules = many_rules()
    assert len(findings._index(rules)) > findings.INDEXED
    df = spark.createDataFrame(files, "path string, lang string, text string")
    columns = ["path", "rule_id", "message", "line", "column", "end_column", "matched_text"]
    for some in (rules, rules[:9]):
        want = plain(files, some)
        assert sorted(map(tuple, findings.scan_files(df, some).select(*columns).collect())) == want
        from corpusmill.operators.lines import lines

        assert sorted(map(tuple, findings.scan(lines(df), some).select(*columns).collect())) == want


def test_the_scan_is_in_the_plan_once(spark):
    df = spark.createDataFrame([("p", "en", "t")], "path string, lang string, text string")
    rules = [r for r in TEXT_RULES if r.pattern]
    for context in (None, 2):
        plan = findings.scan_files(df, rules, context).select(F.count("*"), F.max("column"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("token = ") <= 5  # the flags of file and line, the pattern, and twice for places
        assert not [x for x in plan.split("\n") if "Filter" in x and "RLIKE" in x]
