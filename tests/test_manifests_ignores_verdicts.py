import hmac
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import hmac_sha256
from corpusmill.operators import ignores, manifests, selftests
from corpusmill.operators.verdicts import VerdictStore
from corpusmill.plans.code_rules import CODE_RULES
from corpusmill.plans.rules import TEXT_RULES
from corpusmill.shared import shared_dir

PACKAGES = "dir string, name string, lib_name string, is_workspace boolean"
DEPS = "dir string, section string, key string, package string, path string, workspace boolean"


def plain_importable(packages, deps):
    """dir -> names, by walking up from each package."""
    libs = {d: lib for d, _, lib, _ in packages}
    spaces = {d for d, _, _, w in packages if w}
    shared = {}
    for d, section, key, package, path, _ in deps:
        if section == manifests.SHARED:
            shared.setdefault((d, key), []).append((package, path))
    at = lambda base, path: os.path.normpath(os.path.join("/", base, path)).strip("/")
    out = {}
    for d, name, lib, _ in packages:
        names = {name.replace("-", "_"), *([lib] if lib else [])}
        parts = d.split("/") if d else []
        root = next((r for r in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if r in spaces), None)
        for e, _, key, package, path, inherits in deps:
            if e != d:
                continue
            names.add(key.replace("-", "_"))
            if package:
                continue
            given = [(package, path, d)] if path else [(p, x, root) for p, x in shared.get((root, key), [])] if inherits and root is not None else []
            names |= {libs[at(base, x)] for p, x, base in given if not p and x and libs.get(at(base, x))}
        out[d] = names
    return out


def test_importable_like_plain(spark):
    r = random.Random(1)
    dirs = ["", "a", "a/b", "a/b/c", "d", "d/e", "f-g", "f-g/h"]
    packages = [(d, f"n-{i}", r.choice([None, f"lib{i}"]), r.random() < 0.4) for i, d in enumerate(dirs)]
    path = lambda d: r.choice([None, os.path.relpath("/" + r.choice(dirs), "/" + d), "./x/../../" + r.choice(dirs), "nowhere"])
    deps = [(d, r.choice(["dependencies", "dev-dependencies", manifests.SHARED]), f"k-{r.randrange(6)}", r.choice([None, None, "other"]), path(d), r.random() < 0.5) for d in r.choices(dirs, k=150)]
    got = {}
    for row in manifests.importable(spark.createDataFrame(packages, PACKAGES), spark.createDataFrame(deps, DEPS)).collect():
        got.setdefault(row["dir"], set()).add(row["name"])
    assert got == plain_importable(packages, deps)


def test_workspaces_and_folders(spark):
    packages = spark.createDataFrame([("a/b", "x", None, False), ("a", "y", None, True), ("c", "z", None, False), ("d", "w", None, True)], PACKAGES)
    assert {tuple(r) for r in manifests.workspaces(packages).collect()} == {("a/b", "a"), ("a", "a"), ("d", "d")}
    rows = spark.createDataFrame([("a/b", "../c"), ("", "x/./y"), ("a", "../../b"), ("a", ".")], "d string, p string")
    assert [r[0] for r in rows.select(manifests.joined(F.col("d"), F.col("p"))).collect()] == ["a/c", "x/y", "b", "a"]
    none = manifests.importable(packages.limit(0), spark.createDataFrame([], DEPS))
    assert none.count() == 0


IGNORE_FILES = {
    "": "# c\n*.log\n!keep.log\n/only_here\nbuild/\ndoc/*.txt\n**/deep/x\na/**/z\nlogs/**\n\\!odd\nq?.md\n[ab].c\n[!ab].h\ntrail   \n",
    "sub": "!*.log\nx.log\n!build/\n/only_here\n",
    "sub/deep": "!x\n*\n!y\n",
}


def test_like_git(spark, tmp_path):
    names = ["a.log", "keep.log", "x.log", "only_here", "doc/a.txt", "doc/b/c.txt", "deep/x", "a/z", "a/b/c/z", "logs/l", "!odd", "q1.md", "q12.md", "a.c", "c.c", "a.h", "c.h", "trail", "build", "y", "é.log", "x.y+z"]
    paths = sorted({*names, *(f"sub/{n}" for n in names if n != "build"), *(f"sub/deep/{n}" for n in names if n != "build"), "sub/build/k", "other/build/k", "sub/deep/build/k", "a/build2/k"})
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    for d, text in IGNORE_FILES.items():
        (tmp_path / d / ".gitignore").write_text(text)
    try:
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
    except (OSError, subprocess.CalledProcessError):
        pytest.skip("no git")
    listed = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "--others", "--exclude-standard"], check=True, capture_output=True, text=True)
    want = sorted(x for x in listed.stdout.split("\n") if x and not x.endswith(".gitignore"))
    rules = ignores.patterns(spark.createDataFrame(list(IGNORE_FILES.items()), "dir string, text string"))
    got = ignores.kept(spark.createDataFrame([(p,) for p in paths], "path string"), rules)
    assert sorted(r["path"] for r in got.collect()) == want
    assert 10 < len(want) < len(paths)


def test_store_asks_once_and_the_latest_counts(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [float("nan") if x == "bad" else min(1.5, len(x) / 10) for x in prompts]

    store = VerdictStore(spark, shared_dir(spark))
    assert store.verdicts().count() == 0
    some = spark.createDataFrame([("k1", "p"), ("k1", "p"), ("k2", "ppppppp"), ("k3", "bad"), ("k4", "p" * 20)], "key string, prompt string")
    first = {r["key"]: r["probability"] for r in store.ask(some, model).collect()}
    assert first == {"k1": 0.1, "k2": 0.7} and asked.value == 4
    store.ask(some, model).collect()
    assert asked.value == 6  # only those without a sound answer
    store.put(spark.createDataFrame([("k1", True, 0.9, "by hand")], "key string, is_issue boolean, probability double, reason string"))
    before = sorted(map(tuple, store.verdicts().collect()))
    store.compact()
    assert sorted(map(tuple, store.verdicts().collect())) == before
    assert dict(store.verdicts().select("key", "probability").collect()) == {"k1": 0.9, "k2": 0.7}
    # A batch that was never finished isn't read.
    broken = f"{store.path}/batch-99".removeprefix("file:").replace("//", "/", 1)
    os.makedirs(broken, exist_ok=True)
    assert sorted(map(tuple, store.verdicts().collect())) == before
    store.put(spark.createDataFrame([("k9", False, 0.0, "")], "key string, is_issue boolean, probability double, reason string"))
    assert store.verdicts().count() == 3


#: What rules have to find, and what not.
SNIPPETS = [
    ("mail-address", "write to a.b@c-d.org", True), ("mail-address", "a at b.org", False), ("card-number", "1234567890123456", True), ("card-number", "1234 5678", False), ("ipv4-address", "10.0.0.1", True),
    ("pipe-list", "x | a b | y", True), ("pipe-list", "x|y", False), ("symbol-run", "a\n##%", True), ("secret-token", 'token = "abc"', False), ("unwrap", "x.unwrap();", True), ("unwrap", "x.unwrap_or(1);", False),
    ("dropped-result", "let _ = f();", True), ("dropped-result", "let _ = tx.send(1);", False), ("license-line", "no such line", True),
]


def test_rules_on_their_snippets(spark):
    rules = {r.id: r for r in [*TEXT_RULES, *CODE_RULES] if r.pattern}
    df = spark.createDataFrame([(r.id, r.pattern, r.unless) for r in rules.values()], "rule_id string, pattern string, unless string")
    got = {r["rule_id"]: (r["passed"], r["failed"], r["status"]) for r in selftests.summary(df, spark.createDataFrame(SNIPPETS, "rule_id string, snippet string, should_match boolean")).collect()}
    assert set(got) == set(rules)
    assert got["mail-address"] == (2, 0, "pass") and got["dropped-result"] == (2, 0, "pass") and got["shouting"] == (0, 0, "none")
    assert {k for k, v in got.items() if v[2] == "fail"} == {"license-line"}
    assert selftests.summary(df.limit(0), spark.createDataFrame([], "rule_id string, snippet string, should_match boolean")).count() == 0


def test_hmac_like_the_library(spark):
    cases = [(k, m) for k in (b"", b"k", b"x" * 64, b"y" * 65, bytes(range(200)), "é".encode()) for m in (b"", b"text", "é☃".encode() * 100)]
    df = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m in cases], "k binary, m binary")
    got = df.select(hmac_sha256(F.col("k"), F.col("m"))).collect()
    assert [r[0] for r in got] == [hmac.new(k, m, "sha256").hexdigest() for k, m in cases]
