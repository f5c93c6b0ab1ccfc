import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.operators import blocks, code, facts
from corpusmill.operators.tokens import MOST, brackets, placed, slices


def files(spark, *rows):
    return spark.createDataFrame(rows, "path string, lang string, text string")


def plain_tree(text):
    """(kind, pre, post, parent, level) by walking over characters; every character is a token."""
    out, open_ = [], []
    for i, c in enumerate(text):
        if c in "([{":
            open_.append((c, i))
        elif c in ")]}" and any(k == {")": "(", "]": "[", "}": "{"}[c] for k, _ in open_):
            while open_[-1][0] != {")": "(", "]": "[", "}": "{"}[c]:
                open_.pop()
            kind, begin = open_.pop()
            out.append((kind, begin, i))
    rows = []
    for kind, a, b in out:
        around = [x for x in out if x[1] < a and b < x[2]]
        rows.append((kind, a, b, max([x[1] for x in around], default=None), len(around)))
    return rows


def random_brackets(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("([{}])})];.+\n") for _ in range(r.choice([0, 1, 5, 30, 80]))) for _ in range(n)]


def test_tree_like_a_plain_walk(spark):
    texts = random_brackets(1, 120)
    t = code.token_arrays(files(spark, *[(str(i), "rust", x) for i, x in enumerate(texts)]))
    tree = blocks.block_tree(t).cache()
    got = {}
    for r in tree.collect():
        got.setdefault(r["path"], set()).add((r["kind"], r["pre"], r["post"], r["level"]))
    for i, x in enumerate(texts):
        assert got.get(str(i), set()) == {(k, a, b, level) for k, a, b, _, level in plain_tree(x)}, x
    # Relations by intervals against comparing all blocks of a file.
    curly, round_ = tree.where("kind = '{'"), tree.where("kind = '('")
    key = lambda df: {(r["path"], r["pre"]) for r in df.select("path", "pre").collect()}
    plain = {str(i): plain_tree(x) for i, x in enumerate(texts)}
    each = [(p, b) for p, bs in plain.items() for b in bs]
    within = lambda a, b: b[1] < a[1] and a[2] < b[2]
    want = {(p, b[1]) for p, b in each if b[0] == "(" and any(within(b, o) for o in plain[p] if o[0] == "{")}
    assert key(blocks.inside(round_, curly)) == want and want
    assert key(blocks.not_inside(round_, curly)) == {(p, b[1]) for p, b in each if b[0] == "("} - want
    assert key(blocks.has(curly, round_)) == {(p, b[1]) for p, b in each if b[0] == "{" and any(within(o, b) for o in plain[p] if o[0] == "(")}
    right = {(p, b[1]) for p, b in each if b[0] == "(" and b[3] is not None and any(o[1] == b[3] and o[0] == "{" for o in plain[p])}
    parents = {(r["path"], r["pre"]): r["parent"] for r in tree.collect()}
    # Only matched brackets are blocks; one that nothing closes may still be named as the parent.
    assert key(blocks.inside(round_, curly, neighbour=True)) == {(p, k) for p, k in right if parents[p, k] in {o[1] for o in plain[p]}}
    deep = {(r["path"], r["pre"]): r["outer_pre"] for r in blocks.innermost(round_.select("path", "pre"), curly, "pre").collect()}
    assert deep == {(p, b[1]): max((o[1] for o in plain[p] if o[0] == "{" and within(b, o)), default=None) for p, b in each if b[0] == "("}


def test_brackets():
    assert brackets(list("{(})"))[0] == [2, -1, 0, -1]
    pair, inner, head = brackets(["{", ";", "{", "}", "{", "}", "}"])
    assert pair == [6, -1, 3, 2, 5, 4, 0] and inner == [0, 0, 2, 0, 4, 0, -1]
    assert [head[k] for k in (0, 2, 4)] == [-1, 1, 3]


def test_files_are_placed_a_few_at_a_time():
    r = random.Random(5)
    rows = [list("a{;}") * r.choice([0, 1, 30, 400]) for _ in range(300)]
    tokens = pa.array([["x"], *rows], pa.list_(pa.string()))[1:]
    cut = list(slices(tokens, 1000))
    assert [k for a, b in cut for k in range(a, b)] == list(range(300)) and len(cut) > 20
    assert all(sum(map(len, rows[a:b])) <= 1000 + max(map(len, rows)) for a, b in cut)
    rust = np.ones(300, bool)
    whole = placed(tokens, rust).to_pylist()
    assert [x for a, b in cut for x in placed(tokens[a:b], rust[a:b]).to_pylist()] == whole
    assert list(slices(tokens[:0])) == [(0, 0)] and MOST < 100_000


def test_tokens_follow_without_a_gap(spark):
    text = "/** d */ fn é() {\r\n\tlet s = \"a\\\"{\"; // {\n}\n/// x\n//// y\n//! z\nlet r = r#\"q\"} \"#; 'c' b\"x\" \"open"
    t = code.token_arrays(files(spark, ("a", "rust", text), ("b", "typescript", text), ("c", "rust", ""), ("d", None, text), ("e", "rust", "é{")))
    rows = {r["path"]: r["tokens"] for r in t.collect()}
    assert rows["c"] == []
    for path in "abd":
        assert "".join(x["text"] for x in rows[path]) == text
        for k, x in enumerate(rows[path]):
            before = "".join(y["text"] for y in rows[path][:k])
            assert x["i"] == k and x["line"] == before.count("\n") + 1
            assert x["column"] == len(before.rpartition("\n")[2].encode()) + 1
            assert x["end_line"] == x["line"] + x["text"].count("\n")
    kinds = {x["text"]: x["kind"] for x in rows["a"]}
    assert [kinds[x] for x in ("/** d */", "// {", "/// x", "//// y", "//! z", '"a\\"{"', 'r#"q"} "#', "'c'", 'b"x"', '"', "é", "(")] == [
        "doc_comment", "comment", "doc_comment", "comment", "doc_comment", "string", "string", "string", "string", "sign", "word", "sign",
    ]
    assert [x["pair"] for x in rows["e"]] == [-1, -1]


def test_facts_of_a_file(spark):
    text = """use a::{b, c as d, e::{self, f::*}};
use g;
use {h::i, j};
use ::k::l;
fn impl_use() -> impl Sized + use<'a> { m::n::<u8>(1); o.p(); if (q) { r!{}; s!(t(2)) } }
#[tokio::test] async fn one() { fn inner() { u(); } v(); }
#[should_panic] #[test] fn two() {}
fn w() { eyre!("long message here {}", x); bail!(r"raw message here"); y("another long text"); ensure!(z, "short"); }
"""
    t = code.token_arrays(files(spark, ("f.rs", "rust", text))).cache()
    uses = {(r["line"], r["root"], r["name"], r["glob"]) for r in facts.rust_uses(t).collect()}
    assert uses == {(1, "a", "b", False), (1, "a", "d", False), (1, "a", "e", False), (1, "a", None, True), (2, "g", "g", False), (3, None, "i", False), (3, None, "j", False), (4, "k", "l", False)}
    tree = blocks.block_tree(t).cache()
    assert {(r["name"], r["is_test"]) for r in facts.functions(tree).collect()} == {("impl_use", False), ("one", True), ("inner", False), ("two", False), ("w", False)}
    owned = {(r["owner"], r["name"]) for r in facts.owned_calls(t, tree).collect()}
    assert owned == {("impl_use", x) for x in "nprst"} | {("inner", "u"), ("one", "v"), ("w", "eyre"), ("w", "bail"), ("w", "y"), ("w", "ensure")}
    assert [r["text"] for r in facts.error_messages(t).collect()] == ["long message here {}"]


def test_script_imports_of_a_file(spark):
    text = "import x from 'a';\nexport * from 'b';\nimport type T from 'c';\nimport 'd';\nimport y = require(\"e\");\nimport(\"f\");\nconst from = 'g';\nfoo.require('h')\n"
    got = {(r["line"], r["specifier"]) for r in facts.script_imports(code.token_arrays(files(spark, ("a.ts", "typescript", text), ("b.ts", "typescript", "export {q} from 'z'")))).collect()}
    assert got == {(1, "a"), (4, "d"), (5, "e"), (8, "h")}


def test_names_resolve_in_file_then_import_then_root(spark):
    helpers = spark.createDataFrame([("f1", "h", True), ("f2", "h", False), ("r", "h", False), ("r", "k", False), ("f2", "m", False), ("f1", "w", False)], "scope string, name string, asserts boolean")
    calls = spark.createDataFrame([("f1", "r", "t1", "h"), ("f2", "r", "t2", "h"), ("f3", "r", "t3", "h"), ("f3", "r", "t3", "k"), ("f3", "r", "t4", "m"), ("f3", "r", "t5", "nowhere"), ("f2", "r", "m", "expect_ok"), ("f1", "r", "w", "h")], "path string, root string, owner string, name string")
    imports = spark.createDataFrame([("f3", "h", "f1"), ("f3", "m", "f2"), ("f3", "x", "f9")], "path string, name string, scope string")
    got = facts.resolved_calls(calls, helpers, imports)
    assert {(r["owner"], r["name"]): r["callee_scope"] for r in got.collect()} == {
        ("t1", "h"): "f1", ("t2", "h"): "f2", ("t3", "h"): "f1", ("t3", "k"): "r", ("t4", "m"): "f2", ("t5", "nowhere"): None, ("m", "expect_ok"): None, ("w", "h"): "f1",
    }
    edges = got.select(F.col("path").alias("scope"), F.col("owner").alias("name"), "callee_scope", F.col("name").alias("callee"))
    assert {tuple(r) for r in facts.asserting(helpers, edges).collect()} == {("f1", "h"), ("f1", "w")}
    assert {tuple(r) for r in facts.asserting(helpers, edges, globs=["expect_*"]).collect()} == {("f1", "h"), ("f1", "w"), ("f2", "m")}


def test_reaching_a_long_chain(spark):
    from corpusmill.operators.crossfile import MOST_ROUNDS, reaching

    n = MOST_ROUNDS + 4
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, n - 1), (100, 101)], "caller long, callee long")
    assert sorted(r["node"] for r in reaching(edges, spark.createDataFrame([(n,)], "node long")).collect()) == list(range(n + 1))


def test_the_files_stay_in_their_rows(spark):
    t = code.token_arrays(files(spark, ("a", "rust", "fn a() {}")))
    for df in (t, code.blanked(t), code.blocks(t), facts.calls(t), facts.error_messages(t), facts.rust_uses(t)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_trees_stay_in_their_rows(spark):
    t = code.token_arrays(files(spark, ("a", "rust", "fn a() {}")))
    assert "Exchange" not in blocks.block_tree(t)._jdf.queryExecution().executedPlan().toString()


def test_heads_without_comments(spark):
    t = code.token_arrays(files(spark, ("a", "rust", "x; /* c */ #[a]\n  fn  b() /* d */ { }")))
    assert [re.sub(r"\s+", " ", r["head"]) for r in blocks.block_tree(t).where("kind = '{'").collect()] == ["#[a] fn b()"]
