import json
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import code, crossfile, findings, fixes, lines, metrics, resolution, review
from corpusmill.plans import rules as R
from corpusmill.sources import sinks, tree
from corpusmill.streaming import incremental

RUST = """//! crate
use serde::Deserialize; // TODO tidy
/* block
 TODO é */ fn alpha(x: &str) -> usize { let s = "// not a comment {"; s.len() }
/// doc TODO
pub trait Shape { fn area(&self) -> f64; }
impl Shape for Circle { fn area(&self) -> f64 { 3.0 } }
struct Circle;
const R: &str = r#"raw " { "#; const C: char = '{';
#[cfg(test)]
mod tests {
    fn beta() { assert!(true); }
}
fn gamma() {}
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, lang string, text string")


def test_lines(spark):
    for text, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\n", ["a", "b"]), ("\n", [""])):
        df = files(spark, ("f", "x", text))
        assert [r["text"] for r in lines.lines(df).orderBy("line").collect()] == want
        assert df.select(T.line_count(F.col("text"))).first()[0] == len(want)


def test_match_places(spark):
    rule = R.Rule("r", "error", "slop", "m", pattern=r"\bab+\b")
    df = files(spark, ("f", "x", "xab é— ab abb"))
    got = [(r["column"], r["end_column"], r["matched_text"]) for r in findings.scan(lines.lines(df), [rule]).collect()]
    raw = "xab é— ab abb"
    want = [(len(raw[: m.start()].encode()) + 1, len(raw[: m.end()].encode()) + 1, m[0]) for m in re.finditer(r"\bab+\b", raw)]
    assert sorted(got) == sorted(want)


def test_tokens(spark):
    t = code.tokens(files(spark, ("a.rs", "rust", RUST)))
    rows = t.orderBy("i").collect()
    assert "".join(r["text"] for r in rows) == RUST
    raw, at = RUST.encode(), 0
    for r in rows:  # places by hand
        assert r["line"] == raw[:at].count(b"\n") + 1
        assert r["column"] == at - (raw[:at].rfind(b"\n") + 1) + 1
        at += len(r["text"].encode())
    by_kind = {k: [r["text"] for r in rows if r["kind"] == k] for k in ("comment", "doc_comment", "string")}
    assert by_kind["string"] == ['"// not a comment {"', 'r#"raw " { "#', "'{'"]
    assert by_kind["comment"] == ["// TODO tidy", "/* block\n TODO é */"]
    assert by_kind["doc_comment"] == ["//! crate", "/// doc TODO"]
    assert rows[-1]["depth"] == 0


def test_long_tokens(spark):
    text = "/*" + "* x\n" * 20_000 + "*/ let s = \"" + "a\\\"" * 20_000 + '";'
    t = code.tokens(files(spark, ("a.rs", "rust", text)))
    assert [r["n"] for r in t.groupBy("kind").agg(F.count("*").alias("n")).where("kind != 'code'").collect()] == [1, 1]


def test_code_structure(spark):
    t = code.token_arrays(files(spark, ("a.rs", "rust", RUST)))
    plain = lines.lines(code.blanked(t))
    ranges = code.test_ranges(plain, code.blocks(t)).collect()
    assert [(r["start"], r["end_excl"]) for r in ranges] == [(10, 14)]
    s = {(r["kind"], r["name"], r["of"]) for r in code.symbols(plain).collect()}
    assert {("trait", "Shape", ""), ("impl", "Shape", "Circle"), ("type", "Circle", ""), ("use", "serde", "serde::Deserialize"), ("function", "gamma", "")} <= s
    m = metrics.file_metrics(code.blanked(t), r"^\s*//").first()
    assert m["file_lines"] == 14 and m["import_count"] == 1 and m["function_count"] == 5


def test_directives(spark):
    text = "// scan-off-next-line\nab\n// scan-off-next-line r -- why\nab\n// scan-off-next-line other\nab\n  // scan-off-next-line"
    ls = lines.lines(files(spark, ("f", "x", text)))
    found = findings.scan(ls, [R.Rule("r", "error", "slop", "m", pattern="ab")])
    d = lines.directives(ls)
    assert [r["line"] for r in findings.suppressed(found, d).collect()] == [6]
    assert sorted(r["comment_line"] for r in findings.unused_directives(d, found).collect()) == [5, 7]


def test_baseline_of_all_leaves_none(spark):
    ls = lines.lines(files(spark, ("f", "x", "ab\nq\nab\nab"), ("g", "x", "ab")))
    found = findings.hashed(lines.context(findings.scan(ls, [R.Rule("r", "error", "slop", "m", pattern="ab")]), ls, 2))
    base = findings.baseline_of(found)
    assert findings.beyond_baseline(found, base).count() == 0
    assert findings.beyond_baseline(found, base.limit(0)).count() == 4


def test_escalation(spark):
    f = spark.createDataFrame([("f", "a", "warning")] * 3 + [("f", "a", "error")] + [("g", "a", "warning")], "path string, rule_id string, severity string")
    out = findings.escalated(f, 4)
    assert out.where("escalated").count() == 3
    assert findings.escalated(f, 5).where("escalated").count() == 0
    assert findings.escalated(f, 9, {"a": 0}).where("escalated").count() == 4


def test_fixes_end(spark):
    rule = R.Rule("r", "error", "slop", "m", pattern="ab+", replacement="é")
    ls = lines.lines(files(spark, ("f", "x", "é ab abb\nnone\nxab")))
    once = fixes.applied(ls, fixes.not_overlapping(fixes.edits(findings.scan(ls, [rule]), [rule])))
    assert fixes.rejoined(once).first()["text"] == "é é é\nnone\nxé"
    again = findings.scan(once.withColumn("lang", F.lit("x")), [rule])
    assert again.count() == 0


def test_overlapping_edits(spark):
    e = spark.createDataFrame([("f", 1, 1, 4, "A", "p"), ("f", 1, 3, 6, "B", "q"), ("f", 1, 4, 5, "C", "r")], "path string, line long, start long, end long, inserted string, rule_id string")
    assert sorted(r["inserted"] for r in fixes.not_overlapping(e).collect()) == ["A", "C"]


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "d"), ("e", "s")], "caller string, callee string")
    seeds = spark.createDataFrame([("s",)], "node string")
    assert sorted(r["node"] for r in crossfile.reaching(edges, seeds).collect()) == ["d", "e", "s"]


def test_lone_owner(spark):
    declared = spark.createDataFrame([("T", "c", "p"), ("U", "c", "p"), ("V", "c", "p"), ("V", "c", "q"), ("W", "c", "p")], "name string, root string, path string")
    impls = spark.createDataFrame([("T", "A", "c", False), ("U", "A", "c", False), ("U", "B", "c", False), ("V", "A", "c", False), ("W", "X", "c", False)], "name string, type string, root string, blanket boolean")
    local = spark.createDataFrame([("A", "c"), ("B", "c"), ("X", "other")], "type string, root string")
    assert [r["name"] for r in crossfile.lone_owners(declared, impls, local).collect()] == ["T"]


def test_verdicts(spark):
    c = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "key string")
    v = spark.createDataFrame([("k1", True, 0.9, "x\x07y"), ("k2", False, 0.1, ""), ("k3", True, float("nan"), "")], "key string, is_issue boolean, probability double, reason string")
    got = {r["key"]: (r["status"], r["reason"]) for r in review.confirmed(c, v, 0.7).collect()}
    assert got == {"k1": ("confirmed", "xy"), "k3": ("invalid", ""), "k4": ("unverified", None)}
    asked = review.asked(spark.createDataFrame([("k", "p")], "key string, prompt string"), lambda ps: [0.8 for _ in ps])
    assert asked.first()["is_issue"] is True


def test_globs_and_paths(spark):
    rx = lambda g, p: re.match(T.glob_regex(g), p) is not None
    assert rx("**/src/**/*.rs", "src/a.rs") and rx("**/src/**/*.rs", "x/src/y/a.rs") and not rx("*.rs", "x/a.rs") and rx("a.{ts,tsx}", "a.tsx")
    paths = {"src/a.rs": False, "tests/a.rs": True, "src/a_test.rs": True, "src/a.spec.ts": True, "src/test_x/a.rs": True, "src/contest.rs": False, "test.rs": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["t"] for r in df.select("path", T.test_path(F.col("path")).alias("t")).collect()} == paths


def test_rules():
    with pytest.raises(ValueError):
        R.Rule("x", "error", "slop", "m")
    with pytest.raises(ValueError):
        R.Rule("x", "error", "slop", "m", metric="file_lines")
    ids = [r.id for r in R.active(R.TEXT_RULES, R.Activation(disable=("shouting",)))]
    assert "shouting" not in ids and "long-word" not in ids
    assert [r.id for r in R.active(R.TEXT_RULES, R.Activation(enable=("long-word",)))] == ["long-word"]
    with pytest.raises(ValueError):
        R.active(R.TEXT_RULES, R.Activation(own=(R.TEXT_RULES[0],)))


def test_tree(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.rs").write_text("fn a() {}\n")
    (tmp_path / "y.ts").write_text("import x from '@s/p/q'\n")
    (tmp_path / "skip.txt").write_text("")
    (tmp_path / "package.json").write_text('{"dependencies": {"left": "1"}, "devDependencies": {"right": "1"}}')
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {"paths": {"@app/*": ["x"],}} }')
    (tmp_path / "a b" / "Cargo.toml").write_text('[package]\nname = "my-lib"\n[dev-dependencies]\nserde = "1"\n')
    got = {(r["path"], r["lang"]) for r in tree.files(spark, str(tmp_path)).collect()}
    assert got == {("a b/x.rs", "rust"), ("y.ts", "typescript")}
    assert tree.files(spark, str(tmp_path), ["**/*.ts"]).count() == 1
    deps = {tuple(r) for r in tree.manifests(spark, str(tmp_path)).collect()}
    assert deps == {("", "typescript", "left", "normal"), ("", "typescript", "right", "dev"), ("", "alias", "@app/*", None), ("a b", "rust", "my_lib", "own"), ("a b", "rust", "serde", "dev")}
    items = spark.createDataFrame([("a b/x.rs",), ("y.ts",)], "path string")
    near = {r["path"]: r["dir"] for r in resolution.nearest(items, spark.createDataFrame([("",), ("a b",)], "dir string")).collect()}
    assert near == {"a b/x.rs": "a b", "y.ts": ""}


def test_changed_files(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.rs").write_text("1")
    (tmp_path / "b.rs").write_text("1")
    run("add", "."), run("commit", "-m", "x")
    (tmp_path / "a.rs").write_text("2")
    (tmp_path / "c.rs").write_text("2")
    assert [r["path"] for r in tree.changed(spark, str(tmp_path)).collect()] == ["a.rs"]


def test_reports(spark, tmp_path):
    ls = lines.lines(files(spark, ("f", "x", "ab <&>\nab")))
    found = findings.scan(ls, [R.Rule("r", "error", "slop", "m", pattern="ab.*")])
    sinks.write_lines(sinks.json_rows(found), str(tmp_path / "out"))
    got = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [g["line"] for g in got] == [1, 2]
    assert "&lt;&amp;&gt;" in sinks.html_rows(found).orderBy("line").first()["report"]
    assert json.loads(sinks.sarif_head(R.TEXT_RULES))["version"] == "2.1.0"
    assert json.loads(sinks.sarif_results(found).first()["report"])["ruleIndex"] == 0


def test_stream_sees_each_file_once(spark, tmp_path):
    source = str(tmp_path / "in" / "t")
    seen = []
    sample = spark.createDataFrame([("f", "text")], "path string, text string")
    each = lambda df, n: seen.append(sorted(r["path"] for r in df.collect()))
    sample.write.parquet(source)
    incremental.run_once(incremental.stream(spark, str(tmp_path / "in"), "t", sample), each, str(tmp_path / "state"))
    spark.createDataFrame([("g", "x")], "path string, text string").write.mode("append").parquet(source)
    incremental.run_once(incremental.stream(spark, str(tmp_path / "in"), "t", sample), each, str(tmp_path / "state"))
    assert seen == [["f"], ["g"]]


SAMPLE = """use std::fmt;
/// The function is é etc.
pub fn a(x: Option<u8>) -> u8 { x.unwrap() } // TODO é — later
/* first
   FIXME */ let t = "ghp_%s"; let u = ".unwrap()"; dbg!(t);
// hopefully fine
#[cfg(test)]
mod tests {
    fn b() { x.unwrap(); } // TODO not here
}
fn c() { let _ = d(); let _ = s.send(1); }
""" % ("a" * 36)


def test_code_rules(spark):
    from corpusmill.plans.code_rules import CODE_RULES

    ts = "// scan\nconst a: any = b as unknown as C; // TODO x\nconst q = `SELECT ${a}`; s.sort(); jest.mock('./x'); eval(q); 'eval('\n"
    df = files(spark, ("src/a.rs", "rust", SAMPLE), ("src/b.ts", "typescript", ts), ("tests/a.rs", "rust", SAMPLE))
    rules = R.active(CODE_RULES)
    rows = code.scan_code(df, rules).collect()
    got = {(r["path"], r["rule_id"], r["line"]) for r in rows}
    rust = {("open-task", 3), ("open-task", 5), ("vague-doc", 2), ("doc-opens-with-kind", 2), ("unwrap", 3), ("dash-in-comment", 3), ("cloud-token", 5), ("debug-macro", 5), ("hedged-comment", 6), ("dropped-result", 11)}
    # A line with an exempt call is exempt as a whole.
    assert {(i, n) for p, i, n in got if p == "src/a.rs"} == rust - {("dropped-result", 11)}
    assert {(i, n) for p, i, n in got if p == "src/b.ts"} == {("any-type", 2), ("double-cast", 2), ("open-task", 2), ("query-by-text", 3), ("plain-sort", 3), ("local-mock", 3), ("evaluated-text", 3)}
    assert {i for p, i, _ in got if p == "tests/a.rs"} == {"vague-doc", "doc-opens-with-kind"}
    for r in rows:  # every place is where the text is, in bytes
        text = next(t for p, t in (("src/a.rs", SAMPLE), ("src/b.ts", ts), ("tests/a.rs", SAMPLE)) if p == r["path"])
        line = text.split("\n")[r["line"] - 1].encode()
        assert line[r["column"] - 1 : r["end_column"] - 1].decode() == r["matched_text"], r


def test_code_metrics(spark):
    from corpusmill.plans.code_rules import CODE_RULES

    long = "".join(f"fn f{i}() {{}}\n" for i in range(31)) + "// x\n" * 30 + "let s = 1;\n" * 480
    wordy = "// a\n" * 20 + "/// doc\n" * 5 + "fn a() {}\n" * 10
    df = files(spark, ("src/a.rs", "rust", long), ("src/b.rs", "rust", wordy))
    got = {(r["path"], r["rule_id"]): r["matched_text"] for r in code.scan_code(df, [r for r in CODE_RULES if r.metric]).collect()}
    assert got == {("src/a.rs", "long-file"): "511 code lines", ("src/a.rs", "many-functions"): "31 function count", ("src/b.rs", "mostly-comments"): "0.57 comment ratio"}
