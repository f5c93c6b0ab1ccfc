"""Facts of a file meet within its row: the same as by joins, without a shuffle, and its tokens are made once."""

import time

from corpusmill.operators import blocks, code, facts
from corpusmill.operators.tokens import brackets
from corpusmill.plans.code_rules import CODE_RULES

TEXT = """use a::b; fn one() { two(1); if x { v.three::<u8>(2) } fn inner() { mac![four(3)] } five() }
/* fn no() { */ #[test] fn checks() { assert!(six('}')); } outside();
#[ cfg(test) ]
mod tests { fn t() { a.unwrap(); } // TODO in tests
}
fn last() { b.unwrap() } // TODO é { x
#[cfg(test)]
"""
SCHEMA = "path string, lang string, text string"


def rows(spark):
    return spark.createDataFrame([("a.rs", "rust", TEXT), ("b.rs", "rust", TEXT.replace("\n", "\r\n")), ("c.rs", "rust", ""), ("d.ts", "typescript", TEXT), ("e", None, TEXT), ("f.rs", "rust", None)], SCHEMA)


def test_calls_and_owners_as_by_joins(spark):
    t = code.token_arrays(rows(spark)).cache()
    tree = blocks.block_tree(t).cache()
    assert "Exchange" not in facts.owned_calls(t)._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, facts.owned_calls(t).collect()))
    assert got == sorted(map(tuple, facts.owned_calls(t, tree).collect()))
    told = {("checks", "assert"), ("checks", "six"), ("inner", "four"), ("inner", "mac"), ("one", "five"), ("one", "three"), ("one", "two"), ("t", "unwrap"), ("last", "unwrap")}
    assert {(x[1], x[3]) for x in got if x[0] == "a.rs"} == told
    files = facts.file_facts(t)
    assert sorted(map(tuple, facts.each(files, "functions").collect())) == sorted(map(tuple, facts.functions(tree).collect()))
    assert sorted(map(str, facts.each(files, "blocks").collect())) == sorted(map(str, tree.drop("lang").collect()))


def test_a_scan_reads_each_file_once_a_kind_of_rule(spark):
    rules = [r for r in CODE_RULES if r.id in ("open-task", "unwrap")]
    found = code.scan_code(rows(spark), rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    got = sorted((r["path"], r["rule_id"], r["line"], r["column"]) for r in found.collect())
    line = "fn last() { b.unwrap() } // TODO"
    own = [("open-task", 6, len(line) - 3), ("unwrap", 6, line.index(".unwrap") + 1)]
    assert got == [("a.rs", *x) for x in own] + [("b.rs", *x) for x in own] + [("d.ts", "open-task", 4, TEXT.split("\n")[3].index("TODO") + 1), ("d.ts", "open-task", 6, len(line) - 3)]


def test_brackets_that_nothing_closes(spark):
    n, began = 20_000, time.time()
    pair, inner, _ = brackets("(" * n + "}" * n)
    assert set(pair) == {-1} and inner[-1] == n - 1 and time.time() - began < 4
