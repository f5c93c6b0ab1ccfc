"""Source code as tokens and blocks, by DataFrame functions.

One regular expression with an alternative for every kind of token splits a file
without a gap, so that places follow from running sums of lengths (``tokens``). Blocks
come from matching brackets. This serves rules on comments, strings and lines of
code, metrics, test ranges and declarations; it is no syntax tree. What is worked out
per file stays in its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let, split_lines
from corpusmill.operators.findings import normalised, scan, scan_files
from corpusmill.operators import tokens as token_rows
from corpusmill.operators.metrics import file_metrics, metric_findings
from corpusmill.plans.rules import Rule
from corpusmill.shared import written

#: Kinds of tokens, in the order in which they are tried.
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
RAW_STRING = r'r#"[^"]*+(?:"(?!#)[^"]*+)*+"#|r"[^"]*+"'
STRING = r'b?"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
CHAR = r"'(?:\\[^\n']{1,8}|[^'\\\n])'"
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
WORD = r"[\p{L}\p{N}_]++"
REST = r"[\s\S]"


def token_pattern(lang: str) -> str:
    strings = [RAW_STRING, STRING, CHAR] if lang == "rust" else [STRING, SINGLE, TEMPLATE]
    return "|".join([LINE_COMMENT, BLOCK_COMMENT, *strings, WORD, r"[ \t\r]++", REST])


def token_arrays(files: DataFrame) -> DataFrame:
    """(path, lang, text, tokens): see ``tokens``."""
    return token_rows.token_arrays(files, token_pattern)


def tokens(files: DataFrame) -> DataFrame:
    """(path, lang, i, kind, text, line, column, end_line, depth): a row per token, ``column`` in
    bytes from 1 on, ``depth`` the braces open before the token."""
    t = token_arrays(files).select("path", "lang", F.explode_outer("tokens").alias("t")).where("t is not null")
    kind = F.when(F.col("t.kind").isin("word", "sign", "blank"), "code").otherwise(F.col("t.kind"))
    return t.select("path", "lang", "t.i", kind.alias("kind"), *[f"t.{c}" for c in ("text", "line", "column", "end_line", "depth")])


def _blank(text: Column) -> Column:
    """As many blanks as the text has bytes, its line ends kept."""
    for chars, width in ((r"[\x{80}-\x{7FF}]", 2), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{10000}-\x{10FFFF}]", 4)):
        text = F.regexp_replace(text, chars, " " * width)
    return F.regexp_replace(text, r"[^\n]", " ")


def _plain(tokens: Column) -> Column:
    """A file's text with comments and what is in strings as blanks."""

    def shown(x: Column) -> Column:
        inner = F.concat(F.substring(x["text"], 1, 1), _blank(F.substring(x["text"], F.lit(2), F.length(x["text"]) - 2)), F.substring(x["text"], -1, 1))
        return F.when(x["kind"].isin("word", "sign", "blank"), x["text"]).when(x["kind"] == "string", inner).otherwise(_blank(x["text"]))

    return F.array_join(F.transform(tokens, shown), "")


def blanked(t: DataFrame) -> DataFrame:
    """(path, lang, text) of token arrays: the files with comments and what is in strings as
    blanks; lines and byte columns stay."""
    return t.withColumn("text", _plain(F.col("tokens"))).drop("tokens")


def _in_tokens(t: DataFrame, kind: str, rules: Sequence[Rule]) -> DataFrame:
    """Matches within tokens of a kind, at their places in the file; ``tests`` stays."""
    own = F.filter("tokens", lambda x: x["kind"] == kind)
    rows = t.select("path", "lang", "tests", F.explode_outer(own).alias("x")).where("x is not null").select("path", "lang", "tests", "x.line", "x.text", "x.column")
    found = scan(rows.select("path", "lang", "tests", F.struct("line", "column", "text").alias("token"), "text", F.lit(0).cast("long").alias("line")), rules, keep=("token", "tests"))
    before = F.decode(F.substring(F.encode("token.text", "UTF-8"), F.lit(1), (F.col("column") - 1).cast("int")), "UTF-8")
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    shift = F.when(breaks == 0, F.col("token.column") - 1 + F.octet_length(before)).otherwise(F.octet_length(F.substring_index(before, "\n", -1)))
    size = F.col("end_column") - F.col("column")
    out = found.withColumn("shift", shift).withColumn("line", F.col("token.line") + breaks).withColumn("end_column", F.col("shift") + 1 + size).withColumn("column", F.col("shift") + 1)
    return out.drop("token", "shift")


def scan_code(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of all rules over source files, each kind of rule on what it looks at.
    The files are tokenised once; what the rules look at is written in the shared folder, a row per
    file, with the ranges of its tests. Rules that skip tests also skip lines in ``#[cfg(test)]`` items."""
    kinds = {r.kind for r in rules if r.pattern}
    measured = any(r.metric for r in rules)
    wanted = [k for k in ("comment", "doc_comment", "string") if k in kinds]
    tokens = F.col("tokens")
    kept = tokens if measured else F.filter(tokens, lambda x: x["kind"].isin(wanted)) if wanted else F.slice(tokens, 1, 0)
    text = ["text"] if measured or "line" in kinds else []
    told = token_arrays(files).select("path", "lang", *text, let(_plain(tokens), lambda p: F.struct(p.alias("plain"), _test_array(p, tokens).alias("tests"))).alias("p"), kept.alias("tokens"))
    t = written(told.select("path", "lang", *text, "p.plain", "p.tests", "tokens"))
    keep = ["path", "lang", "rule_id", "severity", "category", "message", "line", "column", "end_column", "matched_text", "seq", "tests"]
    parts = []
    for kind in ("comment", "doc_comment", "string", "code", "line"):
        if own := [r for r in rules if r.pattern and r.kind == kind]:
            parts.append(_in_tokens(t, kind, own) if kind in wanted else scan_files(t.select("path", "lang", "tests", F.col("plain" if kind == "code" else "text").alias("text")), own))
    skips = lambda r: r.skip_tests and r.language == "rust"
    if measured:
        whole, tests = t.select("path", "lang", "text", "tokens"), t.select("path", F.explode("tests").alias("r")).select("path", "r.*")
        for skipped, own in ((tests, [r for r in rules if r.metric and skips(r)]), (None, [r for r in rules if r.metric and not skips(r)])):
            if own:
                found = metric_findings(code_metrics(files, whole, skipped), own)
                found = found.withColumn("end_column", F.lit(1).cast("long")).withColumn("seq", F.lit(0).cast("long"))
                parts.append(found.join(t.select("path", "tests"), "path", "left"))
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    skipping = [r.id for r in rules if skips(r) and r.pattern]
    in_test = F.exists("tests", lambda r: (F.col("line") >= r["start"]) & (F.col("line") < r["end_excl"]))
    skipped = F.col("rule_id").isin(skipping) & F.col("lang").eqNullSafe("rust") & F.coalesce(in_test, F.lit(False))
    return normalised(out.where(~skipped).drop("tests"))


def _lines_of(kinds: Sequence[str]) -> Column:
    """The distinct lines that hold tokens of these kinds, but those in skipped ranges."""
    own = F.filter("tokens", lambda x: x["kind"].isin(*kinds) & x["text"].rlike(r"[^ \t\r\n\f]"))
    each = F.array_distinct(F.flatten(F.transform(own, lambda x: F.sequence(x["line"], x["end_line"]))))
    return F.filter(each, lambda n: ~F.exists("skip", lambda r: (n >= r["start"]) & (n < r["end_excl"])))


def code_metrics(files: DataFrame, t: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Metrics of source files from their token arrays ``t``; lines in ``skipped`` ranges
    (path, start, end_excl), as those of tests, don't count. Lines of code have something other than
    comments; lines of comments are those that document nothing."""
    none = F.array().cast("array<struct<start:bigint,end_excl:bigint>>")
    if skipped is None:
        rows = t.withColumn("skip", none)
    else:
        per_file = skipped.groupBy("path").agg(F.collect_list(F.struct("start", "end_excl")).alias("skip"))
        rows = t.join(per_file, "path", "left").withColumn("skip", F.coalesce("skip", none))
    remarks = F.array_except(_lines_of(["comment"]), _lines_of(["doc_comment"]))
    count = lambda c, name: F.size(c).cast("long").alias(name)
    counted = rows.select("path", "lang", "text", "tokens", "skip", count(_lines_of(["word", "sign", "string"]), "own_code"), count(remarks, "own_remarks"))
    out = file_metrics(blanked(counted), r"^\b$", "skip", ("own_code", "own_remarks")).drop("code_lines", "comment_lines", "comment_ratio")
    ratio = F.when(F.col("file_lines") > 0, F.col("own_remarks") / F.col("file_lines")).otherwise(0.0)
    return out.withColumn("comment_ratio", ratio).withColumnsRenamed({"own_code": "code_lines", "own_remarks": "comment_lines"})


def _brace_array(tokens: Column) -> Column:
    opened = F.filter(tokens, lambda x: (x["kind"] == "sign") & (x["text"] == "{") & (x["pair"] >= 0))
    return F.transform(opened, lambda x: F.struct(x["depth"].alias("depth"), x["line"].alias("start"), F.get(tokens, x["pair"])["line"].alias("end"), x["i"].alias("start_i"), x["pair"].alias("end_i")))


def blocks(t: DataFrame) -> DataFrame:
    """(path, depth, start, end, start_i, end_i): lines and tokens of each pair of braces."""
    return t.select("path", F.explode_outer(_brace_array(F.col("tokens"))).alias("b")).where("b is not null").select("path", "b.*")


def _is_mark(text: Column) -> Column:
    return text.contains("#") & (F.regexp_replace(text, r"\s", "") == "#[cfg(test)]")


def _test_array(plain: Column, tokens: Column) -> Column:
    """The ranges of ``test_ranges`` within a file's row."""
    marked = F.transform(split_lines(plain), lambda x, i: F.when(_is_mark(x), (i + 1).cast("long")))
    marks = F.filter(marked, lambda n: n.isNotNull())

    def ranges(braces: Column) -> Column:
        after = lambda m: F.get(F.filter(braces, lambda b: b["start"] >= m), F.lit(0))
        return F.filter(F.transform(marks, lambda m: F.struct(m.alias("start"), (after(m)["end"] + 1).alias("end_excl"))), lambda r: r["end_excl"].isNotNull())

    # Most files have no mark.
    return F.when(plain.contains("#"), let(_brace_array(tokens), ranges)).otherwise(F.array().cast("array<struct<start:bigint,end_excl:bigint>>"))


def test_ranges(code_lines: DataFrame, b: DataFrame) -> DataFrame:
    """(path, start, end_excl): from a ``#[cfg(test)]`` line through the first block
    that opens at or after it."""
    marks = code_lines.where(_is_mark(F.col("text"))).select("path", F.col("line").alias("mark"))
    after = marks.join(b, "path").where("start >= mark").groupBy("path", "mark").agg(F.min(F.struct("start_i", "end")).alias("b"))
    return after.select("path", F.col("mark").alias("start"), (F.col("b.end") + 1).alias("end_excl"))


def symbols(code_lines: DataFrame) -> DataFrame:
    """(path, line, kind, name, of): traits, their implementations, types, functions
    and imports, from lines of blanked code."""
    kinds = {
        "trait": (r"\btrait\s+(\w+)", r"()"),
        "impl": (r"\bimpl(?:<[^>]*>)?\s+(?:[\w:]+::)?(\w+)(?:<[^>]*>)?\s+for\s", r"\sfor\s+&?(?:[\w:]+::)?(\w+)"),
        "type": (r"\b(?:struct|enum|union)\s+(\w+)", r"()"),
        "function": (r"\bfn\s+(\w+)", r"()"),
        "use": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:::)?(\w+)", r"\buse\s+([\w:]+)"),
        "mod": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", r"()"),
    }
    each = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", q, 1).alias("of"))) for k, (p, q) in kinds.items()])
    return code_lines.select("path", "line", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("s")).select("path", "line", "s.*")
