"""From lines to findings, and what is done with findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import TEST_PATHS, byte_column, glob_regex, keyed, matches, split_lines
from corpusmill.plans.literals import one_of, required
from corpusmill.plans.rules import Rule

KEY = ("rule_id", "path", "line", "column")
#: Rules that are passed by together, and from how many required strings on they are looked up in one pass.
BLOCK, INDEXED = 16, 24


def _text(x: str | None) -> str:
    """A string in SQL."""
    return "CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _where_applies(rule: Rule) -> str:
    out = ["true" if rule.language is None else f"lang = {_text(rule.language)}"]
    if rule.files:
        out.append(f"path RLIKE {_text('|'.join(map(glob_regex, rule.files)))}")
    if rule.ignores:
        out.append(f"NOT path RLIKE {_text('|'.join(map(glob_regex, rule.ignores)))}")
    if rule.skip_tests:
        out += [f"NOT path RLIKE {_text(x)}" for x in TEST_PATHS]
    return " AND ".join(out)


def where_applies(rule: Rule) -> Column:
    """The files that a rule looks at."""
    return F.expr(_where_applies(rule))


def _of_rule(found: Column, i: Column) -> Column:
    return F.transform(found, lambda m: F.struct(i.alias("rule"), m["at"].alias("at"), m["text"].alias("text")))


def _with_patterns(rules: Sequence[Rule]) -> list[Rule]:
    rules = [r for r in rules if r.pattern]
    if not rules:
        raise ValueError("no rule with a pattern")
    return rules


def _holds(text: str, rule: Rule) -> str:
    """Whether the text has a string without which the rule can't match."""
    return "(" + " OR ".join(f"contains({text}, {_text(x)})" for x in required(rule.pattern) or ()) + ")" if required(rule.pattern) else "true"


def _index(rules: Sequence[Rule]) -> list[str]:
    """The required strings that are looked up all at once: those of several characters, if there
    are many."""
    out = sorted({x for r in rules for x in required(r.pattern) or () if len(x) > 1})
    return out if len(out) > INDEXED else []


def _applies(rules: Sequence[Rule], index: Sequence[str]) -> Column:
    """Per rule, whether it looks at the file and may find something in its text. ``_present`` has, of the
    strings of the index, the longest at every place; it has those in it that it contains."""
    out = []
    for r in rules:
        strings = required(r.pattern) or ()
        if strings and index and all(len(x) > 1 for x in strings):
            held = f"arrays_overlap(_present, array({', '.join(_text(y) for y in index if any(x in y for x in strings))}))"
        else:
            held = _holds("text", r)
        out.append(f"coalesce({_where_applies(r)} AND {held}, false)")
    return F.expr(f"array({', '.join(out)})")


def _hits(text: str, rules: Sequence[Rule]) -> str:
    """The rules, by number, that match in a line. A line is searched for a rule's pattern only if the
    file and the line have one of its required strings."""
    blocks = []
    for k in range(0, len(rules), BLOCK):
        own = [f"CASE WHEN _on[{i}] AND {_holds(text, r)} AND {text} RLIKE {_text(r.pattern)}{f' AND NOT {text} RLIKE {_text(r.unless)}' if r.unless else ''} THEN {i} END" for i, r in enumerate(rules[k : k + BLOCK], k)]
        blocks.append(f"CASE WHEN _some[{k // BLOCK}] THEN array({', '.join(own)}) END")
    return f"array_compact(flatten(array_compact(array({', '.join(blocks)}))))"


def _with_rules(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` with ``_on``, a flag per rule, and ``_some``, one per block of them."""
    index = _index(rules)
    present = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?=({one_of(index)}))"), F.lit(1))) if index else F.array().cast("array<string>")
    told = rows.withColumn("_present", present).withColumn("_on", _applies(rules, index)).drop("_present")
    return told.withColumn("_some", F.array(*[F.array_contains(F.slice("_on", k + 1, BLOCK), True) for k in range(0, len(rules), BLOCK)]))


def _found(text: Column, hits: Column, rules: Sequence[Rule]) -> Column:
    """(rule, at, text) of every match in a line, for the rules that match."""
    patterns = F.expr(f"array({', '.join(_text(r.pattern) for r in rules)})")
    return F.flatten(F.transform(hits, lambda i: _of_rule(matches(text, F.element_at(patterns, i + 1)), i)))


def _told(rules: Sequence[Rule]) -> Column:
    names = ("rule_id", "severity", "category", "message")
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {_text(v)}" for n, v in zip(names, (r.id, r.severity, r.category, r.message))) + ")" for r in rules) + ")")


def _finding(line: Column, text: Column, m: Column, rules: Sequence[Rule], *more: Column) -> Column:
    r = F.element_at(_told(rules), m["rule"] + 1)
    return F.struct(
        *[r[c].alias(c) for c in ("rule_id", "severity", "category", "message")], line.cast("long").alias("line"), byte_column(text, m["at"]).alias("column"),
        byte_column(text, m["at"] + F.length(m["text"])).alias("end_column"), m["text"].alias("matched_text"), (line * len(rules) + m["rule"]).cast("long").alias("seq"), *more,
    )


def file_findings(files: DataFrame, rules: Sequence[Rule], context: int | None = None, region: int | None = None) -> DataFrame:
    """``files`` with the text replaced by ``findings``, an array of all matches of all
    rules; within a row, so nothing is shuffled. ``seq`` is the place of a finding in its
    file, by line and rule. ``context`` asks for the trimmed lines within that many
    lines, joined by line ends, ``region`` for the lines with their numbers; both are cut
    out where the finding is made, while the file's lines are at hand."""
    rules = _with_patterns(rules)
    rest = [c for c in files.columns if c != "text"]
    rows = _with_rules(files, rules).select(*rest, split_lines(F.col("text")).alias("_lines"), "_on", "_some")
    rows = rows.select(*rest, "_lines", F.expr(f"transform(_lines, x -> {_hits('x', rules)})").alias("_hits"))

    def around(line: Column, reach: int, show) -> Column:
        low = F.greatest(line - reach, F.lit(1)).cast("int")
        return F.array_join(F.transform(F.slice("_lines", low, (line + reach - low + 1).cast("int")), lambda x, i: show(x, low + i)), "\n")

    def of_line(s: Column) -> Column:
        more = [] if context is None else [around(s["line"], context, lambda x, n: F.trim(x)).alias("context")]
        more += [] if region is None else [around(s["line"], region, lambda x, n: F.concat(n.cast("string"), F.lit(": "), x)).alias("region")]
        return F.transform(_found(s["text"], s["hits"], rules), lambda m: _finding(s["line"], s["text"], m, rules, *more))

    # Zipped, since a column used within a function of each line would be worked out for each of them.
    paired = F.zip_with("_lines", "_hits", lambda x, h: F.struct(x.alias("text"), h.alias("hits")))
    numbered = F.transform(paired, lambda s, i: F.struct((i + 1).cast("long").alias("line"), s["text"].alias("text"), s["hits"].alias("hits")))
    return rows.select(*rest, F.flatten(F.transform(F.filter(numbered, lambda s: F.size(s["hits"]) > 0), of_line)).alias("findings"))


def scan_files(files: DataFrame, rules: Sequence[Rule], context: int | None = None, region: int | None = None) -> DataFrame:
    """A row per finding: the columns of ``files`` but the text, and rule_id, severity,
    category, message, line, column, end_column, matched_text, seq, and what is asked for."""
    found = file_findings(files, rules, context, region)
    rest = [c for c in found.columns if c != "findings"]
    # From explode Spark infers a filter on the array's size below it, which would scan every file once more.
    return found.select(*rest, F.explode_outer("findings").alias("f")).where("f is not null").select(*rest, "f.*")


def scan(all_lines: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """As ``scan_files``, from rows (path, lang, line, text) of lines or of tokens.
    Columns named in ``keep`` stay."""
    rules = _with_patterns(rules)
    text = F.col("text")
    rows = _with_rules(all_lines, rules).where(F.array_contains("_on", True)).withColumn("_hits", F.expr(_hits("text", rules)))
    rows = rows.select("path", "lang", *keep, F.explode_outer(F.transform(_found(text, F.col("_hits"), rules), lambda m: _finding(F.col("line"), text, m, rules))).alias("f"))
    return rows.where("f is not null").select("path", "lang", "f.*", *keep)


def normalised(findings: DataFrame) -> DataFrame:
    """Of findings of one rule at one place the first emitted stays."""
    first = Window.partitionBy(*KEY).orderBy("seq", "matched_text")
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings that no directive of the line above switches off; a directive
    without a rule is for all."""
    d = directives.select(F.col("path").alias("d_path"), F.col("target_line").alias("d_line"), F.col("rule_id").alias("d_rule"))
    on = (F.col("path") == F.col("d_path")) & (F.col("line") == F.col("d_line")) & (F.col("d_rule").isNull() | (F.col("d_rule") == F.col("rule_id")))
    return findings.join(d, on, "left_anti")


def unused_directives(directives: DataFrame, findings: DataFrame) -> DataFrame:
    """Directives that switch nothing off."""
    f = findings.select(F.col("path").alias("f_path"), F.col("line").alias("f_line"), F.col("rule_id").alias("f_rule"))
    on = (F.col("path") == F.col("f_path")) & (F.col("target_line") == F.col("f_line")) & (F.col("rule_id").isNull() | (F.col("rule_id") == F.col("f_rule")))
    left = directives.join(f, on, "left_anti")
    return left.withColumn("end_column", F.length("comment") + 1)


def outside(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose line is in no range [start, end_excl) of their file."""
    r = ranges.select(F.col("path").alias("r_path"), "start", "end_excl")
    return findings.join(r, (F.col("path") == F.col("r_path")) & (F.col("line") >= F.col("start")) & (F.col("line") < F.col("end_excl")), "left_anti")


def inside(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    r = ranges.select(F.col("path").alias("r_path"), "start", "end_excl")
    return findings.join(r, (F.col("path") == F.col("r_path")) & (F.col("line") >= F.col("start")) & (F.col("line") < F.col("end_excl")), "left_semi")


def escalated(findings: DataFrame, default: int = 5, per_rule: dict[str, int] | None = None) -> DataFrame:
    """Warnings of a rule that has as many findings in a file as its threshold
    become errors. Counts come from an aggregate, so that a file or rule with very
    many findings is summed where they are."""
    limit = F.lit(max(1, default))
    for rule, n in (per_rule or {}).items():
        limit = F.when(F.col("rule_id") == rule, max(1, n)).otherwise(limit)
    many = findings.groupBy("path", "rule_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= limit)
    out = findings.join(many, ["path", "rule_id"], "left")
    raised = F.col("_n").isNotNull() & (F.col("severity") == "warning")
    return out.withColumn("escalated", raised).withColumn("severity", F.when(raised, "error").otherwise(F.col("severity"))).drop("_n")


def hashed(findings: DataFrame) -> DataFrame:
    """Adds ``hash``: of rule, path, matched text and context, but not of the line,
    so that findings keep it when text above them moves. Wants ``context``."""
    return findings.withColumn("hash", keyed(F.col("rule_id"), F.col("path"), F.trim("matched_text"), F.col("context")))


def baseline_of(findings: DataFrame) -> DataFrame:
    """A row per finding: a baseline is a multiset."""
    return findings.select("hash", "rule_id", "path").orderBy("path", "rule_id", "hash")


BASELINE_VERSION = 1


def write_baseline(findings: DataFrame, path: str) -> None:
    """A baseline as JSON lines, each with the format's version; in files, for a
    repository of any size."""
    baseline_of(findings).select(F.lit(BASELINE_VERSION).alias("version"), "hash", "rule_id", "path").write.json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(hash, rule_id, path) of a written baseline; another version's is refused, as its
    hashes may be of other things."""
    rows = spark.read.schema("version int, hash string, rule_id string, path string").json(path)
    if other := rows.where(~F.col("version").eqNullSafe(BASELINE_VERSION)).take(1):
        raise ValueError(f"a baseline of version {other[0]['version']}; this reads version {BASELINE_VERSION}")
    return rows.drop("version")


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiset difference: of equal hashes, as many are dropped as the baseline
    holds, the first by place."""
    held = baseline.groupBy(F.col("hash").alias("_h")).agg(F.count("*").alias("_held"))
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("path", "line", "column"))
    marked = findings.withColumn("_nth", nth).join(held, F.col("hash") == F.col("_h"), "left")
    return marked.where(F.col("_nth") > F.coalesce("_held", F.lit(0))).drop("_nth", "_h", "_held")


def tally(findings: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(key, n) for every key, also those without a finding."""
    spark = findings.sparkSession
    all_keys = spark.createDataFrame([(k,) for k in keys], "key string")
    counts = findings.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return F.broadcast(all_keys).join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def top(findings: DataFrame, column: str, k: int) -> DataFrame:
    return findings.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def severities(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("findings"))


def with_rules(findings: DataFrame, catalog: DataFrame, *columns: str) -> DataFrame:
    """Joins rule columns, the rule of the finding's language before one of any."""
    own = catalog.select(F.col("rule_id").alias("o_id"), F.col("language").alias("o_lang"), *[F.col(c).alias(f"o_{c}") for c in columns])
    any_ = catalog.groupBy(F.col("rule_id").alias("a_id")).agg(*[F.min_by(c, "language").alias(f"a_{c}") for c in columns])
    out = findings.join(F.broadcast(own), (F.col("rule_id") == F.col("o_id")) & (F.col("lang") == F.col("o_lang")), "left").join(F.broadcast(any_), F.col("rule_id") == F.col("a_id"), "left")
    return out.select(*findings.columns, *[F.coalesce(f"o_{c}", f"a_{c}").alias(f"rule_{c}") for c in columns])
