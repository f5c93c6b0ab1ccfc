"""Metrics of whole files and the findings they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import interpolate, line_count, split_lines
from corpusmill.operators.findings import where_applies
from corpusmill.plans.rules import Rule

REMARK = r"^\s*(//|#)"
BLANK = r"^[ \t\r\f]*$"
IMPORT = r"^\s*(pub\s+)?(use\s+[\w:{]|extern\s+crate\s|import\s)"
FUNCTION = r"\bfn\s+\w+|\bfunction\b|=>"


def file_metrics(files: DataFrame, remark: str = REMARK, skip: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(path, lang, file_lines, code_lines, comment_lines, comment_ratio,
    import_count, function_count), computed within each row. ``skip`` names an
    array column of ranges (start, end_excl) of lines that don't count; columns named in ``keep`` stay."""
    lines = split_lines(F.col("text"))
    if skip:
        numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
        lines = F.transform(F.filter(numbered, lambda s: ~F.exists(skip, lambda r: (s["n"] >= r["start"]) & (s["n"] < r["end_excl"]))), lambda s: s["x"])
    rows = files.select("path", "lang", *keep, lines.alias("ls"), line_count(F.col("text")).alias("all_lines"))
    count = lambda test: F.size(F.filter("ls", test)).cast("long")
    n = F.size("ls").cast("long")
    remarks = count(lambda x: x.rlike(remark))
    return rows.select(
        "path", "lang", *keep, "all_lines", n.alias("file_lines"),
        count(lambda x: ~x.rlike(BLANK) & ~x.rlike(remark)).alias("code_lines"),
        remarks.alias("comment_lines"),
        F.when(n > 0, remarks / n).otherwise(0.0).alias("comment_ratio"),
        count(lambda x: x.rlike(IMPORT)).alias("import_count"),
        F.aggregate("ls", F.lit(0).cast("long"), lambda s, x: s + F.regexp_count(x, F.lit(FUNCTION))).alias("function_count"),
    )


def shown(metric: str, value: Column) -> Column:
    return F.format_string("%.2f", value) if metric == "comment_ratio" else value.cast("long").cast("string")


def metric_findings(metrics: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A finding at the start of each file whose metric exceeds a rule's threshold,
    if the file has the rule's least number of lines."""
    wanted = [r for r in rules if r.metric]
    each = [
        F.when(where_applies(r) & (F.col(r.metric) > r.threshold) & (F.col("all_lines") >= r.min_lines),
               F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"),
                        interpolate(F.lit(r.message), value=shown(r.metric, F.col(r.metric))).alias("message"), F.col(r.metric).cast("double").alias("value"),
                        F.concat(shown(r.metric, F.col(r.metric)), F.lit(" " + r.metric.replace("_", " "))).alias("matched_text")))
        for r in wanted
    ]
    rows = metrics.select("path", "lang", F.explode_outer(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f")).where("f is not null")
    return rows.select("path", "lang", "f.*", F.lit(1).cast("long").alias("line"), F.lit(1).cast("long").alias("column"))
