"""Reports: rows of findings as text, JSON, SARIF and HTML.

Bodies are built by DataFrame expressions, a string per finding, and written by
Spark; only heads and totals, which don't grow with the findings, are made on the
driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import escape_html
from corpusmill.operators.findings import severities
from corpusmill.plans.rules import Rule

ORDER = ("path", "line", "column", "rule_id")


def text_rows(findings: DataFrame) -> DataFrame:
    row = F.format_string("%s:%d:%d: %s: %s [%s]", "path", "line", "column", "severity", "message", "rule_id")
    return findings.select(*ORDER, row.alias("report"))


def json_rows(findings: DataFrame) -> DataFrame:
    """A JSON object per finding; fields that are null are left out."""
    return findings.select(*ORDER, F.to_json(F.struct("rule_id", "severity", "category", "message", "path", "line", "column", "matched_text")).alias("report"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result per finding; ``ruleIndex`` numbers rules by first appearance."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct(*ORDER[:3])).alias("first"))
    index = first.select("rule_id", (F.row_number().over(Window.orderBy("first", "rule_id")) - 1).alias("rule_index"))  # a row per rule
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.join(F.broadcast(index), "rule_id").select(*ORDER, "rule_index", F.to_json(result).alias("report"))


def sarif_head(rules: Sequence[Rule], name: str = "corpusmill") -> str:
    told = [{"id": r.id, "shortDescription": {"text": r.message}, "defaultConfiguration": {"level": r.severity}} for r in rules]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": name, "rules": told}}, "results": []}]})


def html_rows(findings: DataFrame, most: int = 2000) -> DataFrame:
    """Table rows, errors first, snippets cut to ``most`` characters."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>"))
    snippet = F.when(F.length("matched_text") > most, F.concat(F.substring("matched_text", 1, most), F.lit("..."))).otherwise(F.col("matched_text"))
    cells = F.concat(F.lit("<tr>"), *[cell(x) for x in (F.col("severity"), F.concat_ws(":", "path", F.col("line").cast("string"), F.col("column").cast("string")), F.col("message"), snippet)], F.lit("</tr>"))
    return findings.select(F.when(F.col("severity") == "error", 0).otherwise(1).alias("rank"), *ORDER, cells.alias("report"))


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Reports as text files in order, file after file."""
    rows.repartitionByRange(*(order or ORDER)).sortWithinPartitions(*(order or ORDER)).select("report").write.text(path)


def summary(findings: DataFrame) -> dict:
    return severities(findings).first().asDict()
