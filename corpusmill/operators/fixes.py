"""Rewrites: edits by rule, chosen so that they don't overlap, applied per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.rules import Rule


def edits(findings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(path, line, start, end, inserted, rule_id): byte columns from 1 on, the end
    exclusive, for findings whose rule has a replacement."""
    new = F.lit(None).cast("string")
    for r in rules:
        if r.replacement is not None:
            new = F.when(F.col("rule_id") == r.id, r.replacement).otherwise(new)
    return findings.select("path", "line", F.col("column").alias("start"), F.col("end_column").alias("end"), new.alias("inserted"), "rule_id").where("inserted is not null")


def not_overlapping(e: DataFrame) -> DataFrame:
    """Greedy choice within a line, by start, then the longer, then the rule: an
    edit is taken if it starts at or after the end of the last one taken. The fold
    runs over a line's edits alone."""
    packed = e.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("before"), "rule_id", "inserted"))).alias("all"))
    kind = "array<struct<start:bigint,before:bigint,rule_id:string,inserted:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(kind).alias("out"))
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct((-x["before"]).alias("end"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    chosen = packed.select("path", "line", F.aggregate("all", zero, step, lambda s: s["out"]).alias("chosen"))
    return chosen.select("path", "line", F.explode("chosen").alias("x")).select("path", "line", F.col("x.start").alias("start"), (-F.col("x.before")).alias("end"), "x.inserted", "x.rule_id")


def applied(all_lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """(path, line, text, n_edits): the lines with their edits, from right to left
    in bytes. Lines without an edit pass by."""
    per = chosen.groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("s"), "end", "inserted"))).alias("es"))
    put = lambda b, x: F.concat(F.substring(b, F.lit(1), (-x["s"] - 1).cast("int")), x["inserted"].cast("binary"), F.substring(b, x["end"].cast("int"), F.octet_length(b)))
    out = all_lines.join(per, ["path", "line"], "left")
    return out.select("path", "line", F.when(F.col("es").isNull(), F.col("text")).otherwise(F.aggregate("es", F.col("text").cast("binary"), put).cast("string")).alias("text"), F.coalesce(F.size("es"), F.lit(0)).cast("long").alias("n_edits"))


def rejoined(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"), F.sum("n_edits").alias("n_edits")).select("path", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "n_edits")


def first_of_overlaps(ranges: DataFrame) -> DataFrame:
    """Of ranges (path, start, end) per file those that no earlier one reaches into."""
    before = Window.partitionBy("path").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_e", F.max("end").over(before)).where(F.col("_e").isNull() | (F.col("start") >= F.col("_e"))).drop("_e")
