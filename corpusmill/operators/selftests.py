"""Rules tried on their own snippets, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tried(rules: DataFrame, cases: DataFrame, by_line: bool = True) -> DataFrame:
    """``cases`` (rule_id, snippet, should_match, ...) with what came out as ``matched``, of ``rules`` (rule_id, pattern,
    unless). A rule meets its own snippets alone, line by line as a scan does or, without ``by_line``, as
    wholes; patterns come from a column, so any number of rules is one plan."""
    met = cases.join(rules.select("rule_id", "pattern", "unless"), "rule_id")
    hit = lambda x: (F.regexp_count(x, F.col("pattern")) > 0) & (F.col("unless").isNull() | (F.regexp_count(x, F.coalesce("unless", F.lit(""))) == 0))
    return met.withColumn("matched", F.exists(F.split("snippet", "\r?\n"), hit) if by_line else hit(F.col("snippet"))).drop("pattern", "unless")


def summary(rules: DataFrame, cases: DataFrame, by_line: bool = True) -> DataFrame:
    """(rule_id, passed, failed, status) of every rule: ``pass`` if all its snippets came out as they should, ``fail`` if
    one didn't, ``none`` if it has none."""
    ok = F.col("matched") == F.col("should_match")
    counts = tried(rules, cases, by_line).groupBy("rule_id").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    out = rules.select("rule_id").join(counts, "rule_id", "left").select("rule_id", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") > 0, "fail").when(F.col("passed") > 0, "pass").otherwise("none"))
