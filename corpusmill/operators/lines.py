"""Lines of files, context around a line, and directives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import split_lines


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, text), lines from 1 on."""
    return files.select("path", "lang", F.posexplode(split_lines(F.col("text"))).alias("i", "text")).select("path", "lang", (F.col("i") + 1).cast("long").alias("line"), "text")


def _near(at: DataFrame, all_lines: DataFrame, reach: int) -> DataFrame:
    """(path, line, n, text): the lines ``n`` within ``reach`` of each place. The
    places are spread, being fewer than lines, and met by path and line."""
    keys = at.select("path", "line").distinct()
    spread = keys.select("path", "line", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("n"))
    return spread.join(all_lines.select("path", F.col("line").alias("n"), "text"), ["path", "n"])


def context(at: DataFrame, all_lines: DataFrame, reach: int) -> DataFrame:
    """Adds ``context`` to rows with (path, line): the trimmed lines within
    ``reach`` lines, joined by line ends."""
    put = _near(at, all_lines, reach).groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("t")))).alias("c"))
    shown = put.select("path", "line", F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("context"))
    return at.join(shown, ["path", "line"], "left")


def numbered(at: DataFrame, all_lines: DataFrame, reach: int) -> DataFrame:
    """(path, line, region): as ``context``, each line with its number, untrimmed."""
    put = _near(at, all_lines, reach).groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("c"))
    return put.select("path", "line", F.array_join(F.transform("c", lambda x: F.concat(x["n"].cast("string"), F.lit(": "), x["text"])), "\n").alias("region"))


def directives(all_lines: DataFrame, marker: str = "scan-off-next-line") -> DataFrame:
    """(path, comment_line, target_line, rule_id, comment): a line comment that
    opens with the marker switches off the rule it names, or all, on the next
    line; what follows ``--`` is a reason."""
    rest = F.regexp_extract("text", rf"^\s*//\s*{marker}(.*)$", 1)
    rows = all_lines.where(F.col("text").rlike(rf"^\s*//\s*{marker}"))
    named = F.trim(F.split_part(rest, F.lit("--"), F.lit(1)))
    return rows.select("path", F.col("line").alias("comment_line"), (F.col("line") + 1).alias("target_line"), F.nullif(named, F.lit("")).alias("rule_id"), F.trim("text").alias("comment"))
