"""Files that ignore files leave in, told by rows.

Every folder may hold an ordered list of patterns. For each file and folder the last pattern that fits decides, one
of a nearer folder before one further up; a folder that is ignored takes along all that is in it,
whatever patterns below say. Patterns become regular expressions as columns, folders of many
files are decided once, and patterns meet paths by their folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ancestors


def patterns(files: DataFrame) -> DataFrame:
    """(dir, nth, negated, folders_only, regex) of ignore files (dir, text): a row per pattern, by its line."""
    lines = files.select("dir", F.posexplode(F.split("text", "\r?\n")).alias("nth", "line"))
    bare = F.when(F.col("line").endswith("\\ "), F.col("line")).otherwise(F.regexp_replace("line", r"[ \t]+$", ""))
    rows = lines.withColumn("line", bare).where(~F.col("line").startswith("#") & (F.col("line") != ""))
    negated = F.col("line").startswith("!")
    rows = rows.select("dir", "nth", negated.alias("negated"), F.regexp_replace("line", "^!", "").alias("p"))
    rows = rows.withColumn("folders_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/$", ""))
    rows = rows.withColumn("anchored", F.col("p").contains("/")).withColumn("p", F.regexp_replace("p", "^/", "")).where("p != ''")
    return rows.select("dir", "nth", "negated", "folders_only", F.concat(F.lit("^"), F.when(~F.col("anchored"), "(?:.*/)?").otherwise(""), _regex(F.col("p")), F.lit("$")).alias("regex"))


def _regex(glob: Column) -> Column:
    """Of a glob in which ``**`` between slashes stands for any folders. A backslash makes the character after it stand
    for itself; a set in brackets holds no ``*`` or ``?``."""
    literals = (("*", "\x03"), ("?", "\x04"), ("[", "\x05"))
    p = glob
    for c, mark in literals:
        p = F.replace(p, F.lit("\\" + c), F.lit(mark))
    p = F.regexp_replace(p, r"\\(.)", "$1")
    p = F.regexp_replace(F.regexp_replace(p, r"([.+^$(){}|])", r"\\$1"), r"\[\\?[!^]", "[^")
    p = F.regexp_replace(F.regexp_replace(p, r"(^|/)\*\*/", "$1\x01"), r"/\*\*$", "/\x02")
    p = F.regexp_replace(F.regexp_replace(p, r"\*+", "[^/]*"), r"\?", "[^/]")
    p = F.replace(F.replace(p, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".+"))
    for c, mark in literals:
        p = F.replace(p, F.lit(mark), F.lit("\\" + c))
    return p


def kept(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The ``paths`` (path, ...) that are not ignored by ``rules``, as ``patterns`` gives them."""
    above = ancestors(F.col("path"))
    inner = F.filter(above, lambda x: x != "")
    entries = paths.select(F.explode(F.concat(F.transform(inner, lambda x: F.struct(x.alias("entry"), F.lit(True).alias("folder"))), F.array(F.struct(F.col("path").alias("entry"), F.lit(False).alias("folder"))))).alias("e")).select("e.*").distinct()
    each = entries.select("entry", "folder", F.explode(ancestors(F.col("entry"))).alias("dir"))
    met = each.join(rules, "dir").where((F.col("folder") | ~F.col("folders_only")))
    rest = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(dir) + 2)"))
    fits = met.where(F.regexp_count(rest, F.col("regex")) > 0)
    decided = fits.groupBy("entry").agg(F.max_by("negated", F.struct(F.length("dir"), "nth")).alias("negated")).where("not negated")
    gone = decided.select(F.col("entry").alias("gone"))
    spread = paths.select("path", F.explode(F.array_append(inner, F.col("path"))).alias("gone"))
    return paths.join(spread.join(gone, "gone").select("path").distinct(), "path", "left_anti")
