"""References against what could answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ancestors


def nearest(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``dir``: of the folders above ``path`` that are in ``marks`` (dir), the
    nearest. Items without one get null."""
    up = items.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    best = up.join(marks.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return items.join(best, "path", "left")


def unresolved(references: DataFrame, builtins: DataFrame, local: DataFrame, declared: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """References (path, dir, name, specifier) that nothing answers: neither the
    builtin names, nor a name bound in the same file, nor a dependency that the
    governing manifest declares, nor one of its alias prefixes. A file without a
    manifest (``dir`` null) has no unresolved references."""
    out = references.where(F.col("dir").isNotNull())
    out = out.join(builtins.select("name"), "name", "left_anti")
    out = out.join(local.select("path", "name"), ["path", "name"], "left_anti")
    out = out.join(declared.select("dir", "name"), ["dir", "name"], "left_anti")
    if aliases is not None:
        a = aliases.select(F.col("dir").alias("a_dir"), "prefix", "wildcard")
        hit = (F.col("dir") == F.col("a_dir")) & F.when(F.col("wildcard"), F.col("specifier").startswith(F.col("prefix"))).otherwise(F.col("specifier") == F.col("prefix"))
        out = out.join(a, hit, "left_anti")
    return out


#: Endings under which an import finds a file.
EXTENSIONS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".json", "/index.ts", "/index.tsx", "/index.js")


def missing_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """Relative references (path, target) to no file, under any usual ending."""
    tries = references.withColumn("try", F.explode(F.array(*[F.concat("target", F.lit(x)) for x in EXTENSIONS])))
    there = tries.join(files.select(F.col("path").alias("try")), "try", "left_semi").select("path", "target").distinct()
    return references.join(there, ["path", "target"], "left_anti")
