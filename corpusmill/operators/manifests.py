"""Names that a package may import, from rows of manifests.

packages: (dir, name, lib_name, is_workspace), a row per manifest; deps: (dir, section, key, package, path,
workspace), a row per dependency, ``section`` being ``workspace.dependencies`` for those that packages below
may inherit. Everything is equality joins on folders: a folder's ancestors are spread, and the
nearest one that is a workspace wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ancestors

SHARED = "workspace.dependencies"


def crate(name: Column) -> Column:
    """A package's name as sources spell it."""
    return F.translate(name, "-", "_")


def joined(folder: Column, path: Column) -> Column:
    """``path`` from ``folder`` on, without ``.`` and ``..``; what climbs above the root stays there."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), path), "/"), lambda x: ~x.isin("", "."))
    step = lambda s, x: F.when(x != "..", F.concat(s, F.array(x))).when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def workspaces(packages: DataFrame) -> DataFrame:
    """(dir, root): of each package the nearest folder, itself or above, that is a workspace."""
    roots = packages.where("is_workspace").select(F.col("dir").alias("root"))
    above = F.array_union(F.array("dir"), F.when(F.col("dir") != "", ancestors(F.col("dir"))).otherwise(F.array(F.lit(""))))
    each = packages.select("dir", F.explode(above).alias("root"))
    return each.join(roots, "root").groupBy("dir").agg(F.max_by("root", F.length("root")).alias("root"))


def _library_names(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """Of dependencies (dir, base, package, path) by path, and not renamed, the library names of what they point at."""
    at = rows.where("package is null and path is not null").select("dir", joined(F.col("base"), F.col("path")).alias("target"))
    libs = packages.where("lib_name is not null").select(F.col("dir").alias("target"), F.col("lib_name").alias("name"))
    return at.join(libs, "target").select("dir", "name")


def importable(packages: DataFrame, deps: DataFrame) -> DataFrame:
    """(dir, name): every name that a manifest makes usable. That is each dependency's key, and the package's own name;
    its library's name; and the library names of dependencies by path, also of those that are
    inherited from the workspace, whose paths count from there. A renamed dependency is known by its key alone."""
    own = packages.select("dir", F.explode(F.array_compact(F.array(crate(F.col("name")), F.col("lib_name")))).alias("name"))
    keys = deps.select("dir", crate(F.col("key")).alias("name"))
    direct = _library_names(deps.withColumn("base", F.col("dir")), packages)
    asks = deps.where("workspace and package is null and path is null").select("dir", "key").join(workspaces(packages), "dir")
    given = deps.where(F.col("section") == SHARED).select(F.col("dir").alias("root"), "key", "package", "path")
    inherited = _library_names(asks.join(given, ["root", "key"]).withColumn("base", F.col("root")), packages)
    return own.unionByName(keys).unionByName(direct).unionByName(inherited).distinct()
