"""Source trees: files, changed files, manifests."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import ancestors, glob_regex

LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript"}


def files(spark: SparkSession, root: str, ignores: Sequence[str] = ()) -> DataFrame:
    """(path, lang, text) of the source files below ``root``, paths relative to it.
    Names are filtered before any file is opened."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(LANGUAGES) + "}").text(root, wholetext=True)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/")
    ending = F.regexp_extract("path", r"\.([^.]+)$", 1)
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending)
    out = raw.select(F.substring(full, F.lit(len(base) + 2), F.length(full)).alias("path"), F.col("value").alias("text")).withColumn("lang", lang)
    for g in ignores:
        out = out.where(~F.col("path").rlike(glob_regex(g)))
    return out.select("path", "lang", "text")


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True)
    return [x for x in done.stdout.split("\0") if x]


def changed(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(path) of files added, copied, modified or renamed against HEAD, or since
    the branch left ``base``."""
    if base and base.startswith("-"):
        raise ValueError("a revision can't begin with a dash")
    against = [f"{base}...HEAD"] if base else ["HEAD"]
    names = _git(root, "diff", "--name-only", "-z", "--diff-filter=ACMR", *against, "--")
    return spark.createDataFrame([(x,) for x in sorted(set(names))], "path string")


def only(all_files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Marks the files that are reported; the others serve indexes alone."""
    w = wanted.select("path", F.lit(True).alias("reported")).distinct()
    return all_files.join(w, "path", "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def explicit(all_files: DataFrame, wanted: DataFrame, ignores: Sequence[str] = (), keys: Sequence[str] = ("path",)) -> DataFrame:
    """The files (path, ...) that are named in ``wanted`` (path), and are sources and not ignored; names of
    nothing are passed by. Where several files share a path, ``keys`` tell them apart."""
    out = all_files.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*LANGUAGES))
    for g in ignores:
        out = out.where(~F.col("path").rlike(glob_regex(g)))
    return out.join(wanted.select(*keys).distinct(), list(keys), "left_semi").select(*all_files.columns)


def under(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``paths`` that are one of ``roots`` (path) or lie below one: a join on equal folders, since a path's
    ancestors are spread. A root may end in a slash; the empty one holds all."""
    asked = roots.select(F.regexp_replace("path", "/+$", "").alias("root")).distinct()
    each = paths.select("path", F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("root"))
    return paths.join(each.join(asked, "root", "left_semi").select("path").distinct(), "path", "left_semi")


def jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    strings = r'"(?:\\.|[^"\\])*"'
    plain = re.sub(rf"({strings})|//[^\n]*|/\*[\s\S]*?\*/", lambda m: m[1] or " ", text)
    return json.loads(re.sub(rf"({strings})|,(?=\s*[}}\]])", lambda m: m[1] or "", plain) or "{}")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(dir, ecosystem, name, scope) of every dependency that a manifest names; a
    manifest that can't be read has none, but still governs its folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{Cargo.toml,package.json,tsconfig.json}").text(root, wholetext=True)
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    full = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), "^file:/*", "/")
    rows = raw.select(F.substring(full, F.lit(len(base) + 2), F.length(full)).alias("path"), "value")

    def names(path: str, text: str) -> list[tuple]:
        folder, _, kind = path.rpartition("/")
        try:
            if kind == "Cargo.toml":
                data = tomllib.loads(text)
                found = [(data["package"]["name"], "own")] if "name" in data.get("package", {}) else []
                scopes = {"dependencies": "normal", "build-dependencies": "build", "dev-dependencies": "dev"}
                found += [(n, s) for k, s in scopes.items() for n in data.get(k, {})]
                return [(folder, "rust", n.replace("-", "_"), s) for n, s in found] or [(folder, "rust", None, None)]
            data = jsonc(text)
            if kind == "package.json":
                found = [(n, k) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n in data.get(k, {})]
                return [(folder, "typescript", n, "dev" if k == "devDependencies" else "normal") for n, k in found] or [(folder, "typescript", None, None)]
            return [(folder, "alias", n, None) for n in data.get("compilerOptions", {}).get("paths", {})]
        except (ValueError, AttributeError, TypeError):
            return [(folder, {"Cargo.toml": "rust", "package.json": "typescript"}.get(kind, "alias"), None, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for p, t in zip(pdf["path"], pdf["value"]) for x in names(p, t)], columns=["dir", "ecosystem", "name", "scope"])

    return rows.mapInPandas(run, "dir string, ecosystem string, name string, scope string")
