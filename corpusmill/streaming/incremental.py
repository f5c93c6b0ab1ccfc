"""Scanning only what is new: a cache of findings by content, and a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import keyed
from corpusmill.operators.findings import file_findings
from corpusmill.plans.rules import Rule


def rules_hash(rules) -> str:
    """Changes with anything that a rule says."""
    import hashlib

    return hashlib.sha256("\0".join(sorted(map(repr, rules))).encode()).hexdigest()


def stamped(files: DataFrame, version: str) -> DataFrame:
    """Adds ``stamp``: of rules, path and content. The path counts, as rules do
    look at it."""
    return files.withColumn("stamp", keyed(F.lit(version), F.col("path"), F.sha2("text", 256)))


def split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to scan, and cached findings of the others. The cache has the columns
    ``stamp`` and ``findings``, an array."""
    misses = files.join(cache.select("stamp"), "stamp", "left_anti")
    hits = cache.join(files.select("stamp"), "stamp", "left_semi")
    return misses, hits


def cached_scan(files: DataFrame, cache: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """The new cache (stamp, path, lang, findings): the entries of files that are as they
    were, and those of the others, which alone are scanned. Entries of files that are
    gone aren't in it. What is cached is each file's own matches; what depends on other
    files or on numbers (escalation, cross-file checks, baselines) is worked out from
    ``cached_findings`` each time and never stored."""
    now = stamped(files.select("path", "lang", "text"), rules_hash(rules))
    if cache is None:
        return file_findings(now, rules).select("stamp", "path", "lang", "findings")
    misses, hits = split(now, cache)
    return hits.select("stamp", "path", "lang", "findings").unionByName(file_findings(misses, rules).select("stamp", "path", "lang", "findings"))


def cached_findings(cache: DataFrame) -> DataFrame:
    return cache.select("path", "lang", F.explode("findings").alias("f")).select("path", "lang", "f.*")


def pruned(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is still there as it was."""
    return cache.join(files.select("stamp"), "stamp", "left_semi")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files that were added, changed or deleted."""
    a = old.select(F.col("path").alias("old_path"), F.sha2("text", 256).alias("old_sha"))
    b = new.select(F.col("path").alias("new_path"), F.sha2("text", 256).alias("new_sha"))
    both = a.join(b, F.col("old_path") == F.col("new_path"), "full")
    status = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "changed")
    return both.select(F.coalesce("new_path", "old_path").alias("path"), status.alias("status")).where("status is not null")


def stream(spark: SparkSession, folder: str, name: str, sample: DataFrame) -> DataFrame:
    """A table's files as a stream: each is read once, whenever it arrives."""
    return spark.readStream.schema(sample.schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}")


def run_once(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that is there in micro-batches and stops. ``each`` gets a batch and
    its number; a batch that was cut off comes again under the same number."""
    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per type and window; on a stream, rows later than ``late``
    are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
