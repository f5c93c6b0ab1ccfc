"""Operators over many files: shared messages, lone owners, reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.shared import written

#: Tables of rounds that are read one by one.
MOST_ROUNDS = 16


def shared_messages(messages: DataFrame, least_chars: int = 10, least_files: int = 2) -> DataFrame:
    """Every occurrence (path, line, text) of a message that stands in several
    files, with their number. Files are counted after a first grouping by text and
    file, so a text that is everywhere is summed before it moves."""
    long = messages.where(F.length("text") >= least_chars)
    files = long.groupBy("text", "path").agg(F.lit(1).alias("_")).groupBy("text").agg(F.count("*").alias("files")).where(F.col("files") >= least_files)
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot text's.
    return long.join(written(files), "text")


def lone_owners(declared: DataFrame, implemented: DataFrame, local: DataFrame) -> DataFrame:
    """Names that are declared once and implemented once, not for every type, and by
    a type that is declared in the implementation's own root.

    declared (name, root, path), implemented (name, type, root, blanket), local
    (type, root)."""
    once = declared.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    by = implemented.groupBy("name").agg(F.count("*").alias("n"), F.count_if("blanket").alias("b"), F.min("type").alias("type"), F.min("root").alias("root")).where("n = 1 and b = 0")
    found = once.select("name", "path").join(by.select("name", "type", "root"), "name")
    return found.join(local, ["type", "root"], "left_semi")


def reaching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes from which a seed is reached along (caller, callee). Each round adds the
    callers of what the last round added, and writes these alone in the shared folder; it
    ends when a round adds nothing, as one does sooner or later, since nodes are
    added once. The tables of rounds are put together now and then, so that plans stay short."""
    edges = written(edges.select("caller", "callee").distinct())
    fresh = written(seeds.select("node").distinct())
    rounds = [fresh]
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        callers = edges.join(fresh, edges["callee"] == fresh["node"]).select(F.col("caller").alias("node")).distinct()
        fresh = written(callers.join(known, "node", "left_anti"))
        if not fresh.take(1):
            return known
        rounds.append(fresh)
        if len(rounds) > MOST_ROUNDS:
            rounds = [written(reduce(DataFrame.unionByName, rounds))]


def unasserted(tests: DataFrame, calls: DataFrame, asserting: DataFrame) -> DataFrame:
    """Tests none of whose calls (test, callee) reaches an assertion."""
    good = calls.join(asserting, calls["callee"] == asserting["node"], "left_semi").select("test")
    return tests.join(good, "test", "left_anti")


def support_only(dev: DataFrame, normal: DataFrame) -> DataFrame:
    """Names that are needed for development somewhere and otherwise nowhere."""
    return dev.select("name").subtract(normal.select("name"))
