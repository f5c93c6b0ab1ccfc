"""Stored verdicts of a model, so that nothing is asked twice.

A store is a folder of batches, each a table (key, is_issue, probability, reason) of its own with a number; of
several verdicts on a key the one with the highest number counts. ``compact`` writes what
counts as a base, and batches before it aren't read any more. A batch counts once
its writer has finished it, so a broken run leaves nothing behind that is read. One
application writes a store at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.review import asked
from corpusmill.shared import written

SCHEMA = "key string, is_issue boolean, probability double, reason string"


class VerdictStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _tables(self) -> list[tuple[int, str, bool]]:
        """(number, kind, finished) of all batches and bases."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = lambda name: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return sorted((int(m[2]), m[1], done(name)) for name in names if (m := re.fullmatch(r"(batch|base)-(\d+)", name)))

    def verdicts(self) -> DataFrame:
        """(key, is_issue, probability, reason): the latest verdict on each key."""
        tables = [(n, kind) for n, kind, done in self._tables() if done]
        base = max([n for n, kind in tables if kind == "base"], default=-1)
        out = self.spark.createDataFrame([], f"{SCHEMA}, n long")
        for n, kind in tables:
            if n > base and kind == "batch" or n == base and kind == "base":
                out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{kind}-{n}").withColumn("n", F.lit(n).cast("long")))
        best = out.groupBy("key").agg(F.max(F.struct("n", "is_issue", "probability", "reason")).alias("v"))
        return best.select("key", "v.is_issue", "v.probability", "v.reason")

    def put(self, verdicts: DataFrame) -> None:
        """Adds a batch. Two verdicts on a key within it count as one, the greater by its columns."""
        number = max([n for n, _, _ in self._tables()], default=-1) + 1
        verdicts.select("key", "is_issue", "probability", "reason").write.parquet(f"{self.path}/batch-{number}")

    def compact(self) -> None:
        number = max([n for n, _, _ in self._tables()], default=-1) + 1
        self.verdicts().write.parquet(f"{self.path}/base-{number}")

    def ask(self, candidates: DataFrame, model: Callable[[list[str]], list[float]]) -> DataFrame:
        """The verdicts on ``candidates`` (key, prompt): those on keys that the store lacks are asked, once a
        key, and stored before any is returned. An answer that is no probability isn't stored,
        so that it is asked again another time."""
        lacking = candidates.join(self.verdicts().select("key"), "key", "left_anti").groupBy("key").agg(F.min("prompt").alias("prompt"))
        new = written(asked(written(lacking), model))
        self.put(new.where("probability between 0 and 1 and not isnan(probability)"))
        return self.verdicts().join(candidates.select("key").distinct(), "key", "left_semi")
