"""Token counts as delta-maintained rollups.

A change is a signed row: an insert adds a document and its tokens (sign 1), a
delete takes them away (sign -1), a revised count is both. A batch of changes is
summed by source, language and tokenizer version, and committed under its id;
totals are the sums over the committed batches, so they never need the documents
again, and batches may be committed in any order.

A batch is first written to a folder of its own attempt. It counts once a marker of
its id names that attempt: a small file that is made only if there is none of that
name, which file systems and object stores with put-if-absent promise, and then read
again. So of repeated or competing commits of one id exactly one counts, and a commit
that broke off leaves nothing that is read; a marker that was left empty counts for
nothing and is replaced.

``compact`` sums what has been committed into one table, which the totals then start
from; ids that have been committed stay known.

Defined cases: null sources, languages and versions are groups of their own;
null token counts are zero; an empty batch is committed too; counts of very long
texts are longs like any other; totals of zero
documents and tokens are left out; equal rows add up; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts go, the new ones come."""
    return deletes(old).unionByName(inserts(new))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.lit(sign).cast("long").alias("sign"))


class Rollup:
    """Totals under ``path``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("commits", "bases"):
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        """Of the files there that aren't empty."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if x.getLen() > 0)

    def _said(self, name: str) -> str:
        file = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _put(self, name: str, words: str) -> bool:
        """Makes a file if there is none; whether it is this one that counts."""
        at = self._path(f"{self.path}/{name}")
        if self._fs.exists(at) and self._fs.getFileStatus(at).getLen() == 0:
            self._fs.delete(at, False)
        try:
            file = self._fs.create(at, False)
            file.writeBytes(words)
            file.close()
        except Py4JJavaError:
            if not self._fs.exists(at):
                raise
        return self._said(name) == words

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [x[3:] for x in self._names("commits") if x.startswith("id=")]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows; False if its id has been committed before,
        in which case nothing changes."""
        if not batch_id or "/" in batch_id:
            raise ValueError("a batch id is a file name")
        if batch_id in self.batches():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        return self._counts(f"commits/id={batch_id}", sums)

    def _counts(self, marker: str, rows: DataFrame, more: dict | None = None) -> bool:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/attempts/{attempt}")
        if self._put(marker, json.dumps({"attempt": attempt, **(more or {})})):
            return True
        self._fs.delete(self._path(f"{self.path}/attempts/{attempt}"), True)
        return False

    def _parts(self) -> tuple[int, list[str], list[str]]:
        """The number of the newest base, the tables that count, the ids in them."""
        bases, ids, tables = self._names("bases"), self.batches(), []
        base = json.loads(self._said(f"bases/{bases[-1]}")) if bases else {"batches": []}
        if "attempt" in base:
            tables.append(base["attempt"])
        held = set(base["batches"])
        tables += [json.loads(self._said(f"commits/id={x}"))["attempt"] for x in ids if x not in held]
        return int(bases[-1]) if bases else 0, [f"{self.path}/attempts/{x}" for x in tables], ids

    def _sums(self, tables: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*tables) if tables else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._sums(self._parts()[1])

    def compact(self) -> bool:
        """Puts the sums over all batches so far into one table; False if another
        compaction was first, in which case nothing changes."""
        last, tables, ids = self._parts()
        return self._counts(f"bases/{last + 1:08d}", self._sums(tables), {"batches": ids})
