"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits and link at ``threshold`` (3) or fewer differing
bits. Two linked fingerprints differ in at most one bit in one of their
32-bit halves. In each half, the code words of the perfect [31, 26] Hamming
code over the lower 31 bits are the anchors: the code covers every point
within radius 1, by exactly one anchor. A fingerprint is at home at that
anchor, and is replicated to every anchor within radius + 1 = 2 of it: itself
or one at distance 1, and at most 15 at distance 2. A linked pair therefore
meets at the home anchor of either, and is compared there. No bucket is
capped, and anchors are a function of the bits. There are 2**26 of them a half, so
random meetings of different fingerprints grow with the square of their number over
2**22: two a fingerprint at four million, and some five thousand at 10**10, where
more and narrower parts would be called for.

Defined cases: a null text counts as empty and gets fingerprint zero, which
links like any other; repeated rows share one class; a text of fewer than
three words is one shingle; a very long text is hashed in blocks of shingles; an
empty table gives an empty result; null ids never name a component unless all its
ids are null; other columns are ignored, or pass through ``deduplicated``, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import near_copies as near
from corpusmill.llm.components import connected
from corpusmill.llm.names import columns, fresh, quoted
from corpusmill.shared import scratch, shared_dir, written
from corpusmill.ship import ship

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
HALVES = ((0, 0x7FFFFFFF), (32, 0x7FFFFFFF))


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a UTF-8 text; bit i is set if it is set in over half
    the shingles' hashes."""
    words = [w for w in SPACE.split(text.translate(LOWER)) if w]
    if not words:
        return 0
    joined, ends, n = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1, max(1, len(words) - width + 1)
    starts, stops = [0, *(ends + 1).tolist()], ends.tolist()
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    bits, step = np.zeros(64, np.int64), 8192
    for at in range(0, n, step):
        h = np.fromiter((digest(joined[starts[i] : stops[i + last]], 42) for i in range(at, min(n, at + step))), np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_key, fp) per row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["id", "text_key", "fp"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).cast("binary").alias("t"), near.text_key(F.col(quoted(text))).alias("text_key"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_key binary, fp long")


def _syndrome(x: Column) -> Column:
    """Of the 31-bit word ``x``, whose bit i - 1 stands for position i."""
    checks = []
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        checks.append(F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(mask))) % 2, k))
    return reduce(lambda a, b: a.bitwiseOR(b), checks)


def _flip(x: Column, position: Column) -> Column:
    return F.when(position == 0, x).otherwise(x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), position - 1)))


def anchors(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(half, anchor, fp) at the home anchors, and the replicas."""
    halves = F.explode(F.array(*[F.struct(F.lit(i).alias("half"), F.shiftright("fp", s).bitwiseAND(F.lit(m)).alias("x")) for i, (s, m) in enumerate(HALVES)]))
    parts = fps.select("fp", halves.alias("h")).select("fp", F.col("h.half").alias("half"), F.col("h.x").alias("x"))
    parts = parts.withColumn("s", _syndrome(F.col("x")))
    home = parts.select("half", _flip(F.col("x"), F.col("s")).alias("anchor"), "fp")
    # Code words at distance 2 flip positions i and i XOR s, each pair once; none if x is a code word.
    far = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") != 0) & (i != F.col("s")) & (i < i.bitwiseXOR(F.col("s")))),
        lambda i: _flip(_flip(F.col("x"), i), i.bitwiseXOR(F.col("s"))),
    )
    all_near = F.concat(F.array(_flip(F.col("x"), F.col("s"))), far)
    return home, parts.select("half", F.explode(all_near).alias("anchor"), "fp")


def links(fps: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints that differ in 1 to ``threshold`` bits."""
    if not 1 <= threshold <= 3:
        raise ValueError("two halves hold differences of up to 3 bits")
    home, near = anchors(fps)
    h, n = home.withColumnRenamed("fp", "a"), near.withColumnRenamed("fp", "b")
    on = (h["half"] == n["half"]) & (h["anchor"] == n["anchor"]) & (h["a"] != n["b"]) & (F.bit_count(h["a"].bitwiseXOR(n["b"])) <= threshold)
    return h.join(n, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(rows: DataFrame, threshold: int = 3) -> DataFrame:
    """(fp, root) of every fingerprint in ``rows``: those with one root are linked."""
    own = written(rows.select("fp").distinct())
    roots = connected(links(own, threshold)).select(F.col("node").alias("fp"), "root")
    # Written, so that both sides of a join with it are plain shuffles: Spark can then split a fingerprint with many copies.
    return written(own.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3) -> DataFrame:
    """(id, fp, component_id) per row; the component is named by its smallest id."""
    rows = written(fingerprints(docs, doc_id, text))
    named = rows.groupBy("fp").agg(F.min("id").alias("low")).join(classes(rows, threshold), "fp")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = written(written(named.select("fp", "root")).join(written(lowest), "root").select("fp", "component_id"))
    return rows.join(by_class, "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def groups(rows: DataFrame, threshold: int, near: DataFrame | None) -> DataFrame:
    """(id, root) per row of ``rows`` (id, text_key, fp). With ``near`` (text_key, near),
    near copies of a row in a group are in that group too."""
    own = rows.join(classes(rows, threshold), "fp").select("id", "text_key", "root")
    if near is None:
        return own.select("id", "root")
    both = written(written(own).join(near, "text_key").select("id", "root", "near"))
    # Groups of near copies that a class of fingerprints has in common become one.
    pairs = both.select("root", "near").distinct()
    low = written(pairs.groupBy("root").agg(F.min("near").alias("low"), F.max("near").alias("high")).where("low != high").select("root", "low"))
    met = connected(pairs.join(low, "root").where("near != low").select(F.col("low").alias("a"), F.col("near").alias("b")))
    met = written(met.select(F.col("node").alias("near"), F.col("root").alias("met")))
    return both.join(met, "near", "left").select("id", F.coalesce("met", "near").alias("root"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 3, near_copies: bool = False) -> DataFrame:
    """One row of each component: that with the smallest id, and of rows with one
    id one. A row without an id can't stand for others, and stays. With ``near_copies``,
    texts of a five-word shingle similarity of 0.8 or more are linked as well,
    however many bits their fingerprints differ in. The texts are joined with the
    ids that go alone."""
    named = docs.where(F.col(quoted(doc_id)).isNotNull())
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/changed"
    with scratch(spark):
        rows = written(fingerprints(named, doc_id, text))
        own = written(groups(rows, threshold, near.groups(docs, text) if near_copies else None))
        lowest = written(own.groupBy("root").agg(F.min("id").alias("low")))
        # A row per id: whether it goes, and whether several rows have it.
        ids = own.join(lowest, "root").groupBy("id").agg(F.min(F.col("id") != F.col("low")).alias("goes"), (F.count("*") > 1).alias("several"))
        changed = written(ids.where("goes or several"), path)
    name = fresh(docs.columns, "changed")
    told = docs.join(changed.select(F.struct("*").alias(name)), F.col(quoted(doc_id)) == F.col(f"{name}.id"), "left")
    told = told.where(~F.coalesce(F.col(f"{name}.goes"), F.lit(False)))
    out = told.where(~F.coalesce(F.col(f"{name}.several"), F.lit(False))).select(*columns(docs.columns))
    if changed.where("several and not goes").take(1):
        out = out.unionByName(told.where(F.col(f"{name}.several")).select(*columns(docs.columns)).dropDuplicates([doc_id]))
    return out
