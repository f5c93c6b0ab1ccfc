"""Rows that stand for several equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.names import columns, fresh, quoted

BLOCK = 4096


def numbers(n: Column) -> Column:
    """The numbers from 0 to n - 1; none if n is 0 or null."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row of ``rows`` as often as its ``n`` says, without that column. Blocks of
    equal rows are dealt out before they are spread, so that no task has them all and
    no array is longer than ``BLOCK``."""
    block, i = fresh(rows.columns, "block"), fresh(rows.columns, "i")
    keep = [c for c in rows.columns if c != n]
    blocks = rows.select("*", F.explode(numbers(F.ceil(F.col(quoted(n)) / BLOCK))).alias(block)).repartition(*columns([block, *keep[:1]]))
    left = F.least(F.lit(BLOCK), F.col(quoted(n)) - F.col(quoted(block)) * BLOCK)
    return blocks.select(*columns(keep), F.explode(numbers(left)).alias(i)).select(*columns(keep))
