"""Bounded samples of classes of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.names import fresh
from corpusmill.shared import written


def smallest(rows: DataFrame, by: str, key: str, quotas: int | Mapping[object, int]) -> DataFrame:
    """Of each class ``by`` the rows with the smallest ``key`` (a hash, a long): as many
    as its quota, or all if there are fewer. A count per class and 4096th of the hash's
    range says where the quota ends, so that only the rows before that end are ordered;
    each task keeps a quota of them at most before they are shuffled."""
    bucket, n, cut = F.shiftright(key, 52), fresh(rows.columns, "n"), fresh(rows.columns, "cut")
    if isinstance(quotas, int):
        most, quota = quotas, F.lit(quotas)
    else:
        most, quota = max(quotas.values(), default=0), F.lit(0)
        for name, q in quotas.items():
            quota = F.when(F.col(by) == name, q).otherwise(quota)
    counts = rows.groupBy(by, bucket.alias(cut)).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy(by).orderBy(cut)) - F.col(n)
    ends = written(counts.withColumn(n, before).where(F.col(n) < quota).groupBy(by).agg(F.max(cut).alias(cut)))
    near = rows.join(ends, by).where(bucket <= F.col(cut)).select(*rows.columns)
    order = Window.partitionBy(by).orderBy(key)
    return near.withColumn(n, F.row_number().over(order)).where((F.col(n) <= most) & (F.col(n) <= quota)).drop(n)
