"""Tables as source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer parts than the session has cores is dealt out anew; a larger
    one, with parts enough, is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_path() -> Column:
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, lang, text); documents without a text contribute nothing."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).where("text is not null").select(document_path().alias("path"), "lang", "text")
