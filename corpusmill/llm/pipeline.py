"""A training corpus from raw documents, stage by stage.

Each stage takes all that the stage before has kept; what it rejects or changes
is rejected or changed for all later ones. Between stages the rows are Parquet
files in the shared folder, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import line_frequency, mixing, rule_ensemble, simhash, unigram
from corpusmill.llm.tokenizer_files import PIECES
from corpusmill.shared import shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source share go, and with them the
    documents that have little else or fail the base rules. Near copies count as
    one document, so that their group is left for near_duplicates."""
    return line_frequency.clean_documents(docs, count="near_copies")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.5 go."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Linked
    are fingerprints within 3 bits, and texts whose five-word shingles have a similarity
    of 0.8 or more."""
    return simhash.deduplicated(docs, near_copies=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to equal weights, up to nine tenths of what is left;
    a document is taken once or not at all."""
    return mixing.mixed_documents(docs, budget=0.9, max_epochs=1)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return unigram.encoded(docs, PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: Fingerprints, rule ensembles and piece ids are beyond SQL; tests/llm compares
#: run() with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
