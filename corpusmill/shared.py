"""Places that the driver and every executor can see, and tables written there."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
_lock, _writers, _before = threading.Lock(), 0, "false"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a session in local mode may lack that setting; it then gets a folder of
    its own. A cluster session without it is refused, as a local folder would
    differ from machine to machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI in the shared one."""
    return f"{_scratch.get() or shared_root(spark)}/corpusmill-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, new folders lie in one that is removed at its end. What outlives it
    has to be written, before it ends, at a path that was made before it began."""
    folder = shared_dir(spark)
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go with the query that made them. The setting is the session's; it is
    put back when the last of several threads that write is done."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(CLEANUP, _before)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later jobs
    start from the files, so a lost executor costs no recomputation before them.
    Its shuffle files are of no more use then and go at once."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table"
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
