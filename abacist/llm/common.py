"""Shared pieces of the training-data operators: reading tables, scratch tables, word rules.

Scratch tables are Parquet tables below ``spark.checkpoint.dir``: they cut lineage, survive lost
executors, and are seen by the driver and every executor.  ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _drop(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be going down
        pass


def release() -> None:
    """Delete the scratch tables made so far; results that still read them become invalid."""
    while _made:
        _drop(_made.pop())


atexit.register(release)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a scratch table."""
    _made.append(f"{scratch_root(spark)}/abacist/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a scratch Parquet table and read it back."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` was read from, once nothing reads it any more."""
    for path in list(_made):
        if any(path in f for f in df.inputFiles()):
            _made.remove(path)
            _drop(path)


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``size`` bytes of the text column; a longer text is a piece of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        ends = lengths.cumsum() // size
        start = 0
        for stop in [*((ends[1:] != ends[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]:
            if stop > start:
                yield batch.slice(start, stop - start)
            start = stop


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside: a batch is held by the JVM and by the worker of each core."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
