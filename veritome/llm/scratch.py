"""Shared, recoverable cuts of lineage.

``cut(df)`` writes a Parquet table below the folder that the session names in
``spark.checkpoint.dir`` and reads it back: a lost executor then costs at most
the reading of a file, and nothing lies on a machine's own disk.  Without the setting a
temporary folder is chosen where one machine runs everything, and refused elsewhere.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from veritome.sources.shared import shared_dir

_made: list[tuple[SparkSession, str]] = []


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1500) -> str:
    """Bounds the rows of an Arrow batch in this session, and so what the JVM and Python hold of long texts."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``bound_batches`` for what runs inside."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritome-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._veritome_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in cuts:
        path = getattr(df, "_veritome_path", None)
        if path:
            _delete(df.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone before the interpreter
            continue
