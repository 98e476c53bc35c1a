"""Tables between the jobs of one operator, in storage that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_collectors: list[list[str]] = []
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without the setting a local session gets a fresh one of its own; a cluster,
    whose machines share no temporary folder, an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: its lineage ends there.

    A lost executor costs only a new read of these files, and rows that depend on task numbers
    (chunk ids, running totals) stay what they were when they were written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for c in _collectors[-1:]:
        c.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(spark: SparkSession, tables: Iterable[DataFrame | str]) -> None:
    """Delete tables of written(), given themselves or by path, that nothing will read any more."""
    for t in tables:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.scratch_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """Add the paths of all tables written inside to ``paths``."""
    _collectors.append(paths)
    try:
        yield
    finally:
        _collectors.pop()


@contextmanager
def small_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Jobs run inside send rows to Python in batches of at most about ``n_bytes`` (or one row). Spark's own bound is 64 MB, for
    which an executor holds buffers beside its heap, and its Python workers as much again.
    """
    was = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if was is None else spark.conf.set(BATCH_BYTES, was)
