"""Cutting lineage by writing a table to the shared checkpoint folder.

Iterative operators write each round as parquet and read it back: the next
round's plan starts at a scan, a lost executor costs only its tasks, and the
scan carries real sizes, so joins against small rounds are broadcast only after
their size is known.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())  # each thread has its own


def work_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="quadrille-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is staged inside once it is left, but for tables staged with ``survives``."""
    mine: list[str] = []
    outer = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(outer)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in mine:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table now, before its scope is left."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_deleted(spark: SparkSession):
    """Inside, what a query shuffled is deleted when it ends, not when the driver forgets the query."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def small_batches(spark: SparkSession, rows: int):
    """Inside, wide rows are read and passed to Python at most ``rows`` at a time, so that no buffer holds thousands."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": str(rows)})


def stage(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None, survives: bool = False,
          packed: bool = False) -> DataFrame:
    """Write ``df`` now and return a scan of it.  Inside ``scratch`` the table goes with the innermost scope, or with
    the one around it if it ``survives``.  ``packed`` tables hold numbers near each other, which differences tell in fewer bytes."""
    spark = df.sparkSession
    path = new_path(spark, label)
    scopes = _scopes.get()[:-1] if survives else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    writer = df.write
    if packed:
        writer = writer.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


stage_packed = partial(stage, packed=True)


def width(spark: SparkSession) -> int:
    """Partition count for explicit repartitioning."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)
