"""The folder that driver and executors share: intermediate tables and stream checkpoints go there."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: What ``scratch`` of this thread or task has to remove.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is configured, a folder of this machine is made for a local master; on a cluster that is an
    error, as executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own[app] = tempfile.mkdtemp(dir="/tmp/checkpoints")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    Inside ``scratch`` the table is removed at its end, unless it ``stays``.
    """
    path = new_path(df.sparkSession, name)
    if _scratch.get() and not stays:
        _scratch.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``keep`` wrote inside; results read after that must have been kept with ``stays``."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than there are cores is dealt out over all of them before costly work.

    Larger tables are left as they are; filters and column choices still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
