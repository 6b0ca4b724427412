"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

CHECKPOINT_KEY = "spark.checkpoint.dir"


def tuned_session(app: str = "plumbline", master: str | None = None, **conf) -> SparkSession:
    """Build a session.  ``conf`` keys use ``__`` for dots: ``spark__driver__memory="8g"``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temp folder only for an unset local session."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


_OPEN: list[list[str]] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what operators write under the shared folder inside this block.

    Results that read such tables must be written elsewhere or collected before the block ends.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives lost executors, so later stages never recompute what lies before it.  A
    ``workspace`` around the job drops it at the end.  ``options`` are those of the writer.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession) -> None:
    """Let the driver give back memory, and Spark the shuffle files and broadcasts that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores; text work per row is worth the move.

    A large table has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
