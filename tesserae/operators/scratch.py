"""Results that later steps read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, which all executors share; its lineage ends there.

    A local session without that setting has a folder of its own; on a cluster it would be each machine's own, so that is refused.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tesserae-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, which is deleted when the driver ends."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; its shared folder is cleared by whoever made it
        pass
