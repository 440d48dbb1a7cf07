"""Folders for tables that an operator writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The tables' folder of each application that has any.
_opened: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """This application's own folder in the shared one that spark.checkpoint.dir names.

    Where that is unset, a temporary folder serves a local master; on a cluster other machines couldn't read it, so
    there it is an error.  The folder goes, with all tables in it, when the driver's JVM ends.
    """
    context = spark.sparkContext
    if context.applicationId in _opened:
        return _opened[context.applicationId]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    own = context._jvm.org.apache.hadoop.fs.Path(f"{named.rstrip('/')}/tables-{context.applicationId}")
    files = own.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    _opened[context.applicationId] = own.toString()
    return _opened[context.applicationId]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once as a table in the shared folder; later steps read it whatever becomes of executors.

    Unlike DataFrame.checkpoint() this computes the rows once, and keeps them compressed and in columns.
    """
    path = folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
