"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir; under a temporary one only where that is unset and Spark runs locally."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="gristmill-")
    return f"{top.rstrip('/')}/gristmill-staging-{uuid.uuid4().hex[:12]}"


def keep(df):
    """df written to a shared folder and read again: what is used several times is computed once, and survives executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def drop(*kept) -> None:
    """Remove what keep() wrote, once nothing reads it any more."""
    for df in kept:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gristmill_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
