"""Helpers that the corpus operators share: scratch tables, id ranges, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.shipping import ship

#: Rows that a Python function takes at once; bounds what it holds beside the Arrow batch.
SUB_BATCH = 512
SUB_BYTES = 1 << 19
#: Rows of an Arrow batch of whole texts.
ARROW_ROWS = 1000

class _Scratch(threading.local):
    """Scratch paths of this thread's queries, in order; another thread's live tables are none of its business."""

    def __init__(self):
        self.paths: list[str] = []


_scratch = _Scratch()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return str(context.get())
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        spark.sparkContext.setCheckpointDir(folder)
        return shared_dir(spark)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/gristmill-{uuid.uuid4().hex[:12]}-{name}"
    _scratch.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table that materialize() wrote."""
    path = getattr(df, "_gristmill_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_mark() -> int:
    """For drop_since(): how many scratch tables there have been."""
    return len(_scratch.paths)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Remove the scratch tables that this thread has made since, but for those kept."""
    paths = {getattr(df, "_gristmill_path", None) for df in keep}
    for path in _scratch.paths[mark:]:
        if path not in paths:
            delete_path(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, pieces: int) -> list[int]:
    """At most pieces - 1 ascending cut points that deal the values of an integer column into ranges of like size.

    Reads that column alone; the list's length is bounded by the number of partitions, whatever the rows.
    """
    if pieces < 2:
        return []
    cuts = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(F.col(column), cuts, max(1000, 20 * pieces)).alias("b")).first()["b"]
    return sorted({int(x) for x in found}) if found else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = SUB_BATCH) -> Iterator[pa.RecordBatch]:
    """At most so many rows at once, and about SUB_BYTES: what is computed for each byte of a slice is many times its size."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, SUB_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
    trim()


def trim() -> None:
    """Give freed memory back: workers live on between tasks, and share their machine with the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Before texts go to Python: the workers need this package, and smaller Arrow batches than Spark's default of 10,000 rows."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for a Python function."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def texts(column: pa.Array) -> list[str]:
    """Null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
