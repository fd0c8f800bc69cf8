"""Packages of training tokens from a stream of documents, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.pack import shard_spans
from gristmill.plans.offsets import running
from gristmill.sources.logs import read_manifest, write_manifest


def package_batch(size: int, out: str, state: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: appends each micro-batch's documents (seq, source, n) to packages of `size` tokens.

    The offset where the stream stands is kept in a manifest beside the batch's number. A batch that is run again after a
    failure starts from the same offset and overwrites its own partition, so every document is written once.
    """

    def run(batch: DataFrame, number: int) -> None:
        kept = read_manifest(state)
        done = {int(k): v for k, v in kept.get("offsets", {}).items()}
        start = done.get(number, kept.get("end", 0))
        placed = running(batch, "seq", {"start": F.col("n")}).withColumn("start", F.col("start") + start)
        spans = shard_spans(placed, "n", size).withColumnRenamed("shard", "package")
        spans.write.mode("overwrite").partitionBy("package").parquet(f"{out}/batch={number}")
        total = batch.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        write_manifest(state, {"offsets": {number: start}, "end": start + total})

    return run


def stream_packages(docs: DataFrame, size: int, out: str, state: str, checkpoint: str):
    """Start a query over a streaming DataFrame (seq, source, n) that ends when all that is there has been packed."""
    return docs.writeStream.foreachBatch(package_batch(size, out, state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_package(spark, out: str, package: int) -> None:
    """Delete a package that has been used, in every batch's folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=*/package={package}")) or ():
        fs.delete(found.getPath(), True)


def forget_last(spark, checkpoint: str) -> None:
    """Drop the note that a stopped query's last batch is done, so that it is run again, as after the loss of its driver."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().isdigit()]
    if done:
        fs.delete(max(done, key=lambda p: int(p.getName())), False)
