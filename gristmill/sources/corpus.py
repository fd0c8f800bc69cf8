"""Scans of text corpora, and the corpus as lines of text files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import one_line, text_field
from gristmill.operators.select import buffered_rank, first_rows, quality_filter, shard, shuffle_key
from gristmill.plans.offsets import numbered


def scan(spark: SparkSession, path: str, kind: str = "parquet", schema: Any = None) -> DataFrame:
    """Parquet, JSON lines, CSV, ORC or plain text; lazy, so later filters and columns reach the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return {"parquet": reader.parquet, "json": reader.json, "csv": lambda p: reader.option("header", True).csv(p), "orc": reader.orc, "text": lambda p: spark.read.text(p).withColumnRenamed("value", "text")}[kind](path)


def samples(df: DataFrame, order: str, filters: dict[str, Any] | None = None, index: int = 0, shards: int = 1, buffer: int = 10_000, shuffle: bool = False, seed: int = 0, prioritize: bool | None = None) -> DataFrame:
    """(…, place): a worker's shard, filtered, then ranked in buffers (the default with filters) or shuffled by hash."""
    part = shard(numbered(df, order), "seq", index, shards)
    part = quality_filter(part, filters or {})
    if filters if prioritize is None else prioritize:
        again = numbered(part.drop("seq"), order)
        return buffered_rank(again, "seq", buffer, seed if shuffle else None)
    if shuffle:
        return part.withColumn("place", shuffle_key(seed, "seq"))
    return part.withColumn("place", F.col("seq"))


def texts(df: DataFrame, field: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """(text) of the rows that have one; with a limit, of the first rows in an explicit order."""
    name = text_field(df.dtypes, field)
    if limit is not None:
        if order is None:
            raise ValueError("a limit needs an order")
        df = first_rows(numbered(df, order), "seq", limit)
    return df.where(F.col(name).isNotNull()).select(F.col(name).alias("text"))


def corpus_lines(df: DataFrame, seq: str, chunk: int, text: str = "text") -> DataFrame:
    """(seq, line, chunk, bytes): one line for each text that isn't blank, files of so many lines, bytes with the line end."""
    lines = df.select(F.col(seq).alias("seq"), one_line(F.coalesce(F.col(text), F.lit(""))).alias("line")).where("line <> ''")
    placed = numbered(lines, "seq", "_n")
    return placed.select("seq", "line", F.floor(F.col("_n") / chunk).alias("chunk"), (F.octet_length("line") + 1).cast("long").alias("bytes"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files for each chunk."""
    lines.select("chunk", "line").write.partitionBy("chunk").text(path)


def worker_chunks(df: DataFrame, seq: str, workers: int, limit: int) -> DataFrame:
    """(…, worker): row i goes to worker i mod workers; each takes ceil(limit / workers), the last what remains."""
    each = -(-limit // workers)
    worker = F.col(seq) % workers
    rank = F.floor(F.col(seq) / workers)
    most = F.when(worker < workers - 1, F.lit(each)).otherwise(F.lit(max(0, limit - each * (workers - 1))))
    return df.withColumn("worker", worker.cast("long")).withColumn("in_worker", rank).where(F.col("in_worker") < most)
