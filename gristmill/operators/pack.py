"""Cutting token streams into shards, packages and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.offsets import running


def placed(docs: DataFrame, seq: str, n: str) -> DataFrame:
    """docs with the offset of each in the stream of all."""
    return running(docs, seq, {"start": F.col(n)})


def shard_spans(docs: DataFrame, n: str, size: int, start: str = "start", overlap: int = 0) -> DataFrame:
    """(…, shard, low, high): the part [low, high) of each document that lies in each shard of so many tokens.

    With an overlap a shard also takes in as many tokens of what follows it.
    """
    first, last = F.floor((F.col(start) - overlap) / size), F.floor((F.col(start) + F.col(n) - 1) / size)
    spread = docs.where(F.col(n) > 0).withColumn("shard", F.explode(F.sequence(F.greatest(F.lit(0), first), last)))
    low = F.greatest(F.lit(0), F.col("shard") * size - F.col(start))
    high = F.least(F.col(n), (F.col("shard") + 1) * size + overlap - F.col(start))
    return spread.withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))


def pieces(docs: DataFrame, columns: list[str], n: str, size: int, start: str = "start", overlap: int = 0) -> DataFrame:
    """(shard, start, …): what each shard takes of each document's arrays, and where in the stream that begins."""
    spans = shard_spans(docs, n, size, start, overlap)
    parts = [F.slice(c, (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias(c) for c in columns]
    return spans.select("shard", (F.col(start) + F.col("low")).alias("start"), *parts)


def shards(docs: DataFrame, tokens: str, n: str, size: int, start: str = "start", overlap: int = 0, labels: str | None = None) -> DataFrame:
    """(shard, tokens[, labels]): documents straddle shards, the last one is short. A shard's size bounds each group.

    An overlap repeats the first tokens of what follows at each shard's end, so that windows can be cut inside a row; that
    is all that is shuffled twice.
    """
    columns = [tokens, *([labels] if labels else [])]
    parts = pieces(docs, columns, n, size, start, overlap)
    listed = F.array_sort(F.collect_list("p"))
    # a field of an array of structs is the array of that field
    whole = [F.flatten(F.col(f"ps.{c}")).alias(name) for c, name in zip(columns, ("tokens", "labels"), strict=False)]
    return parts.select("shard", F.struct("start", *columns).alias("p")).groupBy("shard").agg(listed.alias("ps")).select("shard", *whole)


def grid(begin: Column, held: Column, own: Column, block: int, more: int, rank: int, world: int) -> Column:
    """The starts of a grid of whole blocks, strided over ranks, that lie among a row's `own` first tokens and end among those it holds."""
    step = block * world
    first = F.lit(rank * block) + F.ceil(F.greatest(F.lit(0), begin - rank * block) / step) * step
    last = F.least(begin + own - 1, begin + held - block - more)
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long")))


def window_starts(spark: SparkSession, total: int, block: int, rank: int = 0, world: int = 1, shifted: bool = False) -> DataFrame:
    """(start) of evaluation windows: a grid of whole blocks, strided over ranks. Plain windows need one token more than shifted ones."""
    last = total - block - (0 if shifted else 1)
    return spark.range(rank * block, max(rank * block, last + 1), block * world).withColumnRenamed("id", "start")


def windows(stream: DataFrame, block: int, size: int, rank: int = 0, world: int = 1) -> DataFrame:
    """(start, input, target) of a rank's grid, from shards(…, size, overlap=block): each is cut inside its shard's row.

    Rows may have a column `begin`, the place of their first token, in place of a shard's number.
    """
    rows = stream if "begin" in stream.columns else stream.withColumn("begin", F.col("shard") * size)
    return cut(rows.withColumn("starts", grid(F.col("begin"), F.size("tokens"), F.lit(size), block, 1, rank, world)), block)


def cut(rows: DataFrame, block: int) -> DataFrame:
    """(start, input, target): windows of rows (begin, tokens, starts), starts being places in the stream; the row's array is not repeated."""
    at = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("tokens", (s - F.col("begin") + 1).cast("int"), block + 1).alias("w")))
    each = rows.select(F.explode(at).alias("x")).select("x.start", "x.w")
    return each.select("start", F.slice("w", 1, block).alias("input"), F.slice("w", 2, block).alias("target"))


def batches(starts: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """starts with a batch number; the last batch may be short."""
    out = running(starts, "start", {"_n": F.lit(1)}).withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    return out if limit is None else out.where(F.col("batch") < limit)


def packages(docs: DataFrame, n: str, size: int, start: str = "start") -> DataFrame:
    """(package, source, samples, tokens): what each package of so many tokens holds of each source."""
    spans = shard_spans(docs, n, size, start)
    return spans.groupBy(F.col("shard").alias("package"), "source").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.col("high") - F.col("low")).alias("tokens"))
