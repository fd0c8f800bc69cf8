"""Training windows: paired streams, single shards, and windows at random places, drawn where they are cut.

Draws come from a counter-based generator: the number for a place in a run is a hash of the seed and that place, so any
task makes any draw, and a run that is resumed goes on with the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.pack import grid

#: Batches whose draws from one shard go to it together.
TOGETHER = 256


def paired_windows(stream: DataFrame, block: int, size: int, rank: int = 0, world: int = 1) -> DataFrame:
    """(start, input, target) of shards (shard, tokens, labels) with overlap=block - 1, whose labels are shifted already: both windows have block ids."""
    begin = F.col("shard") * size
    starts = grid(begin, F.size("tokens"), F.lit(size), block, 0, rank, world)

    def part(c: str, s: Column) -> Column:
        return F.slice(c, (s - begin + 1).cast("int"), block)

    each = F.transform(starts, lambda s: F.struct(s.alias("start"), part("tokens", s).alias("input"), part("labels", s).alias("target")))
    return stream.select(F.explode(each).alias("x")).select("x.start", "x.input", "x.target")


def shard_windows(shards: DataFrame, block: int) -> DataFrame:
    """(shard, start, input, target): whole windows of each shard by itself; none crosses shards."""
    starts = grid(F.lit(0), F.size("tokens"), F.size("tokens"), block, 1, 0, 1)
    at = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.slice("tokens", (s + 1).cast("int"), block + 1).alias("w")))
    each = shards.select("shard", F.explode(at).alias("x"))
    return each.select("shard", "x.start", F.slice("x.w", 1, block).alias("input"), F.slice("x.w", 2, block).alias("target"))


def drawn(seed: int, stream: str, *counters: Column) -> Column:
    """The number, of 60 bits, that the generator has for a place in a run; streams are independent of each other."""
    place = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[c.cast("string") for c in counters])
    return F.conv(F.substring(F.sha1(place.cast("binary")), 1, 15), 16, 10).cast("long")


def random_starts(spark: SparkSession, total: int, block: int, batch: int, batches: int, seed: int, world: int = 1) -> DataFrame:
    """(batch, rank, i, start): for each rank and batch as many legal starts, any whose number is the rank's modulo the world."""
    legal = total - block
    if legal < world:
        raise ValueError("the stream is too short for a window")
    c = F.col("id")
    rows = spark.range(batches * world * batch).select(F.expr(f"id div {batch * world}").alias("batch"), F.expr(f"id div {batch} % {world}").alias("rank"), (c % batch).alias("i"))
    mine = F.expr(f"({legal} - rank + {world - 1}) div {world}")
    return rows.select("batch", "rank", "i", (drawn(seed, "start", F.col("batch"), F.col("rank"), F.col("i")) % mine * world + F.col("rank")).alias("start"))


def random_windows(stream: DataFrame, starts: DataFrame, block: int, size: int) -> DataFrame:
    """(batch, rank, i, start, input, target) at drawn starts, from shards(…, size, overlap=block).

    Draws travel to their shard's row, some batches' at a time, and windows are cut inside it.
    """
    asked = starts.withColumn("shard", F.expr(f"start div {size}")).groupBy("shard", F.expr(f"batch div {TOGETHER}").alias("_part")).agg(F.collect_list(F.struct("batch", "rank", "i", "start")).alias("asked"))
    begin = F.col("shard") * size
    at = F.transform("asked", lambda a: F.struct(a.alias("a"), F.slice("tokens", (a["start"] - begin + 1).cast("int"), block + 1).alias("w")))
    each = stream.join(asked, "shard").select(F.explode(at).alias("x"))
    return each.select("x.a.*", F.slice("x.w", 1, block).alias("input"), F.slice("x.w", 2, block).alias("target"))


def alias_table(weights: Sequence[int]) -> tuple[list[int], list[int]]:
    """(limits, aliases): a cell drawn evenly is kept if a number below sum(weights) is below its limit, else its alias is taken.

    In whole numbers, so each weight's share is exact. Linear in the weights, of which there is one for each shard.
    """
    n, total = len(weights), sum(weights)
    if not total:
        raise ValueError("no shard is long enough for a window")
    left = [w * n for w in weights]
    limits, aliases = [total] * n, list(range(n))
    low, high = [i for i in range(n) if left[i] < total], [i for i in range(n) if left[i] >= total]
    while low and high:
        i, j = low.pop(), high[-1]
        limits[i], aliases[i] = left[i], j
        left[j] -= total - left[i]
        if left[j] < total:
            low.append(high.pop())
    return limits, aliases


def weighted_starts(spark: SparkSession, lengths: Sequence[int], block: int, batch: int, batches: int, seed: int) -> DataFrame:
    """(batch, i, shard, start): shards by their usable length, starts evenly in each; start counts from the shard's first token.

    The alias table, two numbers a shard, is all that tasks are given.
    """
    weights = [max(0, n - block - 1) for n in lengths]
    limits, aliases = alias_table(weights)
    cells = F.broadcast(spark.createDataFrame(list(zip(range(len(lengths)), limits, aliases, strict=True)), "cell long, limit long, alias long"))
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(map(int, lengths))), "shard long, length long"))
    rows = spark.range(batches * batch).select(F.expr(f"id div {batch}").alias("batch"), (F.col("id") % batch).alias("i"))
    place = (F.col("batch"), F.col("i"))
    thrown = rows.withColumn("cell", drawn(seed, "cell", *place) % len(lengths)).join(cells, "cell")
    kept = drawn(seed, "limit", *place) % sum(weights) < F.col("limit")
    chosen = thrown.select("batch", "i", F.when(kept, F.col("cell")).otherwise(F.col("alias")).alias("shard")).join(sizes, "shard")
    return chosen.select("batch", "i", "shard", (drawn(seed, "place", *place) % (F.col("length") - block)).alias("start"))


def weighted_windows(shards: DataFrame, starts: DataFrame, block: int) -> DataFrame:
    """(batch, i, shard, start, input, target) of weighted_starts()."""
    asked = starts.groupBy("shard", F.expr(f"batch div {TOGETHER}").alias("_part")).agg(F.collect_list(F.struct("batch", "i", "shard", "start")).alias("asked"))
    at = F.transform("asked", lambda a: F.struct(a.alias("a"), F.slice("tokens", (a["start"] + 1).cast("int"), block + 1).alias("w")))
    each = shards.select("shard", "tokens").join(asked, "shard").select(F.explode(at).alias("x"))
    return each.select("x.a.*", F.slice("x.w", 1, block).alias("input"), F.slice("x.w", 2, block).alias("target"))

