"""Weighted mixtures: slots for sources in permuted windows, epochs, and the interleaved stream."""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.permute import permuted_column
from gristmill.plans.offsets import running
from gristmill.plans.shipping import ship
from gristmill.sources.config import Source


#: Slots that one task makes.
TASK_SLOTS = 1 << 20


class Windows:
    """Windows of slots, every one with the same slots in another order.

    The order for a seed is a fixed behaviour that stored mixtures depend on: Python's generator is drawn from once for
    each source that could get or lose a slot, at every step of the apportionment, and then shuffles window after window.
    """

    def __init__(self, weights: Sequence[int], size: int, seed: int):
        self.random = random.Random(seed)
        size = max(len(weights), int(size))
        self.shares = [w * size / sum(weights) for w in weights]
        self.counts = [max(1, int(s)) for s in self.shares]
        everyone = range(len(weights))
        while sum(self.counts) < size:
            # always the largest fraction of a whole share, so all that is missing goes to one source but for ties
            self.counts[self.extreme(everyone, lambda i: self.shares[i] % 1, max)] += 1
        while sum(self.counts) > size and max(self.counts) > 1:
            self.counts[self.extreme([i for i in everyone if self.counts[i] > 1], lambda i: self.shares[i] - self.counts[i], min)] -= 1
        self.size = sum(self.counts)
        self.slots = [i for i, c in enumerate(self.counts) for _ in range(c)]

    def extreme(self, places: Sequence[int], value: Callable[[int], float], pick: Callable) -> int:
        """The place with the least or largest value; the numbers drawn decide among equals."""
        return pick([(value(i), self.random.random(), i) for i in places])[2]

    def next(self) -> list[int]:
        """The source of each slot of the next window."""
        order = self.slots.copy()
        self.random.shuffle(order)
        return order


def slot_counts(weights: Sequence[int], window: int, seed: int = 0) -> list[int]:
    """Slots of each source in a window."""
    return Windows(weights, window, seed).counts


def slot_names(sources: Sequence[Source], seed: int, window: int) -> Iterator[str]:
    """The source of each slot, without end."""
    if len(sources) == 1:
        return repeat(sources[0].name)
    windows = Windows([s.target_tokens for s in sources], window, seed)
    return (sources[i].name for order in iter(windows.next, None) for i in order)


def slots(spark: SparkSession, sources: Sequence[Source], n: int, seed: int, window: int) -> DataFrame:
    """(slot, source, k): slot takes the k-th sample of its source, from 0.

    The driver runs the generator over all windows, as it can't jump, and keeps its state for each TASK_SLOTS slots; the
    slots themselves are made in tasks. As all windows hold the same counts, k follows from the window's number.
    """
    names = [s.name for s in sources]
    if len(sources) == 1:
        return spark.range(n).select(F.col("id").alias("slot"), F.lit(names[0]).alias("source"), F.col("id").alias("k"))
    ship(spark)
    plan = Windows([s.target_tokens for s in sources], window, seed)
    step, states = max(1, TASK_SLOTS // plan.size), []
    for first in range(0, -(-n // plan.size), step):
        states.append((first, pickle.dumps(plan.random.getstate())))
        if (first + step) * plan.size < n:
            for _ in range(step):
                plan.next()

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, state in zip(frame["first"], frame["state"], strict=True):
                plan.random.setstate(pickle.loads(state))
                for w in range(first, min(first + step, -(-n // plan.size))):
                    order = pd.Series(plan.next())
                    k = order.groupby(order).cumcount() + w * order.map(dict(enumerate(plan.counts)))
                    yield pd.DataFrame({"slot": w * plan.size + order.index, "source": order.map(dict(enumerate(names))), "k": k})

    starts = spark.createDataFrame(states, "first long, state binary").repartition(max(1, len(states)))
    return starts.mapInPandas(make, "slot long, source string, k long").where(F.col("slot") < n)


def epochs(samples: DataFrame, need: int, seed: int, order: str = "seq") -> DataFrame:
    """(…, k): a source's samples, over and over until there are `need`, each epoch in another order.

    The order is that of the first 40 bits of sha1("seed + epoch:order"), ties by the order column.
    """
    have = samples.count()
    if not have:
        raise ValueError("a source without samples can't fill a mixture")
    times = -(-need // have)
    spread = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(times, 1) - 1).cast("long"))))
    key = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed) + F.col("epoch"), F.col(order)).cast("binary")), 1, 10), 16, 10).cast("long")
    whole = spread.withColumn("_order", F.col("epoch") * F.lit(1 << 40) + key)
    return running(whole, "_order", {"k": F.lit(1)}, order).where(F.col("k") < need).drop("_order", "epoch")


def interleave(slots_: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """(slot, source, …) in the order of slots: each takes the k-th sample of its source. Sources are (k, …) of one schema."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return slots_.join(reduce(DataFrame.unionByName, named), ["source", "k"])


def permuted(slots_: DataFrame, sources: dict[str, DataFrame], seed: int) -> DataFrame:
    """(slot, source, k, epoch, …) in the order of slots: each takes the next sample of its source's epoch, in that epoch's keyed permutation.

    Sources are (seq, …) of one schema, numbered from 0. The sample is computed from the slot, so no epoch is written out
    and none is sorted; slots meet their samples in one join.
    """
    named, parts = [], []
    for name, df in sources.items():
        have = df.count()
        if not have:
            raise ValueError(f"source {name} has no samples")
        own = slots_.where(F.col("source") == name).withColumn("epoch", F.expr(f"k div {have}"))
        parts.append(own.withColumn("seq", permuted_column(F.col("k") % have, have, F.lit(seed) + F.col("epoch"))))
        named.append(df.withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).join(reduce(DataFrame.unionByName, named), ["source", "seq"])


def shares(rows: DataFrame, value: str, name: str = "weight") -> DataFrame:
    """rows, one for each source, with each one's share of all."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.join(F.broadcast(total)).withColumn(name, F.col(value) / F.col("_total")).drop("_total")


def weights(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """(name, target_tokens, weight): each source's share of all tokens."""
    return shares(spark.createDataFrame([(s.name, s.target_tokens) for s in sources], "name string, target_tokens long"), "target_tokens")
