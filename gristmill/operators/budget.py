"""Routing documents to train and validation under exact token budgets, and cutting at the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.plans.offsets import running


def route(docs: DataFrame, seq: str, n: str, held: str, train_target: int, validation_target: int, truncate: bool = True) -> DataFrame:
    """(…, split, start, written) of the documents that get a place, in order.

    A document whose hash holds it out goes to validation until that is full, others go to train; when one is full, all
    the rest goes to the other. With truncate the last document is cut at the target, else it may exceed it. Two passes
    over the lengths: where each side fills up by hash alone, then the places on each side.
    """
    by_hash = running(docs, seq, {"_val": F.when(F.col(held), F.col(n)), "_train": F.when(~F.col(held), F.col(n))})
    full_val = F.min(F.when(F.col("_val") + F.when(F.col(held), F.col(n)).otherwise(0) >= validation_target, F.col(seq)))
    full_train = F.min(F.when(F.col("_train") + F.when(F.col(held), 0).otherwise(F.col(n)) >= train_target, F.col(seq)))
    at = by_hash.agg(full_val.alias("val"), full_train.alias("train")).first()
    never = 1 << 62
    val, train = (never if at["val"] is None else at["val"]), (never if at["train"] is None else at["train"])
    later = "train" if val <= train else "validation"
    split = F.when(F.col(seq) <= min(val, train), F.when(F.col(held), "validation").otherwise("train")).otherwise(later)
    routed = running(docs.withColumn("split", split), seq, {"_v": F.when(F.col("split") == "validation", F.col(n)), "_t": F.when(F.col("split") == "train", F.col(n))})
    start = F.when(F.col("split") == "train", F.col("_t")).otherwise(F.col("_v"))
    target = F.when(F.col("split") == "train", F.lit(train_target)).otherwise(F.lit(validation_target))
    placed = routed.withColumns({"start": start, "_target": target}).where(F.col("start") < F.col("_target"))
    written = F.least(F.col(n), F.col("_target") - F.col("start")) if truncate else F.col(n)
    return placed.withColumn("written", written.cast("long")).drop("_v", "_t", "_target")


def budgeted(docs: DataFrame, seq: str, n: str, target: int, already: int = 0) -> DataFrame:
    """(…, start, written, skipped) of a single writer with a target; `already` ids are there before."""
    placed = running(docs, seq, {"start": F.col(n)}).withColumn("start", F.col("start") + already)
    written = F.greatest(F.lit(0), F.least(F.col(n), F.lit(target) - F.col("start"))).cast("long")
    return placed.withColumn("written", written).withColumn("skipped", (F.col(n) - F.col("written")).cast("long"))


def worker_targets(target: int, workers: int) -> int:
    return -(-target // workers)


def by_workers(docs: DataFrame, worker: str, seq: str, n: str, target: int, workers: int) -> DataFrame:
    """(…, start, written) of workers that each write up to their share of the target, one after the other, cut at the target."""
    order = docs.withColumn("_order", F.col(worker) * F.lit(1 << 40) + F.col(seq))
    placed = running(order, "_order", {"_at": F.col(n)})
    # a row for each worker
    first = F.broadcast(placed.groupBy(worker).agg(F.min("_at").alias("_first")))
    own = F.least(F.col(n), F.greatest(F.lit(0), F.lit(worker_targets(target, workers)) - (F.col("_at") - F.col("_first"))))
    shares = placed.join(first, worker).withColumn("_own", own.cast("long")).where("_own > 0").drop("_at", "_first")
    return budgeted(shares, "_order", "_own", target).where("written > 0").drop("_order", "_own", "skipped")


def merged(parts: DataFrame, worker: str, seq: str, n: str, target: int) -> DataFrame:
    """Outputs of workers one after the other, cut at the target: (…, start, written)."""
    order = parts.withColumn("_order", F.col(worker) * F.lit(1 << 40) + F.col(seq))
    return budgeted(order, "_order", n, target).where("written > 0").drop("_order", "skipped")


def resumed(workers: DataFrame, shards: DataFrame, counts: list[str]) -> DataFrame:
    """workers (worker_index, …) with the counts that an earlier run's shards (worker_index, place, …) left them, 0 where there are none.

    Shards without a worker are passed over; of several of one worker the last place counts.
    """
    last = shards.where("worker_index IS NOT NULL").groupBy("worker_index").agg(*[F.max_by(c, "place").alias(c) for c in counts])
    joined = workers.join(last, "worker_index", "left")
    return joined.select(*workers.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
