"""The whole way from raw documents to budgeted token streams, and from weighted sources to packages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.functions.text import formatted, strip
from gristmill.operators import budget, mix, pack, sft
from gristmill.operators.tokenize import Tokenizer, encode
from gristmill.plans import staging
from gristmill.plans.offsets import numbered, running
from gristmill.plans.shipping import ship
from gristmill.plans.staging import keep
from gristmill.sources.config import Source
from gristmill.sources.retry import with_retries


def tokenize_corpus(docs: DataFrame, order: str, make: Callable[[], Tokenizer], staging: str, train: int, validation: int, ratio: float | None = None, salt: str = "", eos: int | None = None, truncate: bool = True, least: int = 1) -> DataFrame:
    """(seq, split, start, tokens): documents stripped, encoded, routed by hash under two budgets, cut at them.

    Ids are encoded once, into a staging table; only lengths go through the two ordered passes.
    """
    spark = docs.sparkSession
    clean = docs.select(F.col(order).alias("_order"), strip(F.coalesce(F.col("text"), F.lit(""))).alias("text")).where("text <> ''")
    held = hashing.is_validation(F.col("text"), hashing.validation_ratio(train, validation, ratio), salt)
    encode(clean, "text", make, eos=eos).select("_order", held.alias("held"), F.size("ids").cast("long").alias("n"), "ids").where(F.col("n") >= least).write.parquet(staging)
    staged = spark.read.parquet(staging)
    routed = budget.route(numbered(staged.select("_order", "held", "n"), "_order"), "seq", "n", "held", train, validation, truncate)
    # stored, its size is known: where the budgets take few documents they are broadcast, and no ids are shuffled
    taken = keep(routed.select("_order", "seq", "split", "start", "written"))
    kept = taken.join(staged.select("_order", "ids"), "_order")
    return kept.select("seq", "split", "start", F.slice("ids", F.lit(1), F.col("written").cast("int")).alias("tokens"))


def stats(routed: DataFrame) -> DataFrame:
    """(split, documents, tokens)."""
    return routed.groupBy("split").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tokens")).cast("long").alias("tokens"))


def prepared(source: Source, df: DataFrame, order: str, partition: str, ratio: float, supervised: bool) -> DataFrame:
    """(seq, text or messages) of a source's samples in its range and partition that format to something."""
    columns = [c for c in df.columns if c != order]
    picked = df.where(hashing.in_range(columns, *source.sample_range, source.range_key)).where(hashing.in_partition(columns, partition, ratio))
    if supervised:
        rows = picked.select(F.col(order).alias("_order"), sft.messages(columns, source.format).alias("messages")).where(F.size("messages") > 0)
    else:
        rows = picked.select(F.col(order).alias("_order"), formatted(columns, source.format).alias("text")).where("text <> ''")
    return numbered(rows, "_order").drop("_order")


def opened(sources: Sequence[Source], open_: Callable[[str, str | None, str], DataFrame]) -> dict[str, DataFrame]:
    """The sources' rows by name; a data set's split is opened once, however many sources draw on it."""
    found: dict[tuple[str, str | None, str], DataFrame] = {}
    for s in sources:
        key = (s.dataset_id, s.config_name, s.split)
        if key not in found:
            found[key] = with_retries(lambda key=key: open_(*key))
    return {s.name: found[s.dataset_id, s.config_name, s.split] for s in sources}


def check_sources(sources: Sequence[Source], frames: dict[str, DataFrame], order: str, supervised: bool = False) -> None:
    """An error for a source that isn't there or has no usable sample; looks no further than the first one."""
    for s in sources:
        if s.name not in frames:
            raise ValueError(f"no data for source {s.name}")
        ship(frames[s.name].sparkSession)
        columns = [c for c in frames[s.name].columns if c != order]
        made = sft.messages(columns, s.format) if supervised else formatted(columns, s.format)
        usable = F.size(made) > 0 if supervised else made != ""
        if frames[s.name].where(hashing.in_range(columns, *s.sample_range, s.range_key)).where(usable).isEmpty():
            raise ValueError(f"source {s.name} has no usable sample in its range")


def mixture(sources: Sequence[Source], frames: dict[str, DataFrame], order: str, make: Callable[[], Tokenizer], target: int, seed: int, window: int, eos: int, partition: str = "train", ratio: float = 0.0, bos: int | None = None) -> DataFrame:
    """(slot, source, seq, n, ids, start) of a weighted mixture with at least `target` tokens.

    A source without a usable sample is an error before anything is encoded. Each source is encoded once, into a shared folder. How many slots are needed is told from the sources' mean lengths and
    tried on lengths alone; ids are joined to the slots that the target takes in.
    """
    spark = next(iter(frames.values())).sparkSession
    check_sources(sources, frames, order)
    head = [F.array(F.lit(bos))] if bos is not None else []
    ready, mean = {}, {}
    for s in sources:
        coded = encode(prepared(s, frames[s.name], order, partition, ratio, False), "text", make)
        ready[s.name] = staging.keep(coded.select("seq", F.concat(*head, "ids", F.array(F.lit(eos))).alias("ids")).withColumn("n", F.size("ids").cast("long")))
        mean[s.name] = ready[s.name].agg(F.avg("n")).first()[0] or 0.0
    counts = dict(zip((s.name for s in sources), mix.slot_counts([s.target_tokens for s in sources], window, seed), strict=True))
    size = sum(counts.values())
    n = size * (1 + int(target / max(1.0, sum(mean[s] * c for s, c in counts.items()))))
    while True:
        plan = mix.slots(spark, sources, n, seed, window)
        need = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = {s.name: mix.epochs(ready[s.name].select("seq", "n"), need[s.name], seed + 17 * (i + 1)).select("k", "seq", "n") for i, s in enumerate(sources) if s.name in need}
        placed = staging.keep(running(mix.interleave(plan, parts), "slot", {"start": F.col("n")}))
        if (placed.agg(F.sum("n")).first()[0] or 0) >= target:
            every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), "seq", "ids") for name, df in ready.items()])
            return placed.where(F.col("start") < target).join(every, ["source", "seq"]).select("slot", "source", "seq", "n", "ids", "start")
        n += max(size, n // 4)


def packages(mixed: DataFrame, size: int) -> DataFrame:
    """(package, source, samples, tokens)."""
    return pack.packages(mixed, "n", size)


def manifest(routed: DataFrame, **more: Any) -> dict[str, Any]:
    """What a token run's manifest says: counts for each split, and the settings given."""
    counted = {r["split"]: r for r in stats(routed).collect()}
    return {**more, **{f"{s}_tokens": counted[s]["tokens"] if s in counted else 0 for s in ("train", "validation")}, **{f"{s}_documents": counted[s]["documents"] if s in counted else 0 for s in ("train", "validation")}}
