"""Training metrics and schedules as columns."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import words

# The series of a metrics log, and the keys that each may have, in order.
SERIES = {
    "train_loss": ("train_loss",),
    "validation_loss": ("val_loss", "validation_loss"),
    "perplexity": ("validation_perplexity", "perplexity"),
    "train_perplexity": ("train_perplexity",),
    "learning_rate": ("learning_rate", "lr"),
    "tokens_seen": ("tokens_seen",),
    "gradient_norm": ("gradient_norm", "grad_norm"),
    "tokens_per_second": ("tokens_per_second", "log_window_tokens_per_second"),
    "samples_per_second": ("samples_per_second",),
    "step_time_seconds": ("step_time_seconds",),
    "token_progress": ("token_progress_percent",),
    "epoch_equivalent": ("epoch_equivalent",),
    "gpu_memory_allocated": ("gpu_memory_allocated_gb",),
    "gpu_memory_reserved": ("gpu_memory_reserved_gb",),
    "gpu_memory_max_allocated": ("gpu_memory_max_allocated_gb",),
}


def known_names(names: list[str], known: dict) -> tuple[list[str], list[str]]:
    """Names that are known, and those to warn of."""
    return [n for n in names if n in known], [n for n in names if n not in known]


def series(log: DataFrame, name: str, row: str = "row") -> DataFrame:
    """(step, value) of a metrics log whose rows are numbered from 1; rows without the metric are left out."""
    if name not in SERIES:
        raise KeyError(f"no series is called {name}")
    keys = [k for k in SERIES[name] if k in log.columns]
    value = F.coalesce(*[F.col(k).try_cast("double") for k in keys]) if keys else F.lit(None).cast("double")
    step = F.coalesce(F.col("step").try_cast("double") if "step" in log.columns else F.lit(None).cast("double"), F.col(row).cast("double"))
    return log.select(step.alias("step"), value.alias("value")).where(F.col("value").isNotNull())


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(100.0), loss))


def weighted_loss(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """(loss, perplexity): the mean over tokens."""
    return df.agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("loss")).withColumn("perplexity", perplexity(F.col("loss")))


def bits_per_character(loss: Column, tokens_per_char: Column) -> Column:
    return loss * tokens_per_char / F.lit(math.log(2))


def character_perplexity(loss: Column, tokens_per_char: Column) -> Column:
    return F.exp(loss * tokens_per_char)


def fertility(df: DataFrame, text: Column, tokens: Column) -> DataFrame:
    """(tokens_per_word, tokens_per_char, chars_per_token) over totals."""
    total = df.agg(F.sum(tokens).alias("t"), F.sum(F.size(words(text))).alias("w"), F.sum(F.length(text)).alias("c"))
    return total.select(F.try_divide("t", "w").alias("tokens_per_word"), F.try_divide("t", "c").alias("tokens_per_char"), F.try_divide("c", "t").alias("chars_per_token"))


def learning_rate(step: Column, base: float, warmup: int, total: int, least: float) -> Column:
    """After so many completed steps: a linear rise, then half a cosine down to the least rate."""
    at = F.greatest(F.lit(1), step + 1)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at - warmup) / F.lit(float(max(1, total - warmup)))))
    down = F.lit(least) + F.lit(base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when((F.lit(warmup) > 0) & (at <= warmup), F.lit(base) * at / F.lit(float(max(1, warmup)))).otherwise(down)


def legacy_learning_rate(step: Column, base: float, warmup: int, total: int, least: float) -> Column:
    ratio = least / base
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
    down = F.lit(ratio) + F.lit(1 - ratio) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.lit(base) * F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(down)


def tokens_per_step(micro: int, accumulation: int, context: int, world: int = 1) -> int:
    return micro * accumulation * context * max(1, world)


def total_steps(per_step: int, max_steps: int | None = None, max_tokens: int | None = None) -> int:
    """The lesser of the step limit and the steps that the token limit allows, one at least."""
    limits = [x for x in (max_steps, None if max_tokens is None else -(-max_tokens // per_step)) if x is not None]
    if not limits:
        raise ValueError("a step or a token limit is needed")
    return max(1, min(limits))


def should_continue(step: Column, tokens: Column, max_steps: int | None, max_tokens: int | None) -> Column:
    out = F.lit(True)
    if max_steps is not None:
        out = out & (step < max_steps)
    return out if max_tokens is None else out & (tokens < max_tokens)


def package_tokens(configured: int | None, per_step: int, context: int) -> int:
    """Tokens of a training package: as configured or 32 steps, never less than a step or a window."""
    return max(configured or 32 * per_step, per_step, context + 1)


def run_lengths(runs: DataFrame) -> DataFrame:
    """runs (micro, accumulation, context, world, max_steps, max_tokens, package_tokens, …) with steps and package, as total_steps() and package_tokens() have them."""
    per = F.col("micro") * F.col("accumulation") * F.col("context") * F.greatest(F.lit(1), F.col("world"))
    by_tokens = F.call_function("div", F.col("max_tokens") + per - 1, per)
    limit = F.coalesce(F.least("max_steps", by_tokens), F.raise_error(F.lit("a step or a token limit is needed")).cast("long"))
    package = F.greatest(F.when(F.col("package_tokens") > 0, F.col("package_tokens")).otherwise(32 * per), per, F.col("context") + 1)
    return runs.withColumn("steps", F.greatest(F.lit(1), limit).cast("long")).withColumn("package", package.cast("long"))


def progress(steps: DataFrame, per_step: int, batch: int, corpus_tokens: int, max_tokens: int | None) -> DataFrame:
    """steps (step, step_time_seconds) with tokens_seen, rates, epochs and the share of the token budget."""
    seen = F.col("step") * per_step
    seconds = F.greatest(F.lit(1e-9), F.col("step_time_seconds"))
    share = F.least(F.lit(1.0), seen / F.lit(float(max_tokens))) if max_tokens else F.lit(None).cast("double")
    return steps.select("step", seen.alias("tokens_seen"), (F.lit(float(per_step)) / seconds).alias("tokens_per_second"), (F.lit(float(batch)) / seconds).alias("samples_per_second"), (seen / F.lit(float(max(1, corpus_tokens)))).alias("epoch_equivalent"), (share * 100).alias("token_progress_percent"))


def log_window_rate(log: DataFrame, per_step: int, every: int) -> DataFrame:
    """Tokens for each second between one logged row and the one before; the rows of one run's log are few."""
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(W.partitionBy("run").orderBy("step"))
    return log.withColumn("log_window_tokens_per_second", F.lit(float(per_step * every)) / F.greatest(F.lit(1e-9), gap))


def parameter_rollup(parameters: DataFrame) -> DataFrame:
    """(bucket, parameters) of (name, n), by the first pattern that a name fits."""
    n = F.col("name")
    bucket = F.when(n.startswith("tok_embeddings."), "embedding").when(n.contains(".attn."), "attention").when(n.contains(".mlp."), "ffn").when(n.startswith("lm_head."), "lm_head").when(n.contains("norm"), "norm").otherwise("other")
    return parameters.groupBy(bucket.alias("bucket")).agg(F.sum("n").cast("long").alias("parameters"))


def ffn_width(d_model: Column, multiple: int, ratio: float = 8 / 3) -> Column:
    """The hidden width, rounded up to a multiple."""
    return (F.ceil(F.floor(d_model * ratio) / multiple) * multiple).cast("long")


def marked(rows: DataFrame, column: str, known: Iterable[str]) -> DataFrame:
    """rows with whether a name is known; the others stay, for a warning."""
    return rows.withColumn("known", F.col(column).isin(*known))


def compared(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Two runs side by side: (on, a, b, difference)."""
    return a.select(on, F.col(value).alias("a")).join(b.select(on, F.col(value).alias("b")), on).withColumn("difference", F.col("a") - F.col("b"))
