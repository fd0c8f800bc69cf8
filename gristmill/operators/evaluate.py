"""Benchmark evaluation: items, candidates, a scorer plugged in, first-best choices and accuracies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.text import after_marker, blank_filled, numeric_answer
from gristmill.plans.shipping import ship

#: GSM8K is asked for half as many items.
def item_limit(task: str, limit: int) -> int:
    return max(1, limit // 2) if task == "gsm8k" else limit


def hellaswag(items: DataFrame) -> DataFrame:
    """(id, context, endings, label) of the valid items."""
    label = F.col("label").try_cast("int")
    return items.where((F.size("endings") > 0) & label.isNotNull()).select("id", F.col("ctx").alias("context"), "endings", label.alias("label"))


def arc(items: DataFrame) -> DataFrame:
    at = F.array_position("choices.label", F.col("answerKey")).cast("int") - 1
    return items.where((F.size("choices.text") > 0) & (at >= 0)).select("id", F.col("question").alias("context"), F.col("choices.text").alias("endings"), at.alias("label"))


def piqa(items: DataFrame) -> DataFrame:
    return items.where(F.col("label").isin(0, 1)).select("id", F.col("goal").alias("context"), F.array("sol1", "sol2").alias("endings"), F.col("label").cast("int").alias("label"))


def winogrande(items: DataFrame) -> DataFrame:
    """The blank's two fillings; both share the context before it."""
    whole = (F.col("sentence") != "") & (F.col("option1") != "") & (F.col("option2") != "") & F.col("answer").isin("1", "2")
    filled = [blank_filled(F.col("sentence"), F.col(o)) for o in ("option1", "option2")]
    return items.where(whole).select("id", filled[0]["context"].alias("context"), F.array(*[f["ending"] for f in filled]).alias("endings"), (F.col("answer").cast("int") - 1).alias("label"))


def candidates(items: DataFrame) -> DataFrame:
    """(id, choice, context, ending, label), a row for each ending."""
    return items.select("id", "context", "label", F.posexplode("endings").alias("choice", "ending"))


def scored(rows: DataFrame, make: Callable[[], Callable[[str, str], float]], name: str = "score") -> DataFrame:
    """rows with the log-likelihood that a model, made once for each task, gives an ending after its context."""
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for contexts, endings in batches:
            yield pd.Series([float(model(c or "", e or "")) for c, e in zip(contexts, endings, strict=True)])

    return rows.withColumn(name, run("context", "ending"))


def chosen(rows: DataFrame) -> DataFrame:
    """(id, choice, label): the choice of the highest score, the first of equals."""
    best = F.row_number().over(W.partitionBy("id").orderBy(F.col("score").desc(), "choice"))
    return rows.withColumn("_r", best).where("_r = 1").select("id", "choice", "label")


def accuracy(rows: DataFrame, right: Column) -> DataFrame:
    """(correct, total, accuracy); 0 without items."""
    return rows.agg(F.coalesce(F.sum(right.cast("long")), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(F.lit(0.0)))


def exact_match(answer: Column, generated: Column) -> Column:
    """Whether the generated number is the one after the answer's marker."""
    target = F.coalesce(after_marker(answer), F.lit(""))
    return (target != "") & (numeric_answer(generated) == target)


def aligned_log_likelihood(context: Column, candidate: Column, limit: int) -> tuple[Column, Column]:
    """(ids, first): context and candidate ids for a model of so many positions; only the context is cut, from the left.

    first is where the candidate's ids start among them.
    """
    room = F.greatest(F.lit(0), F.lit(limit) - F.size(candidate))
    kept = F.when(F.size(context) > room, F.slice(context, F.size(context) - room + 1, room)).otherwise(context)
    return F.concat(kept, candidate), F.size(kept)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """Rows (item, …, logit) whose logit is at least the item's k-th; ties stay."""
    return rows.withColumn("_r", F.rank().over(W.partitionBy("item").orderBy(F.col("logit").desc()))).where(F.col("_r") <= k).drop("_r")
