"""Supervised pairs from conversations: tokens with labels that mask what the model isn't to learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import normal_messages, question_answer, strip, turn_texts

#: Labels of ids that carry no loss.
IGNORED = -100


def messages(columns: list[str], kind: str) -> Column:
    """Normalised messages of a row: its own, or a question and answer, or its text as one answer."""
    none = F.array().cast("array<struct<role: string, content: string>>")

    def one(role: str, c: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), c.alias("content"))

    text = strip(F.coalesce(F.col("text"), F.lit(""))) if "text" in columns else F.lit("")
    out = F.when(text != "", F.array(one("assistant", text))).otherwise(none)
    if {"question", "answer"} <= set(columns):
        q, a = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer"))
        out = F.when(question_answer(F.col("question"), F.col("answer")) != "", F.array(one("user", q), one("assistant", a))).otherwise(out)
    if "messages" in columns:
        out = F.when(F.size(F.coalesce(F.col("messages"), none)) > 0, normal_messages(F.col("messages"))).otherwise(out)
    return out


def from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from a row for each turn."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def turns(df: DataFrame, column: str = "messages") -> DataFrame:
    """df with the text of each turn, and whether it is learnt."""
    return df.withColumn("texts", turn_texts(F.col(column))).withColumn("learnt", F.transform(column, lambda m: m["role"] == "assistant"))


def masked(ids: Column, learnt: Column, bos: int | None, eos: int) -> tuple[Column, Column]:
    """Tokens and labels from the ids of each turn: answers and the end keep their ids, all else is masked."""
    empty = F.array().cast("array<int>")
    start = [F.array(F.lit(bos))] if bos is not None else []
    hidden = [F.array(F.lit(IGNORED))] if bos is not None else []
    tokens = F.concat(*start, F.coalesce(F.flatten(ids), empty), F.array(F.lit(eos)))
    kept = F.zip_with(ids, learnt, lambda t, y: F.when(y, t).otherwise(F.transform(t, lambda _: F.lit(IGNORED))))
    return tokens, F.concat(*hidden, F.coalesce(F.flatten(kept), empty), F.array(F.lit(eos)))


def shifted(tokens: Column, labels: Column) -> tuple[Column, Column]:
    """Inputs and the labels of the ids that follow; a single token gives none."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), n), F.slice(labels, F.lit(2), n)
