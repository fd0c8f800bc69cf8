"""Corpus selection: quality filter, modulo shards, buffered quality ranking, hash shuffles, limits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.permute import permuted_column
from gristmill.functions.text import strip


def as_float(df: DataFrame, name: str) -> Column:
    """A number or a numeric string; booleans and all else are null."""
    kind = dict(df.dtypes).get(name)
    return F.lit(None).cast("double") if kind in (None, "boolean") else F.col(name).try_cast("double")


def as_int(df: DataFrame, name: str) -> Column:
    """Whole numbers; fractions of numeric columns are cut off, strings with a fraction are null."""
    kind = dict(df.dtypes).get(name)
    if kind in (None, "boolean"):
        return F.lit(None).cast("long")
    if kind == "string":
        return F.when(F.col(name).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.col(name)).try_cast("long"))
    return F.col(name).try_cast("long")


def quality_filter(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Rows that meet all the filters given: language, language_score_min, score_min, token_count_min, token_count_max.

    A value that is missing or no number fails its filter.
    """
    for name, column in (("language_score_min", "language_score"), ("score_min", "score")):
        if filters.get(name) is not None:
            df = df.where(as_float(df, column) >= float(filters[name]))
    if filters.get("language") is not None:
        df = df.where(F.col("language") == filters["language"])
    if filters.get("token_count_min") is not None:
        df = df.where(as_int(df, "token_count") >= int(filters["token_count_min"]))
    if filters.get("token_count_max") is not None:
        df = df.where(as_int(df, "token_count") <= int(filters["token_count_max"]))
    return df


def shard(df: DataFrame, seq: str, index: int, shards: int) -> DataFrame:
    """Every shards-th row, before any other filter."""
    if shards < 1 or not 0 <= index < shards:
        raise ValueError("0 <= index < shards is needed")
    return df if shards == 1 else df.where(F.col(seq) % shards == index)


def shuffle_key(seed: int, *columns: str) -> Column:
    """A deterministic order that stands for a seeded shuffle: by the first 40 bits of sha1("seed:columns")."""
    return F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary")), 1, 10)


def buffered_rank(df: DataFrame, seq: str, buffer: int, seed: int | None = None) -> DataFrame:
    """df with the place that a quality sort of buffers of so many rows gives each row.

    In a buffer: score, then language_score, highest first and missing last; ties keep their order or, with a seed, are
    shuffled. A buffer is one window partition, so the sort never sees more rows than it.
    """
    ties = [F.col(seq)] if seed is None else [shuffle_key(seed, seq), F.col(seq)]
    order = W.partitionBy("_buffer").orderBy(as_float(df, "score").desc_nulls_last(), as_float(df, "language_score").desc_nulls_last(), *ties)
    numbered = df.withColumn("_buffer", F.floor(F.col(seq) / buffer))
    return numbered.withColumn("place", (F.col("_buffer") * buffer + F.row_number().over(order) - 1).cast("long")).drop("_buffer")


def permuted(df: DataFrame, seq: str, seed: int, n: int | None = None) -> DataFrame:
    """df with the place that a whole shuffle for the seed gives each row, told from its number of 0..n-1; nothing is sorted or shuffled for it."""
    return df.withColumn("place", permuted_column(F.col(seq), df.count() if n is None else n, seed))


def non_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(strip(F.coalesce(F.col(column), F.lit(""))) != "")


def min_tokens(df: DataFrame, least: int, n: str = "n") -> DataFrame:
    return df.where(F.col(n) >= least)


def long_enough(df: DataFrame, ids: str, least: int) -> DataFrame:
    """Sequences of so many ids at least: what is shorter has nothing to be asked for."""
    return df.where(F.size(ids) >= least)


def first_rows(df: DataFrame, seq: str, n: int | None) -> DataFrame:
    """The first n rows seen, whatever becomes of them."""
    return df if n is None else df.where(F.col(seq) < n)


def keep_newest(df: DataFrame, name: str, n: int) -> DataFrame:
    """The rows that a retention of the n last names deletes; n <= 0 keeps all. Names are unique."""
    return df.limit(0) if n <= 0 else df.join(df.select(name).orderBy(F.col(name).desc()).limit(n), name, "left_anti")


def newest(df: DataFrame, name: str, n: int) -> DataFrame:
    """The n last rows by a column, newest first, numbered from 1 as place; only those n meet in one task."""
    return df.orderBy(F.col(name).desc()).limit(n).withColumn("place", F.row_number().over(W.orderBy(F.col(name).desc())).cast("long"))


def picked(df: DataFrame, run: str, name: str) -> DataFrame:
    """(run, chosen): the checkpoint to go on from, of each run's names: the latest, else the last step, else the final one."""
    kinds = [F.max(F.when(F.regexp_extract(name, "[^/]+$", 0).startswith(k), F.col(name))) for k in ("latest", "step_", "final")]
    return df.groupBy(run).agg(F.coalesce(*kinds).alias("chosen"))
