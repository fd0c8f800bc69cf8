"""Order-dependent sums over whole tables without a task that sees them all.

Rows are dealt into ranges of the order column. Each range is summed by a window of its own; the ranges' totals, one row
for each range and so no more than shuffle partitions, are added up on the driver and joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTS = 256


def pieces(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: str, wanted: int | None = None) -> Column:
    """The number of a row's range: quantiles of the order column, each cut evenly again where more than CUTS are wanted."""
    wanted = wanted or pieces(df)
    coarse = min(wanted, CUTS)
    cuts = [i / coarse for i in range(1, coarse)]
    found = df.agg(F.percentile_approx(order, cuts, 1000 + 20 * coarse).alias("c") if cuts else F.lit(None).alias("c"), F.min(order).alias("a"), F.max(order).alias("b")).first()
    if not found["c"]:
        return F.lit(0).cast("long")
    edges = sorted({int(x) for x in found["c"]})
    at = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in edges]), lambda c: c <= F.col(order))).cast("long")
    finer = -(-wanted // CUTS)
    if finer == 1:
        return at
    low = F.element_at(F.array(*[F.lit(float(x)) for x in (found["a"], *edges)]), (at + 1).cast("int"))
    high = F.element_at(F.array(*[F.lit(float(x)) for x in (*edges, found["b"] + 1)]), (at + 1).cast("int"))
    share = F.floor((F.col(order).cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * finer)
    return at * finer + F.greatest(F.lit(0), F.least(share, F.lit(finer - 1)))


def running(df: DataFrame, order: str, sums: dict[str, Column], *ties: str) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before; rows go by the order column, which is unique
    but for what the columns `ties` tell apart.

    Keep df narrow: lengths, not texts or ids.
    """
    part = ranged(df, order)
    dealt = df.withColumns({"_part": part, **{f"_{k}": F.coalesce(c, F.lit(0)).cast("long") for k, c in sums.items()}})
    totals = sorted(map(tuple, dealt.groupBy("_part").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect()))
    before, rows = [0] * len(sums), []
    for number, *values in totals:
        rows.append((number, *before))
        before = [a + (b or 0) for a, b in zip(before, values, strict=True)]
    schema = ", ".join(["_part long", *(f"_b_{k} long" for k in sums)])
    base = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    window = W.partitionBy("_part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    inside = dealt.withColumns({k: F.coalesce(F.sum(f"_{k}").over(window), F.lit(0)) for k in sums}).join(base, "_part")
    return inside.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_part", *(f"_{k}" for k in sums), *(f"_b_{k}" for k in sums))


def numbered(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """df with the rank of each row, from 0."""
    return running(df, order, {name: F.lit(1)})
