"""Training packages that are kept: each under a signature of what went into it, written anew only where that differs.

A package is a partition of one table, and its signature stands in its own row, so the table is its own manifest: what
is stored and what it was made of are committed together. A run plans on lengths alone, compares signatures, and cuts
and writes tokens only for packages that are missing or were made of something else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.pack import shard_spans
from gristmill.sources.config import Source, signature

STORED = "signature string, samples long, ids array<int>, package long"


def planned(mixed: DataFrame, size: int) -> DataFrame:
    """(package, slot, source, seq, low, high, start): the pieces of each package of so many tokens, of (slot, source, seq, n, start)."""
    spans = shard_spans(mixed.select("slot", "source", "seq", "n", "start"), "n", size)
    return spans.select(F.col("shard").alias("package"), "slot", "source", "seq", "low", "high", "start")


def signed(pieces: DataFrame, sources: Sequence[Source], **more: object) -> DataFrame:
    """(package, signature): a hash over a package's pieces, each with the signature of its source; `more` is what else the tokens depend on."""
    known = F.create_map(*[F.lit(x) for s in sources for x in (s.name, signature([s], **more))])
    piece = F.xxhash64(known[F.col("source")], "slot", "source", "seq", "low", "high")
    # an exclusive or and a sum: no order, and no piece cancels its double
    whole = F.concat_ws("-", F.hex(F.bit_xor(piece)), F.hex(F.sum(F.shiftrightunsigned(piece, 16))), F.count(F.lit(1)).cast("string"))
    return pieces.groupBy("package").agg(whole.alias("signature"))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The packages in a folder, none if it isn't there."""
    try:
        return spark.read.schema(STORED).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def store(mixed: DataFrame, sources: Sequence[Source], size: int, folder: str, **more: object) -> list[int]:
    """Bring a folder's packages up to date with a mixture (slot, source, seq, n, ids, start); the numbers of those written.

    Packages beyond the mixture's end are removed.
    """
    spark = mixed.sparkSession
    pieces = planned(mixed, size)
    wanted = signed(pieces, sources, size=size, **more)
    have = stored(spark, folder).select("package", F.col("signature").alias("old"))
    # a row for each package that changes, as a driver lists the files that it commits
    changes = wanted.join(have, "package", "full").where(~F.col("signature").eqNullSafe(F.col("old"))).select("package", "signature").collect()
    stale = [r["package"] for r in changes if r["signature"] is not None]
    if stale:
        marked = F.broadcast(spark.createDataFrame([(r["package"], r["signature"]) for r in changes if r["signature"] is not None], "package long, signature string"))
        cut = pieces.join(marked, "package").join(mixed.select("slot", "ids"), "slot")
        part = F.slice("ids", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
        listed = cut.select("package", "signature", F.struct((F.col("start") + F.col("low")).alias("at"), part.alias("part")).alias("p")).groupBy("package", "signature").agg(F.array_sort(F.collect_list("p")).alias("ps"))
        rows = listed.select("signature", F.size("ps").cast("long").alias("samples"), F.flatten("ps.part").cast("array<int>").alias("ids"), "package")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").parquet(folder)
    drop(spark, folder, [r["package"] for r in changes if r["signature"] is None])
    return sorted(stale)


def drop(spark: SparkSession, folder: str, packages: Sequence[int]) -> None:
    """Remove packages: those that have been used, or that a shorter mixture no longer has."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in packages:
        fs.delete(path(f"{folder}/package={p}"), True)
