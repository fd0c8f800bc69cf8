"""From one tokenizer's stream to another's: documents end at the end id, are decoded and encoded anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.tokenize import Tokenizer, decode, encode
from gristmill.plans.offsets import running


def shard_documents(shards: DataFrame, eos: int) -> DataFrame:
    """(doc, ids, partial) of a stream that is stored in shards (shard, tokens), numbered in its order.

    The end ids are left out; what follows the last one is partial. Shards are cut at their end ids inside their rows. Only what a shard begins and ends with can go on in another one
    and is shuffled; the documents between are finished where they are.
    """
    at = F.filter(F.transform("tokens", lambda t, i: F.when(t == eos, i)), lambda i: i.isNotNull())
    marked = shards.select("shard", "tokens", at.alias("ends"))
    numbered = running(marked.select("shard", F.size("ends").alias("n")), "shard", {"doc": F.col("n")}).select("shard", "doc")
    first, last = F.concat(F.array(F.lit(-1)), "ends"), F.concat("ends", F.array(F.size("tokens")))
    cut = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda x: F.slice("tokens", x["a"] + 2, x["b"] - x["a"] - 1))
    pieces = marked.join(numbered, "shard").select("shard", "doc", F.size("ends").alias("closed"), F.posexplode(cut).alias("j", "ids"))
    pieces = pieces.select("shard", (F.col("doc") + F.col("j")).alias("doc"), "ids", (F.col("j") < F.col("closed")).alias("ended"), ((F.col("j") > 0) & (F.col("j") < F.col("closed"))).alias("inner"))
    edges = pieces.where("NOT inner").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("shard", "ids"))).alias("p"), (~F.bool_or("ended")).alias("partial"))
    joined = edges.select("doc", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), "partial")
    whole = pieces.where("inner").select("doc", "ids", F.lit(False).alias("partial"))
    return whole.unionByName(joined.where(~F.col("partial") | (F.size("ids") > 0)))


def retokenize(shards: DataFrame, eos: int, source: Callable[[], Tokenizer], target: Callable[[], Tokenizer], target_eos: int | None = None, max_documents: int | None = None) -> DataFrame:
    """(doc, ids, partial) under the target tokenizer; empty documents are dropped and don't count to the maximum."""
    docs = shard_documents(shards, eos).where(F.size("ids") > 0)
    if max_documents is not None:
        docs = running(docs, "doc", {"_n": F.lit(1)}).where(F.col("_n") < max_documents).drop("_n")
    return encode(decode(docs, "ids", source), "text", target, eos=target_eos).select("doc", "ids", "partial")


def stats(shards: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: source_tokens, target_tokens, documents, empty_documents, partial_documents."""
    a = shards.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("source_tokens"))
    b = before.agg(F.count_if(F.size("ids") == 0).alias("empty_documents"), F.count_if("partial").alias("partial_documents"))
    c = after.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("target_tokens"))
    return a.join(b).join(c)
