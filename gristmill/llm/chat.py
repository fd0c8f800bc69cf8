"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

Chat logs hold the same conversation at several lengths. Each turn gets a hash of its place, role and text; the xor of
the turns so far is the rolling hash of that prefix (two 64-bit hashes, 128 bits). A conversation whose whole hash is a
proper prefix's is dropped by an anti-join; of conversations with the same turns the smallest conv_id stays. What is
left is rendered, a turn after the other.

Texts are shuffled to bring a conversation's turns together, after repeated rows fell in partial sets, and once more
where the conversations that stay are picked by their id and are too many to broadcast. The prefix joins read hashes alone.

Defined results: turns go by number, then role, then text, nulls first; a row that is there twice counts once; null roles
and texts are empty; a row without conv_id is a conversation by itself, and equal ones are one; an empty table gives no rows; other columns are not read;
texts may be as long as they like. A conversation is one row of the result, so its own turns, and no others, come
together in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, alone, turns): the distinct turns of each conversation, in order, as structs of turn, role, text.

    Rows without conv_id, which may be very many, are told apart by a hash of what they hold, alone.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    alone = F.when(F.col("conv_id").isNull(), F.sha2(F.to_json(F.struct("turn", role.alias("role"), text.alias("text"))), 256))
    rows = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), text.alias("text")).alias("turn"))
    return rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_set("turn")).alias("turns"))


def hashed(talks: DataFrame) -> DataFrame:
    """talks with n_turns and hashes, a struct of two 64-bit hashes for each turn in its place."""
    pair = lambda x, i: F.struct(
        F.xxhash64(i + 1, x["role"], x["text"]).alias("a"),
        F.xxhash64(F.lit("second"), x["text"], i + 1, x["role"]).alias("b"),
    )
    return talks.withColumns({"n_turns": F.size("turns").cast("long"), "hashes": F.transform("turns", pair)})


def prefixes(talks: DataFrame) -> DataFrame:
    """(conv_id, alone, place, n_turns, h1, h2): the hash of each prefix, from ids, n_turns and hashes alone."""
    rows = talks.select("conv_id", "alone", "n_turns", F.posexplode("hashes").alias("at", "h"))
    so_far = W.partitionBy("conv_id", "alone").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("conv_id", "alone", (F.col("at") + 1).cast("long").alias("place"), "n_turns", F.bit_xor("h.a").over(so_far).alias("h1"), F.bit_xor("h.b").over(so_far).alias("h2"))


def maximal(marked: DataFrame) -> DataFrame:
    """(conv_id, alone, n_copies) of the conversations that prefix no longer one, one for each list of turns, with an id if any has one."""
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "alone"))
    whole = marked.where("place = n_turns").groupBy("n_turns", "h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("n_copies"))
    part = marked.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(part, ["n_turns", "h1", "h2"], "left_anti").select("first.conv_id", "first.alone", "n_copies")


def rendered(turns: str, opening: str = OPEN, closing: str = CLOSE) -> Column:
    """One string from an array of structs of role and text."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(opening), x["role"], F.lit("\n"), x["text"], F.lit(closing))), "")


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations of (conv_id, turn, role, text)."""
    talks = materialize(hashed(conversations(turns)), "chat-conversations")
    keep = materialize(maximal(materialize(prefixes(talks), "chat-prefixes")), "chat-maximal")
    same = F.expr("t.conv_id <=> k.conv_id AND t.alone <=> k.alone")
    return talks.select("conv_id", "alone", "n_turns", "turns").alias("t").join(keep.alias("k"), same).select("t.conv_id", "n_turns", "n_copies", rendered("turns").alias("rendered"))
