"""Chat formatting with collapse of cumulative snapshots.

A chat is often logged after every turn, so that each log is a prefix of the next. A rolling
hash over the turns gives every prefix of every conversation a 128-bit key; conversations
whose key is that of a proper prefix of another are removed by an anti-join, equal ones are
represented by the smallest conv_id, and what remains is rendered.

Turns are ordered by turn (null last), then role and text, and count by their place in that
order. Rows without conv_id belong to no conversation and are left out. Null roles and texts
are rendered as empty. A conversation is rendered to one string, so it is taken to fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scratch import materialize


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), n_turns and the key (key1, key2) of the prefix that ends there."""
    own = W.partitionBy("conv_id")
    order = own.orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    df = turns.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    df = df.withColumns({"place": F.row_number().over(order), "n_turns": F.count("*").over(own)})
    # a null and an empty text differ: the tags keep them apart
    parts = [F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rolling = order.rowsBetween(W.unboundedPreceding, 0)
    return df.select("conv_id", "place", "n_turns", F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(rolling).alias("key1"), F.bit_xor(F.xxhash64(F.lit(2), *parts)).over(rolling).alias("key2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (conversations with just these turns) of those that nothing extends."""
    key = ["place", "key1", "key2"]
    keys = materialize(prefix_keys(turns), "prefixes")
    whole = keys.filter("place = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    extended = keys.filter("place < n_turns").groupBy(*key).agg(F.count("*").alias("n_extending"))
    return whole.join(extended, key, "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_logged")


def render(turns: DataFrame, convs: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """The rows of ``convs`` with ``text``, their turns in the template of role and text marks."""
    said = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end + "\n"))
    rows = turns.filter("conv_id is not null").join(convs.select("conv_id"), "conv_id", "left_semi")
    order = [F.col("turn").isNull(), F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], said.alias("said"))
    chats = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["said"]), "").alias("text"))
    return convs.join(chats, "conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered. An empty table gives an empty result."""
    return render(turns, materialize(maximal(turns), "maximal"))
