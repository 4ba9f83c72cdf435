"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation several times, each time a few turns longer. Turns
are numbered within their conversation; the rolling hash of a prefix is that of
its numbered turns, folded one by one. A conversation whose whole hash is the hash
of a proper prefix of a longer one is dropped by an anti-join, and of equal
conversations the least conv_id stays. Only the maximal ones are rendered.

The hash has 128 bits (two 64-bit values) and goes with the number of turns.
Rolling, counting and joining move hashes only; texts are gathered once per
conversation that stays, since a rendered conversation is one value.

Cases: turns are ordered by turn (nulls first), then role and text, so ties and
repeated rows have a fixed order and count as turns; null role and text render as
empty, and count as different from an empty one when conversations are compared;
a row without conv_id is a conversation of one turn of its own, and of equal ones
a single row stays; an empty table gives an empty one; other columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import materialise

#: Marks of the rendered text (a public chat layout).
START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(salt: str) -> Column:
    # null and empty differ: xxhash64 skips a null, so its absence is hashed as well
    return F.xxhash64(F.lit(salt), "number", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns with a key of their conversation and their number in it."""
    whole = F.xxhash64(F.lit("lone"), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = rows.where("conv_id IS NOT NULL").withColumn("lone", F.lit(0).cast("long"))
    lone = rows.where("conv_id IS NULL").withColumn("lone", whole).dropDuplicates(["lone"])
    order = Window.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    return named.unionByName(lone).withColumn("number", F.row_number().over(order))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, number, a, b, last): the rolling hash after each turn, and whether it is the last one."""
    turns = _numbered(conversations).select(
        "conv_id", "lone", "number", _turn_hash("a").alias("a"), _turn_hash("b").alias("b"))
    every = Window.partitionBy("conv_id", "lone").orderBy("number")
    rolling = every.rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "lone", "number", F.bit_xor("a").over(rolling).alias("a"),
                        F.bit_xor("b").over(rolling).alias("b"),
                        F.lead("number").over(every).isNull().alias("last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, lone, n_turns) of the conversations that no longer one begins with."""
    prefixes = materialise(prefix_hashes(conversations), "prefixes")
    whole = prefixes.where("last").groupBy("number", "a", "b").agg(
        F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "lone")).alias("least"))
    proper = prefixes.where("NOT last").select("number", "a", "b").distinct()
    return whole.join(proper, ["number", "a", "b"], "left_anti").select(
        F.col("least.conv_id").alias("conv_id"), F.col("least.lone").alias("lone"), F.col("number").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of the maximal conversations, as one chat text each."""
    kept = maximal(conversations).select(F.col("conv_id").alias("k"), F.col("lone").alias("l"), "n_turns")
    turns = _numbered(conversations).join(kept, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("lone") == F.col("l")))
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")),
                     F.lit(END + "\n"))
    return turns.select("conv_id", "lone", "n_turns", F.struct("number", piece.alias("piece")).alias("turn")).groupBy(
        "conv_id", "lone", "n_turns").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("text"))
