"""Chat formatting after collapsing cumulative snapshots of conversations.

A log often holds a conversation once per turn, each time a little longer. A rolling hash of every turn prefix
finds them: a conversation whose whole hash is the hash of a proper prefix of another one is left out by an anti-join.
Only DataFrame functions are used. Turns are dealt by ranges of their order, so neither a long conversation nor many
turns of one number are one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import stored


def turn_text(role: Column, text: Column) -> Column:
    """A turn as written; a mark inside of a role or text is escaped, so that no turn can forge another."""
    plain = F.replace(text, F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), F.replace(role, F.lit("|"), F.lit("\\|")), F.lit("|>\n"), plain, F.lit("\n"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, run, pos (from 1), role, text as a table; nulls are empty, order is by turn, role and text.

    Runs are ranges of that order, so positions are two short sums.
    """
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    turns = stored(turns.repartitionByRange("conv_id", *order).withColumn("run", F.spark_partition_id()), "turns")
    sizes = turns.groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "run").orderBy(*order)
    turns = turns.withColumn("inside", F.row_number().over(inside))
    joined = turns.join(sizes, (turns.conv_id == sizes.c) & (turns.run == sizes.r))
    empty = F.lit("")
    return stored(joined.select("conv_id", "run", (F.col("before") + F.col("inside")).alias("pos"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")), "ordered")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2: 128 bits of the turns up to pos.

    Each turn's hash holds its position, and prefixes are their exclusive sums: so runs of a conversation are
    hashed apart and put together.
    """
    # Role and text are hashed as separate values: joined strings could be cut elsewhere.
    own = turns.select("conv_id", "run", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit(91), "text", "pos", "role").alias("b"))
    runs = own.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("ra"), F.bit_xor("b").alias("rb"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.bit_xor("ra").over(before), zero).alias("ra"), F.coalesce(F.bit_xor("rb").over(before), zero).alias("rb"))
    inside = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("a", F.bit_xor("a").over(inside)).withColumn("b", F.bit_xor("b").over(inside))
    joined = own.join(runs, (own.conv_id == runs.c) & (own.run == runs.r))
    return joined.select("conv_id", "pos", F.col("a").bitwiseXOR(F.col("ra")).alias("h1"), F.col("b").bitwiseXOR(F.col("rb")).alias("h2"))


def maximal_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered of every conversation that is no prefix of a longer one.

    Equal conversations become one, with the least conv_id; n_copies is how many there were. Null roles and texts
    count as empty; turns of one number are ordered by role and text; rows without conv_id are left out. A `<|` inside of a
    text is written `<\\|`, a `|` inside of a role `\\|`. Further columns are ignored, an empty table gives no rows.
    """
    turns = ordered_turns(conversations)
    hashes = stored(prefix_hashes(turns), "prefixes")
    whole = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    whole = whole.groupBy("last.pos", "last.h1", "last.h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    ends = hashes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    proper = hashes.join(ends, "conv_id").where("pos < n_turns").select("pos", "h1", "h2").distinct()
    kept = whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")
    said = turns.join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("pos", turn_text(F.col("role"), F.col("text")).alias("said")).alias("turn"))
    text = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["said"]), "").alias("rendered"))
    return kept.join(text, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
